"""Small fixtures for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, lang, source]) as a table of documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed: int, words: int, vocabulary: int = 5000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


#: Null and empty texts, ties, repeated rows, a null id, white space alone, and a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id at all"), (7, "x" * 50_000), (8, prose(1, 30_000)), (9, "é 中文 \U0001f600\nzwei")]
