"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions alone.

A paragraph is a line, and its node the SHA-256 of its text. A section is a run of ``SECTION`` paragraphs, and its node the
SHA-256 of its paragraphs' nodes; the root is the SHA-256 of the sections' nodes. Equal texts have equal roots, and where
two trees differ, comparing sections and then their paragraphs locates the edit (``differing_branches``).

For likeness the tree goes on below the paragraphs: leaves of up to ``LEAF`` code points, which start anew in each
paragraph. ``likeness`` is the larger of two shares: leaves that are equal branch by branch, in order, among the larger
number of leaves; and distinct paragraph nodes that both trees have, wherever they stand, among the larger number of them.

The edited text of ``with_next`` takes its end from the next document. That needs each text beside its successor's. Ids are
cut into ranges by approximate percentiles, texts are shuffled once by range, and the first document of each range is sent
to the range before as well, so a window over a range sees every successor; no window spans the table. Which percentiles
come out changes only the sizes of ranges, never a result.

Defined cases: a null text is an empty one; an empty text has one empty paragraph and no leaves, and two empty texts have
likeness 1; rows without an id come before all others, rows of one id are ordered by their texts' hashes and repeated rows
each get their row; the only row of a table is its own successor; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = 8
LEAF = 8
RANGE_ROWS = 2000
COARSE, FINE = 128, 128


def paragraph_nodes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))


def section_nodes(paragraphs: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(paragraphs) - 1) / SECTION).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(paragraphs, i * SECTION + 1, SECTION)), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.concat_ws("", sections), 256)


def fingerprint(text: Column) -> Column:
    """The root of a text's tree, as lowercase hex."""
    return root(section_nodes(paragraph_nodes(text)))


def leaves(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\n|[^\n]{1,%d}" % LEAF), F.lit(0))


def likeness(leaves_a: Column, leaves_b: Column, paragraphs_a: Column, paragraphs_b: Column) -> Column:
    """Likeness of two trees from 0 to 1; 1 if they are equal."""
    most = F.greatest(F.size(leaves_a), F.size(leaves_b))
    equal = F.size(F.filter(F.zip_with(leaves_a, leaves_b, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    aligned = F.when(most == 0, F.lit(1.0)).otherwise(equal / most)
    distinct = F.greatest(F.size(F.array_distinct(paragraphs_a)), F.size(F.array_distinct(paragraphs_b)))
    moved = F.size(F.array_intersect(paragraphs_a, paragraphs_b)) / distinct
    return F.greatest(aligned, moved)


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root, sections, paragraphs) of every document: the nodes as lowercase hex, in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    nodes = docs.select(F.col(id_col).alias("id"), paragraph_nodes(text).alias("paragraphs"))
    nodes = nodes.withColumn("sections", section_nodes(F.col("paragraphs")))
    return nodes.select("id", root(F.col("sections")).alias("root"), "sections", "paragraphs")


def differing_branches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where the trees of the same id differ: (id, section, paragraph), both from 0; ids whose roots are equal give no row.

    Only the paragraphs of differing sections are compared. A paragraph that one side lacks differs.
    """
    both = left.alias("l").join(right.alias("r"), "id").where("l.root <> r.root")
    pairs = both.select("id", F.posexplode(F.arrays_zip(F.col("l.sections").alias("a"), F.col("r.sections").alias("b"))).alias("section", "pair"), F.col("l.paragraphs").alias("p"), F.col("r.paragraphs").alias("q"))
    apart = pairs.where(~F.col("pair.a").eqNullSafe(F.col("pair.b")))
    cut = lambda c: F.slice(c, F.col("section") * SECTION + 1, SECTION)
    inner = apart.select("id", "section", F.posexplode(F.arrays_zip(cut("p").alias("a"), cut("q").alias("b"))).alias("at", "pair"))
    return inner.where(~F.col("pair.a").eqNullSafe(F.col("pair.b"))).select("id", "section", (F.col("section") * SECTION + F.col("at")).alias("paragraph"))


def _bounds(docs: DataFrame, id_col: str, range_rows: int) -> list[int]:
    """Ids at which ranges start, ascending; at most COARSE * FINE of them."""
    n = docs.agg(F.count(id_col)).first()[0]
    parts = min(-(-n // range_rows), COARSE * FINE)
    if parts < 2:
        return []
    at = F.percentile_approx(id_col, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))
    return sorted(set(docs.agg(at).first()[0]))


def _range_of(id_col: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at most the id: a search through blocks of bounds, then within one block."""
    if not bounds:
        return F.lit(0)
    blocks = [bounds[i : i + FINE] for i in range(0, len(bounds), FINE)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= id_col))
    whole = F.greatest(count(array([b[0] for b in blocks])) - 1, F.lit(0))
    return F.coalesce(whole * FINE + count(F.get(F.array(*[array(b) for b in blocks]), whole)), F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, text, next_text): each text beside that of the next document in ascending order of ids; after the last, the first."""
    bounds = _bounds(docs, id_col, range_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    first = rows.agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie"))).first()[0]
    if first is None:
        return rows.select("id", "text", F.col("text").alias("next_text"))
    rows = rows.withColumn("range", _range_of(F.col("id"), bounds))
    # Besides its own range, a range's first document goes to the range before, and the very first one to the end of the last.
    starts = F.col("id").isin(bounds) if len(bounds) < 200 else F.array_contains(F.get(F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + FINE]]) for i in range(0, len(bounds), FINE)]), F.floor((F.col("range") - 1) / FINE).cast("int")), F.col("id"))
    very_first = F.col("id").eqNullSafe(F.lit(first["id"]).cast("long")) & (F.col("tie") == F.lit(first["tie"]))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    before = F.when(F.coalesce(starts, F.lit(False)), F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("guest")))
    after_last = F.when(very_first, F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("guest")))
    placed = rows.select("id", "text", "tie", F.explode(F.filter(F.array(own, before, after_last), lambda x: x.isNotNull())).alias("at"))
    placed = placed.select("id", "text", "tie", "at.range", "at.guest")
    order = Window.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_first(), "tie")
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("id", "text", "next_text")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, text, next_text, n_chars, edited_text): the last quarter of each text gives way to the next text's beginning."""
    rows = with_next(docs, id_col, text_col, range_rows).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    return rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per document its root, its edited text's SHA-256 and root, and its likeness to the edited text and to the next document."""
    rows = edited(docs, id_col, text_col, range_rows)
    named = rows.select(
        "id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        *[f(F.col(c)).alias(f"{c}_{n}") for c in ("text", "edited_text", "next_text") for n, f in (("p", paragraph_nodes), ("l", leaves))],
    )
    near = lambda other: likeness(F.col("text_l"), F.col(f"{other}_l"), F.col("text_p"), F.col(f"{other}_p"))
    return named.select(
        "id", "n_chars", "edited_sha256", root(section_nodes(F.col("text_p"))).alias("fingerprint"), root(section_nodes(F.col("edited_text_p"))).alias("edited_fingerprint"),
        near("edited_text").alias("near_edited"), near("next_text").alias("near_next"),
    )


def compare_sql() -> str:
    """``compare`` over a view ``documents`` as DuckDB SQL, for tables whose ids are set and unique."""
    near = lambda other: f"""greatest(CASE WHEN greatest(len(text_l), len({other}_l)) = 0 THEN 1.0
        ELSE len(list_filter(range(1, least(len(text_l), len({other}_l)) + 1), lambda i: text_l[i] = {other}_l[i]))::DOUBLE / greatest(len(text_l), len({other}_l)) END,
      len(list_intersect(text_p, {other}_p))::DOUBLE / greatest(len(list_distinct(text_p)), len(list_distinct({other}_p))))"""  # noqa: E731
    tree = lambda p: f"sha256(array_to_string(list_transform(range(0, (len({p}) - 1) // {SECTION} + 1), lambda i: sha256(array_to_string({p}[i * {SECTION} + 1 : i * {SECTION} + {SECTION}], ''))), ''))"
    nodes = ", ".join(f"list_transform(string_split({c}, chr(10)), lambda p: sha256(p)) AS {n}_p, regexp_extract_all({c}, '\\n|[^\\n]{{1,{LEAF}}}') AS {n}_l" for c, n in (("text", "text"), ("edited", "edited"), ("following", "following")))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 4) || substr(following, 1, n_chars // 4) AS edited FROM n),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {nodes} FROM e)
SELECT doc_id, n_chars, edited_sha256, {tree("text_p")} AS fingerprint, {tree("edited_p")} AS edited_fingerprint,
       {near("edited")} AS near_edited, {near("following")} AS near_next
FROM t"""
