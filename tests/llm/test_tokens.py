import struct

import pytest
import sentencepiece

from quillstream.llm import sentencepiece_codec as codec_module
from quillstream.llm import sentencepiece_model as model_module
from quillstream.llm import token_counts
from quillstream.session import ship

from .common import FOLDER, ODD, frame, prose

PATH = model_module.default_model_path()


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def block(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_file(path, byte_fallback=True):
    """A hand-made unigram model: a few pieces with scores, and byte pieces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in [("▁", -3.1), ("▁the", -2.2), ("▁t", -4.3), ("he", -3.4), ("h", -5.5), ("e", -4.6), ("t", -4.7), ("a", -4.8), ("▁a", -3.05), ("th", -4.15), ("cat", -5.25), ("c", -6.35), ("at", -4.45), ("▁c", -5.05)]]
    data = b"".join(block(1, block(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    data += block(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(int(byte_fallback)))
    data += block(3, block(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1))
    path.write_bytes(data)
    return str(path)


TEXTS = ["", " ", "the cat", "a  the catthe", "heat that", "the zat é", "tttt hhhh", " the", "cat\ncat"]


def test_codec_equals_sentencepiece():
    codec = codec_module.Codec(PATH)
    codec.verify(PATH, [*codec_module.PROBES, *[t for _, t in ODD if t], "▁▁x▁", "a" * 3000 + "é" * 500])


def test_codec_on_a_unigram_model(tmp_path):
    path = unigram_file(tmp_path / "u.model")
    codec_module.Codec(path, check=False).verify(path, TEXTS)


def test_counts_equal_sentencepiece(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [r["text"] for r in docs.collect()] + [t or "" for _, t in ODD]
    other = sentencepiece.SentencePieceProcessor(model_file=PATH)
    trie = token_counts.CountingTrie(model_module.load(PATH), words_held=500)
    for at in range(0, len(texts), 20):  # the table of words starts anew several times
        assert trie.count(texts[at : at + 20]) == [len(x) for x in other.encode(texts[at : at + 20])]
    for fallback in (True, False):
        path = unigram_file(tmp_path / f"u{fallback}.model", fallback)
        one = sentencepiece.SentencePieceProcessor(model_file=path)
        assert token_counts.CountingTrie(model_module.load(path)).count(TEXTS) == [len(one.encode(t)) for t in TEXTS]


def test_count_query(spark):
    got = {(r["id"], r["n_chars"]): r["n_tokens"] for r in token_counts.count_tokens(frame(spark, ODD)).collect()}
    assert got[1, 0] == 0 and got[2, 0] == 0 and got[7, 50_000] > 1000
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def test_round_trip(spark):
    docs = frame(spark, ODD).withColumnRenamed("lang", "n_tokens")
    encoded = codec_module.encode(docs, round_trip_col="same")
    assert encoded.columns == ["doc_id", "text", "source", "n_chars", "ids", "n_tokens", "same"]
    for r in codec_module.decode(encoded).collect():
        assert r["decoded"] == r["text"] and (r["same"] is None if r["text"] is None else r["same"])
        assert (r["ids"] is None) == (r["text"] is None) and r["n_tokens"] == len(r["ids"] or [])
    assert codec_module.encode(frame(spark, [])).count() == 0


def test_invalid_bytes_decode_to_replacement_characters():
    codec = codec_module.Codec(PATH)
    other = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [other.piece_to_id("<0xC3>"), other.piece_to_id("▁a")]
    assert codec.decode(ids) == other.decode(ids)


def test_clashing_names(spark):
    docs = frame(spark, ODD).selectExpr("*", "lang AS __text", "lang AS __ids", "lang AS id", "lang AS n_tokens", "lang AS ids")
    assert token_counts.count_tokens(docs).count() == len(ODD)
    coded = codec_module.encode(docs)
    assert coded.columns == [c for c in docs.columns if c not in ("ids", "n_tokens")] + ["ids", "n_tokens"]
    assert [r["__text"] for r in coded.collect()] == ["en"] * len(ODD)
    assert {r["decoded"] for r in codec_module.decode(coded).collect()} == {t for _, t in ODD}


def test_bounded_tables_change_nothing(monkeypatch):
    texts = [t for _, t in ODD] + TEXTS
    want = [x.tolist() for x in codec_module.Codec(PATH).encode([t or "" for t in texts])]
    monkeypatch.setattr(codec_module, "BYTES_HELD", 100)
    small = codec_module.Codec(PATH)
    assert [small.encode([t or ""])[0].tolist() for t in texts] == want
    counting = token_counts.CountingTrie(model_module.load(PATH), words_held=3)
    assert [counting.count([t])[0] for t in texts] == list(map(len, want))


def test_new_words_go_in_together_and_decode_as_whole_texts(monkeypatch):
    codec = codec_module.Codec(PATH)
    texts = [prose(1, 3000), "x  y   z ", " a", "▁▁x▁ y▁z", "\n \n", "é中 \U0001f600 \x00", *codec_module.PROBES, *[t or "" for _, t in ODD], *TEXTS]
    sent, real = [], codec._encode_words
    monkeypatch.setattr(codec, "_encode_words", lambda words: sent.extend(words) or real(words))
    codec.encode(texts[:1])
    assert len(sent) <= len(set(texts[0].split())) / 10
    other = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = other.encode(texts)
    for apart in (False, True):  # without a token that begins each word, words go in one by one
        codec.forget()
        if apart:
            codec.marked = codec.marked & False
        ids, back = codec.code(texts)
        assert [x.tolist() for x in ids] == want and back == [other.decode(x) for x in want] == [codec.decode(x) for x in want]
        assert [t == b for t, b in zip(texts, back)] == ["▁" not in t for t in texts]
