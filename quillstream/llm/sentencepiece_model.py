"""Reads SentencePiece model files without generated protobuf code, and rebuilds them for the tokenizers library."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model_path() -> str:
    """The model file that queries use: ``QUILLSTREAM_SENTENCEPIECE_MODEL``, else the public 32k model of the box."""
    if found := os.environ.get("QUILLSTREAM_SENTENCEPIECE_MODEL"):
        return found
    return "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""
    vocab: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.vocab = {p: i for i, p in enumerate(self.pieces)}

    @property
    def unk(self) -> int:
        return self.kinds.index(UNKNOWN)

    def text_pieces(self) -> dict[str, int]:
        """Pieces that can come out of text: neither control, unknown, unused nor byte pieces."""
        return {p: i for p, i in self.vocab.items() if self.kinds[i] in (NORMAL, USER_DEFINED)}

    def splits_at_marks(self) -> bool:
        """Whether no piece runs over a word start: then words can be encoded one by one."""
        return all(MARK not in p.lstrip(MARK) for p in self.text_pieces())


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding and decoding need."""
    pieces, scores, kinds, settings = [], [], [], {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
            settings |= {"algorithm": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0))}
        elif number == 3:
            norm = dict(_fields(value))
            settings |= {"charsmap": norm.get(2, b""), "add_dummy_prefix": bool(norm.get(3, 1)), "remove_extra_whitespaces": bool(norm.get(4, 1)), "escape_whitespaces": bool(norm.get(5, 1))}
    model = Model(pieces, scores, kinds, **settings)
    if model.algorithm not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if not model.escape_whitespaces:
        raise ValueError("models that don't mark word starts aren't supported")
    return model


def load(path: str) -> Model:
    with open(path, "rb") as file:
        return parse(file.read())


def merges(model: Model) -> list[tuple[str, str]]:
    """The merge list that a BPE model's piece scores stand for: best score first."""
    vocab = model.text_pieces()
    found = []
    for piece, i in vocab.items():
        halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in vocab and piece[k:] in vocab]
        found.extend((-model.scores[i], i, vocab[a], vocab[b], a, b) for a, b in halves)
    return [(a, b) for *_, a, b in sorted(found)]


def normaliser(model: Model):
    """The model's normaliser for the tokenizers library: character map, space runs, word-start marks."""
    from tokenizers import Regex, normalizers

    steps: list = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def tokenizer(model: Model):
    """The model as a tokenizers.Tokenizer: normaliser, word-start pre-tokens, scores or merges, byte fallback, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    if model.algorithm == UNIGRAM:
        core = models.Unigram([(p, s) for p, s in zip(model.pieces, model.scores)], unk_id=model.unk, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE(model.vocab, merges(model), unk_token=model.pieces[model.unk], fuse_unk=False, byte_fallback=model.byte_fallback)
    built = Tokenizer(core)
    built.normalizer = normaliser(model)
    if model.splits_at_marks():
        built.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    built.decoder = decoders.Sequence(steps)
    return built
