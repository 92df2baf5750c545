"""SentencePiece models on the tokenizers library: encoding, decoding and proof of parity.

The model file is parsed, and normaliser, blank marker, scores and byte fallback are
rebuilt as a tokenizers pipeline: unigram models by their scores, BPE models by merges
in the order of the scores. Where no piece of the vocabulary reaches over a marker that
follows another character, a text is cut there and distinct parts are encoded once,
in multithreaded batches. The same holds for line ends, and for marks behind a letter.
IDs are decoded by a table of the bytes of every piece; what is no UTF-8 then goes through
the pipeline's decoder. Every text may be checked against the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from sirenframe.llm.common import text_of
from sirenframe.llm.piece_cache import MARK, PieceCache

MARKER = "▁"
MARKS = ".,;:!?#$%&*|"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_PARTS = 500_000


@dataclass
class Spec:
    """What a model file says; values are the format's defaults where it is silent."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    marker_behind: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True

    @property
    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; lengths of 4 and 8 bytes stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError("not a model file")
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


def parse(raw: bytes) -> Spec:
    """Field numbers are those of the public model format."""
    spec = Spec()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    spec.model_type = v
                elif n == 24:
                    spec.marker_behind = bool(v)
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze_blanks = bool(v)
                elif n == 5:
                    spec.escape_blanks = bool(v)
    return spec


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, best score first, then in order of the IDs."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for whole, at in ids.items():
        for cut in range(1, len(whole)):
            left, right = whole[:cut], whole[cut:]
            if left in ids and right in ids:
                found.append((-pieces[at][1], at, cut, left, right))
    return [(left, right) for _, _, _, left, right in sorted(found)]


def _normaliser(spec: Spec) -> normalizers.Normalizer:
    steps: list[normalizers.Normalizer] = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.squeeze_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if spec.escape_blanks else " "))
    if spec.escape_blanks:
        steps.append(normalizers.Replace(" ", MARKER))
    return normalizers.Sequence(steps)


def rebuild(spec: Spec) -> Tokenizer:
    """The tokenizers pipeline of a model; special pieces are never read out of a text."""
    if spec.marker_behind or spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the marker in front are supported")
    unknown = spec.pieces[spec.unknown_id][0]
    if spec.model_type == UNIGRAM:
        # A text must not reach control, unused or byte pieces by their names.
        hidden = {UNKNOWN, CONTROL, UNUSED, BYTE}
        low = min((s for _, s, kind in spec.pieces if kind == NORMAL), default=0.0) - 1000.0
        vocabulary = [(p, low if kind in hidden else s) for p, s, kind in spec.pieces]
        model = models.Unigram(vocabulary, spec.unknown_id, spec.byte_fallback)
    else:
        model = models.BPE(
            {p: i for i, (p, _, _) in enumerate(spec.pieces)},
            merges(spec.pieces),
            unk_token=unknown,
            fuse_unk=True,
            byte_fallback=spec.byte_fallback,
        )
    tokenizer = Tokenizer(model)
    tokenizer.normalizer = _normaliser(spec)
    steps: list[decoders.Decoder] = [decoders.Replace(MARKER, " ")]
    if spec.byte_fallback:
        steps.append(decoders.ByteFallback())
    steps.append(decoders.Fuse())
    if spec.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    own = [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class PieceEncoder:
    """Encodes and decodes with the rebuilt pipeline of one model file."""

    def __init__(self, raw: bytes, cache_parts: int = CACHE_PARTS):
        # The library reads this when it first runs a batch.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.spec = parse(raw)
        self.tokenizer = rebuild(self.spec)
        self.own = [p for p, _, kind in self.spec.pieces if kind == USER_DEFINED]
        # A part is encoded as it stands: its text is normalised already.
        self.bare = rebuild(self.spec)
        self.bare.normalizer = normalizers.Sequence([])
        self.cuttable = self.spec.escape_blanks and not any(
            re.search(f"[^{MARKER}]{MARKER}", p) for p, _, kind in self.spec.pieces if kind == NORMAL
        )
        plain = not self.spec.charsmap and not self.spec.squeeze_blanks
        self.plain = plain and self.spec.dummy_prefix
        self.cache = PieceCache(self._encode, cache_parts)
        self._cut = re.compile(f"(?<=[^{MARKER}])(?={MARKER})")
        # Unknown characters may be fused where there are no bytes to fall back on.
        falls_back = self.spec.byte_fallback and sum(kind == BYTE for _, _, kind in self.spec.pieces) == 256
        normal = [p for p, _, kind in self.spec.pieces if kind == NORMAL]
        self.cuts_lines = falls_back and not any("\n" in p[1:] for p in normal)
        self.cuts_marks = falls_back and not any(re.search(rf"[^\W\d_][{MARKS}]", p) for p in normal)
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.spelled = pa.array([self._bytes(t) for t in tokens], pa.large_binary())

    def _bytes(self, token: str | None) -> bytes:
        """What a token stands for in a text, as the steps of the decoder have it."""
        if self.spec.byte_fallback and token and re.fullmatch("<0x[0-9A-Fa-f]{2}>", token):
            return bytes([int(token[3:5], 16)])
        return (token or "").replace(MARKER, " ").encode()

    def normalised(self, text: str) -> str:
        if self.plain:
            return (MARKER + text).replace(" ", MARKER) if text else ""
        return self.tokenizer.normalizer.normalize_str(text) if text else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        """IDs of each text as little-endian unsigned 32-bit numbers."""
        if not self.cuttable:
            whole = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in whole]
        marked = [self._marked(t) for t in texts]
        together = iter(self.cache.joined([m for m in marked if m is not None]))
        out = []
        for text, parts in zip(texts, marked):
            if parts is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(array("I", ids).tobytes())
            else:
                out.append(next(together))
        return out

    def _marked(self, text: str) -> str | None:
        """The normalised text with a mark between its parts, or None where only the whole text will do."""
        if MARK in text or (self.own and any(p in text for p in self.own)):
            return None
        text = self.normalised(text)
        if MARK in text:
            return None
        if MARKER + MARKER in text:
            text = self._cut.sub(MARK, text)
        else:
            text = text.replace(MARKER, MARK + MARKER)
        return text.replace("\n", MARK + "\n") if self.cuts_lines else text

    def _encode(self, new: set[str], known: dict[str, bytes]) -> None:
        """Add new parts to the known ones; each is encoded for itself, all in a call."""
        split = {}
        whole = set()
        for part in new:
            letters = part.rstrip(MARKS) if self.cuts_marks else part
            if len(letters) < len(part) and letters[-1:].isalpha():
                split[part] = letters, part[len(letters) :]
                whole.update(split[part])
            else:
                whole.add(part)
        ordered = sorted(whole.difference(known))
        for part, found in zip(ordered, self.bare.encode_batch_fast(ordered, add_special_tokens=False)):
            known[part] = array("I", found.ids).tobytes()
        for part, (letters, marks) in split.items():
            known[part] = known[letters] + known[marks]

    def decode(self, packed: list[bytes]) -> list[str]:
        """The texts of packed IDs."""
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        if not len(ids):
            return [""] * len(packed)
        _, ends, spelled = self.spelled.take(pa.array(ids)).buffers()
        ends = np.frombuffer(ends, dtype=np.int64)
        cuts = ends[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
        raw, blank = spelled.to_pybytes(), self.spec.dummy_prefix
        texts = []
        for own, begin, end in zip(packed, cuts, cuts[1:]):
            begin += blank and raw[begin : min(begin + 1, end)] == b" "
            try:
                texts.append(raw[begin:end].decode())
            except UnicodeDecodeError:
                own_ids = np.frombuffer(own, dtype="<u4").tolist()
                texts.append(self.tokenizer.decode(own_ids, skip_special_tokens=False))
        return texts


_OPEN: dict[str, tuple[PieceEncoder, sentencepiece.SentencePieceProcessor]] = {}


def opened(path: str) -> tuple[PieceEncoder, sentencepiece.SentencePieceProcessor]:
    """This worker's encoder for a model file, and the library it is checked against."""
    if path not in _OPEN:
        with open(path, "rb") as stream:
            raw = stream.read()
        _OPEN[path] = PieceEncoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    return _OPEN[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits) and the checks of every text.

    parity: the sentencepiece library gives the same IDs. round_trip: decoding gives the
    normalised text back. Null texts are empty and have no ID. Repeated rows and IDs are
    texts of their own; other columns are not read; an empty table gives an empty result.
    model_path is a file that every executor has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, library = opened(model_path)
        for batch in batches:
            texts = batch["body"].tolist()
            packed = encoder.encode(texts)
            # Lists of numbers are large: the library goes text by text.
            parity = [array("I", library.encode(t)).tobytes() == p for t, p in zip(texts, packed)]
            decoded = encoder.decode(packed)
            plain = encoder.plain
            trip = [
                d == (t if plain else _unmarked(encoder.normalised(t), encoder.spec))
                for d, t in zip(decoded, texts)
            ]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "ids": packed,
                    "parity": parity,
                    "round_trip": trip,
                }
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body")
    ).mapInPandas(run, "doc_id long, ids binary, parity boolean, round_trip boolean")


def _unmarked(text: str, spec: Spec) -> str:
    text = text.replace(MARKER, " ")
    return text[1:] if spec.dummy_prefix and text[:1] == " " else text


def digests(encoded: DataFrame) -> DataFrame:
    """Encoded documents with count and checksum in place of the IDs."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        "parity",
        "round_trip",
    )


def checksum(ids: list[int]) -> int:
    """crc32 of IDs outside Spark."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
