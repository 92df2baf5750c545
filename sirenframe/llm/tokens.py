"""Token IDs of whole texts by the tokenizers library, with the pieces of a text cached.

Both vocabularies split a text into pieces before they merge bytes, and no piece
reaches over a blank that stands before a visible character, nor over the end of a line
behind one. So a text is cut there, and every distinct piece goes through the library
once per worker, many in one call; the cache is bounded and holds nothing but the
library's own results.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from sirenframe.llm.piece_cache import MARK, PieceCache  # noqa: E402

CACHE_PIECES = 600_000
CALL_PIECES = 512
END_ID = 0

_BLANK_BEFORE_BLANK = re.compile(r" \s")
_BLANK_BEFORE_BREAK = re.compile(r"\s\n")
_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n)")
# Marks that neither vocabulary joins with a letter before them (an apostrophe it may).
_MARKS = ".,;:!?#$%&*|"
# Letters of one code point in any case; dotted I is two when lowered, and its dot takes marks.
_LETTER = re.compile(r"[a-zA-ZÀ-ÖØ-öø-įı-ɏ]")
# From here on a character may be composed with the letter before it.
_COMPOSING = re.compile(r"[\u0300-\U0010ffff]")


class TextEncoder:
    """Encodes whole texts; ids() is what the library gives for the text in one call."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = PieceCache(self._encode, cache_pieces)
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        self.stop_id, stop = max(special.items())
        self.stop = stop.content
        normaliser = self.tokenizer.normalizer
        self.lowers = normaliser is not None and normaliser.normalize_str("A") == "a"

    def ids(self, text: str) -> bytes:
        """IDs as little-endian unsigned 32-bit numbers."""
        return next(self.all_ids([text]))

    def all_ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """ids() of each text, in order; what is new in all of them is encoded together."""
        texts = list(texts)
        marked = [self._marked(t) for t in texts]
        together = iter(self.cache.joined([m for m in marked if m is not None]))
        for text, pieces in zip(texts, marked):
            if pieces is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield np.array(ids, dtype="<u4").tobytes()
            else:
                yield next(together)

    def _marked(self, text: str) -> str | None:
        """The text with a mark between its pieces, or None where only the whole text will do."""
        if self.lowers and not _COMPOSING.search(text):
            # Of bytes, only A-Z are lowered.
            lowered = text.encode().lower().decode()
        else:
            lowered = text
        # A special token is read as it is written, so lowering must not make one.
        if MARK in text or any(s in lowered or s in text for s in self.special):
            return None
        if _BLANK_BEFORE_BLANK.search(lowered) or ("\n" in lowered and _BLANK_BEFORE_BREAK.search(lowered)):
            return _CUT.sub(MARK, lowered)
        return lowered.replace(" ", MARK + " ").replace("\n", MARK + "\n")

    def _encode(self, new: set[str], known: dict[str, bytes]) -> None:
        """Add new pieces to the known ones; the library encodes each for itself, many in a call."""
        split = {}
        whole = set()
        for piece in new:
            letters = piece.rstrip(_MARKS)
            if len(letters) < len(piece) and _LETTER.match(letters[-1:]):
                split[piece] = letters, piece[len(letters) :]
                whole.update(split[piece])
            else:
                whole.add(piece)
        for some in _portions(sorted(whole.difference(known)), CALL_PIECES):
            # A special token between pieces keeps them apart and marks the places.
            text = self.stop.join(some)
            ids = np.array(
                self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"
            )
            stops = (np.flatnonzero(ids == self.stop_id) * 4).tolist()
            packed = ids.tobytes()
            for piece, begin, end in zip(some, [0, *(at + 4 for at in stops)], [*stops, len(packed)]):
                known[piece] = packed[begin:end]
        for piece, (letters, marks) in split.items():
            known[piece] = known[letters] + known[marks]


def _portions(items: list[str], size: int) -> Iterator[list[str]]:
    for begin in range(0, len(items), size):
        yield items[begin : begin + size]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
