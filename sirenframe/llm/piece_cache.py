"""IDs of texts put together of the IDs of their pieces, each distinct piece encoded once.

A batch of texts comes with a mark between pieces. Arrow cuts it there, names the
distinct pieces, and lays out the IDs; only distinct pieces are looked up one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Stands between pieces; a text that has it itself is not for this cache.
MARK = "\x00"


class PieceCache:
    """The IDs of pieces (little-endian unsigned 32-bit numbers), in two generations.

    encode adds pieces to the dictionary it is given; it gets those in neither generation.
    """

    def __init__(self, encode: Callable[[set[str], dict[str, bytes]], None], limit: int):
        self.encode, self.limit = encode, limit
        # Pieces used lately, and those of the generation before.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, marked: list[str]) -> list[bytes]:
        """IDs of each text."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        if not marked:
            return []
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), MARK)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = pa.array(self._found(names), pa.large_binary()).take(coded.indices)
        _, ends, packed = values.buffers()
        ends = np.frombuffer(ends, dtype=np.int64, count=len(values) + 1, offset=8 * values.offset)
        cuts = ends[lists.offsets.to_numpy()].tolist()
        raw = memoryview(packed) if packed else b""
        return [bytes(raw[begin:end]) for begin, end in zip(cuts, cuts[1:])]

    def _found(self, names: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, names))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = set()
        for name in map(names.__getitem__, missing):
            if name in old:
                young[name] = old[name]
            else:
                new.add(name)
        self.encode(new, young)
        for i in missing:
            found[i] = young[names[i]]
        return found
