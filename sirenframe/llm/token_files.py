"""Token files with shuffled planes.

IDs are stored as unsigned 32-bit numbers in blocks of fixed size. A block is
transposed into byte planes (or bit planes), and each plane is compressed by
zstandard on its own; planes of the high bytes are nearly free. Layout of a shard:

    magic | planes of block 0 | planes of block 1 | ... | documents | index | tail

documents holds doc_id, null mark and token count of each document; index holds the
place of every plane; tail is the length of both and the magic again. A shard covers a
range of doc_id, and its file name is new for each attempt: only files whose rows got
into the manifest count, so a task may be repeated.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenframe import shared_dir
from sirenframe.llm.common import staged, text_of
from sirenframe.llm.tokens import END_ID, encoder

MAGIC = b"PLN1"
BLOCK_IDS = 65536
LEVEL = 3
ID_BYTES = 4
TAIL = struct.Struct("<QQ4s")
MANIFEST = "shard long, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit IDs, low plane first."""
    lanes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, ID_BYTES).T
    if not bits:
        return [lane.tobytes() for lane in lanes]
    return [np.packbits(lane >> b & 1).tobytes() for lane in lanes for b in range(8)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The IDs of to_planes()."""
    out = np.zeros((n, ID_BYTES), dtype=np.uint8)
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if bits:
            out[:, i // 8] |= np.unpackbits(raw, count=n) << (i % 8)
        else:
            out[:, i] = raw
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard to an open stream; holds one block of IDs and the document list."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: bool = False):
        self.stream, self.block_ids, self.bits = stream, block_ids, bits
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.pending = bytearray()
        self.index: list[list[int]] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []
        self.n_ids = 0
        self.at = stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Add a document; ids are packed 32-bit numbers."""
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids) // ID_BYTES)
        self.n_ids += len(ids) // ID_BYTES
        self.pending += ids
        size = self.block_ids * ID_BYTES
        whole = len(self.pending) // size * size
        for begin in range(0, whole, size):
            self._block(bytes(self.pending[begin : begin + size]))
        del self.pending[:whole]

    def _block(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, dtype="<u4")
        entry = [len(ids)]
        for plane in to_planes(ids, self.bits):
            packed = self.compress(plane)
            entry += [self.at, len(packed)]
            self.at += self.stream.write(packed)
        self.index.append(entry)

    def close(self) -> int:
        """Write the last block, documents and index; the length of the file."""
        if self.pending:
            self._block(bytes(self.pending))
        docs = self.compress(
            np.array(self.docs, dtype="<i8").tobytes()
            + np.array(self.nulls, dtype=np.uint8).tobytes()
            + np.array(self.lengths, dtype="<i8").tobytes()
        )
        meta = {"bits": self.bits, "docs": len(self.docs), "index": self.index}
        index = self.compress(json.dumps(meta).encode())
        for part in (docs, index, TAIL.pack(len(docs), len(index), MAGIC)):
            self.at += self.stream.write(part)
        return self.at


class ShardReader:
    """Reads a shard by ranges: the index first, then one block at a time."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        docs, index, magic = TAIL.unpack(self._range(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self._range(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file, or cut off")
        self.expand = zstandard.ZstdDecompressor().decompress
        begin = size - TAIL.size - index
        meta = json.loads(self.expand(self._range(begin, index)))
        self.bits, self.index = meta["bits"], meta["index"]
        raw = self.expand(self._range(begin - docs, docs)) if meta["docs"] else b""
        n = meta["docs"]
        self.docs = np.frombuffer(raw, dtype="<i8", count=n)
        self.nulls = np.frombuffer(raw, dtype=np.uint8, count=n, offset=8 * n).astype(bool)
        self.lengths = np.frombuffer(raw, dtype="<i8", count=n, offset=9 * n)

    def _range(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def block(self, i: int) -> np.ndarray:
        """IDs of block i alone."""
        n, *places = self.index[i]
        planes = [self.expand(self._range(at, size)) for at, size in zip(places[::2], places[1::2])]
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, Iterator[bytes]]]:
        """(doc_id, its IDs part by part) in file order; each document's parts must be read."""
        blocks = (self.block(i) for i in range(len(self.index)))
        rest = np.zeros(0, dtype="<u4")

        def parts(length: int) -> Iterator[bytes]:
            nonlocal rest
            while length:
                if not len(rest):
                    rest = next(blocks)
                taken, rest = rest[:length], rest[length:]
                length -= len(taken)
                yield taken.tobytes()

        for doc_id, null, length in zip(self.docs, self.nulls, self.lengths):
            yield (None if null else int(doc_id)), parts(int(length))


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    block_ids: int = BLOCK_IDS,
    bits: bool = False,
) -> DataFrame:
    """Write the IDs of all texts to folder in ascending doc_id order; returns the manifest.

    Each document ends with ID 0. Null texts are empty; a null ID comes first. Repeated
    rows and IDs are documents of their own; equal IDs are ordered by text hash, so even
    one ID with many texts is split over shards. Other columns are not read. An empty
    table gives an empty manifest. folder must be a place that all executors share.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body")
    )
    order = ["doc_id", F.xxhash64("body")]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).all_ids
        files, base = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.pln"
        writer = stream = None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                files.create_dir(base, recursive=True)
                stream = files.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(stream, block_ids, bits)
            every = encode(batch["body"].tolist())
            for doc_id, ids in zip(batch["doc_id"].astype("Int64"), every):
                writer.add(None if doc_id is pd.NA else int(doc_id), ids + end)
        if writer is not None:
            size = writer.close()
            stream.close()
            row = (shard, f"{folder}/{name}", len(writer.docs), writer.n_ids, size)
            yield pd.DataFrame([row], columns=["shard", "path", "n_docs", "n_ids", "n_bytes"])

    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return staged(ranged.mapInPandas(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard: the running sum is over a list as short as the list of files.
    shards = manifest.select(
        "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "shard"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_file(name) as stream:
                    reader = ShardReader(stream)
                    rows, at = [], int(start)
                    for doc_id, parts in reader.documents():
                        crc = n = 0
                        for part in parts:
                            crc = zlib.crc32(part, crc)
                            n += len(part) // ID_BYTES
                        rows.append((doc_id, at, n, crc))
                        at += n
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(n, "shard").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files under the shared root."""
    return shared_dir(spark, "tokens")
