"""SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are dealt to shards by a vantage-point tree over Hamming
distance, built from a bounded sample. Two fingerprints at distance 2 have a midpoint
within distance 1 of both; so each is sent to every shard that its ball of radius 1
may touch by the triangle bound, and the shard of the midpoint sees both. Inside a
shard the same splitting goes on down to small leaves, which are compared in full.
A leaf that no vantage point splits is searched through the one-bit neighbours of its
members, which is linear. Shards return spanning links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenframe.llm.common import numbered, only_rows, staged, text_of
from sirenframe.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
SAMPLE = 8192
SHARD_SIZE = 16384
LEAF_SIZE = 256
TRIES = 8
HASH_BLOCK = 1 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str) -> int:
    """64-bit SimHash of a text, unsigned; 0 without words.

    Bytes lower() and split() touch exactly A-Z and the six ASCII blanks.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return _hash(b" ".join(words))
    n = len(words) - SHINGLE_WORDS + 1
    counts = np.zeros((8, 8), dtype=np.int64)
    for begin in range(0, n, HASH_BLOCK):
        part = words[begin : begin + HASH_BLOCK + SHINGLE_WORDS - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE_WORDS))))
        counts += _bit_counts(np.fromiter(map(_hash, shingles), dtype="<u8"))
    return _majority(counts, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, by byte."""
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.stack([np.bincount(lanes[:, lane], minlength=256) @ _BITS for lane in range(8)])


def _majority(counts: np.ndarray, n: int) -> int:
    bits = (counts * 2 > n).reshape(64)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of a text whose shingles have these hashes, unsigned."""
    return _majority(_bit_counts(hashes), len(hashes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row_no, doc_id, print): the fingerprint as a signed long, one row per input row."""
    row_no = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(
        row_no.alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.fromiter(map(fingerprint, batch["body"]), dtype=np.uint64, count=len(batch))
            yield batch[["row_no", "doc_id"]].assign(print=prints.view(np.int64))

    # Int64 keeps null IDs apart from whole numbers.
    typed = partial(_with_nullable_ids, run)
    return rows.mapInPandas(typed, "row_no long, doc_id long, print long")


def _with_nullable_ids(run, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return run(b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    shard_size: int = SHARD_SIZE,
    leaf_size: int = LEAF_SIZE,
) -> DataFrame:
    """One row per input row: row_no, doc_id, fingerprint (16 hex digits), component_id, keep_row.

    Fingerprints link at two or fewer differing bits; component_id is the smallest ID in
    the component (null only if all its IDs are), keep_row the number of the row with
    that ID, the first such row on ties. Null texts count as empty; texts without words have fingerprint 0 and are
    linked like any other. Repeated rows and IDs are rows of their own, other columns
    are not read, an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col, row_col), "prints")
    first = F.min(
        F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row_no"))
    ).alias("first")
    nodes = staged(prints.groupBy("print").agg(first), "nodes")
    members = connected_components(_links(nodes.select("print"), shard_size, leaf_size))
    linked = staged(
        nodes.join(members, nodes["print"] == members["node"], "left").select(
            "print", "first", F.coalesce("component", "print").alias("root")
        ),
        "roots",
    )
    roots = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = staged(linked.join(roots, "root").select("print", "least"), "classes")
    return prints.join(classes, "print").select(
        "row_no",
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"),
        F.col("least.row_no").alias("keep_row"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the smallest ID; all columns as they are."""
    keyed, row_col = numbered(docs, "docs")
    out = simhash_components(keyed, id_col, text_col, row_col)
    kept = out.filter("row_no = keep_row").select(F.col("row_no").alias(row_col))
    return only_rows(keyed, row_col, kept)


def close_pairs(
    prints: DataFrame, shard_size: int = SHARD_SIZE, leaf_size: int = LEAF_SIZE
) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of rows (row_no, print) within MAX_BITS; the staged table they are made of.

    Not all pairs: each row with the first row of its fingerprint, and first rows of
    different fingerprints, as many as join all that is linked.
    """
    nodes = staged(prints.groupBy("print").agg(F.min("row_no").alias("first")), "nodes")
    equal = prints.join(nodes, "print").filter("row_no <> first").select(
        F.col("first").alias("a"), F.col("row_no").alias("b")
    )
    links = _links(nodes.select("print"), shard_size, leaf_size)
    for end in ("a", "b"):
        rows = nodes.select(F.col("print").alias(end), F.col("first").alias(f"row_{end}"))
        links = links.join(rows, end)
    close = links.select(
        F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")
    )
    return equal.unionByName(close), nodes


def _links(nodes: DataFrame, shard_size: int, leaf_size: int) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints within MAX_BITS."""
    total = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / shard_size)))
    # A bounded sample, the same on every run, places the vantage points.
    sample = nodes.orderBy(F.xxhash64("print"), "print").limit(SAMPLE).collect()
    tree = _grow(np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, found in _route(tree, batch["print"].to_numpy(np.int64).view(np.uint64), 1):
                yield pd.DataFrame({"shard": shard, "print": found.view(np.int64)})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        prints = shard["print"].to_numpy(np.int64).view(np.uint64)
        return spanning_links(prints, leaf_size)

    return (
        nodes.mapInPandas(deal, "shard long, print long")
        .groupBy("shard")
        .applyInPandas(search, "a long, b long")
    )


def _distance(prints: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ vantage).astype(np.int16)


def _grow(sample: np.ndarray, depth: int):
    """Nested (vantage, threshold, near, far); None is a shard."""
    if depth == 0 or len(sample) < 2:
        return None
    vantage = sample[0]
    distance = _distance(sample, vantage)
    threshold = int(np.median(distance))
    near = distance <= threshold
    if near.all():
        threshold -= 1
        near = distance <= threshold
    return vantage, threshold, _grow(sample[near][1:], depth - 1), _grow(sample[~near], depth - 1)


def _route(tree, prints: np.ndarray, radius: int, shard: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Shards that the balls of this radius may touch, with the fingerprints sent there."""
    if not len(prints):
        return
    if tree is None:
        yield shard, prints
        return
    vantage, threshold, near, far = tree
    distance = _distance(prints, vantage)
    yield from _route(near, prints[distance - radius <= threshold], radius, 2 * shard)
    yield from _route(far, prints[distance + radius > threshold], radius, 2 * shard + 1)


def spanning_links(prints: np.ndarray, leaf_size: int = LEAF_SIZE) -> pd.DataFrame:
    """Pairs within MAX_BITS that join all such pairs, fewer than fingerprints."""
    prints = np.unique(prints)
    pending = [np.arange(len(prints))]
    left, right = [], []
    while pending:
        part = pending.pop()
        if len(part) <= leaf_size:
            found = _leaf_links(prints, part)
        else:
            halves = _halves(prints, part)
            if halves:
                pending += halves
                continue
            found = _dense_links(prints, part)
        left.append(found[0])
        right.append(found[1])
    a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
    b = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
    kept = _forest(len(prints), a, b)
    signed = prints.view(np.int64)
    return pd.DataFrame({"a": signed[a[kept]], "b": signed[b[kept]]})


def _halves(prints: np.ndarray, part: np.ndarray) -> list[np.ndarray] | None:
    """Two overlapping halves of a part, or None if no vantage point tried splits it well."""
    for i in range(TRIES):
        distance = _distance(prints[part], prints[part[(i * 7919) % len(part)]])
        threshold = int(np.median(distance))
        near, far = part[distance - 1 <= threshold], part[distance + 1 > threshold]
        if max(len(near), len(far)) <= 0.8 * len(part):
            return [near, far]
    return None


def _leaf_links(prints: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = prints[part]
    close = np.bitwise_count(own[:, None] ^ own[None, :]) <= MAX_BITS
    i, j = np.nonzero(np.triu(close, 1))
    if len(i) > len(part):  # a dense leaf: keep a spanning set only
        kept = _forest(len(part), i, j)
        i, j = i[kept], j[kept]
    return part[i], part[j]


def _dense_links(prints: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints within two bits share themselves or a one-bit neighbour: group by those."""
    own = prints[part]
    flips = np.concatenate([np.zeros(1, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    keys = (own[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], part[order // len(flips)]
    same = keys[1:] == keys[:-1]
    return who[1:][same], who[:-1][same]


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b are enough to join all that they join."""
    label, kept = np.arange(size), np.zeros(len(a), dtype=bool)
    while True:
        apart = np.flatnonzero(label[a] != label[b])
        if not len(apart):
            return np.flatnonzero(kept)
        # Each part takes its first link to another one, so no circle is closed.
        first = np.full(size, len(a))
        np.minimum.at(first, label[a[apart]], apart)
        np.minimum.at(first, label[b[apart]], apart)
        taken = np.unique(first[first < len(a)])
        kept[taken] = True
        label = _least_labels(label, a[taken], b[taken])


def _least_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position each position is joined to through the links a-b."""
    label = label.copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label
