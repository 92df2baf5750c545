"""Best-fit packing, certified by dual-feasible-function bounds.

Pieces are dealt to partitions of bounded size; each is packed by best-fit decreasing
and compared with a lower bound on its bins. Bins that are not full go from partitions
with a gap into a pool (from certified partitions only the emptiest one, as two
optimal partitions may still share a bin), the pool is dealt anew so that partitions
exchange documents, and best-fit decreasing runs again. A repacking counts only if it
saves bins. It ends when the total meets the bound of all pieces together, or when
nothing is saved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenframe.llm.common import staged, text_of
from sirenframe.llm.tokens import END_ID, encoder

CAPACITY = 2048
GROUP_ITEMS = 100_000
STEPS = 24
# A bin number holds its round, its group and its place in the group.
ROUND_BIT = 46
GROUP_BIT = 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's IDs with the end ID, cut at capacity."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).all_ids
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].astype("Int64"), encode(batch["body"].tolist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body")
    ).mapInPandas(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that pieces need at least; counts[n] pieces have length n.

    The best of three families of dual feasible functions: the identity, "over
    capacity - k counts as full, under k as nothing", and rounding to steps of 1/k.
    """
    sizes = np.arange(len(counts))
    best = -(-int(counts @ sizes) // capacity)
    for k in range(1, capacity // 2 + 1):
        full = counts[capacity - k + 1 :].sum()
        between = counts[k : capacity - k + 1] @ sizes[k : capacity - k + 1]
        best = max(best, int(full) + -(-int(between) // capacity))
    for k in range(1, STEPS + 1):
        # In units of capacity / k, doubled products keep whole numbers.
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # value * k * capacity: exact multiples keep sizes * k, others floor * capacity.
        value = np.where(whole, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, bins numbered from 0."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has exactly r left
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            room, chosen, made = capacity, made, made + 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - size
        if left:
            open_bins[left].append(chosen)
            free |= 1 << left
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pieces with sequence_id and offset added: gapless from 0 in every sequence.

    Lengths are from 1 to capacity. Equal pieces are pieces of their own. An empty table
    gives an empty result.
    """
    items = staged(pieces.withColumn("item_no", F.monotonically_increasing_id()), "pieces")
    full = items.filter(F.col("length") >= capacity).select(
        "item_no", (-F.col("item_no") - 1).alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    rest = items.filter(F.col("length") < capacity).select("item_no", "length")
    placed = _packed(rest, capacity, group_items).select("item_no", "bin", "offset")
    names = full.unionByName(placed)
    return items.join(names, "item_no").select(
        *pieces.columns, F.col("bin").alias("sequence_id"), "offset"
    )


def bounds(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The bound for all pieces together, from their length counts (at most capacity rows)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    return lower_bound(counts, capacity)


_PLACED = "item_no long, length long, bin long, offset long, fill long, grp long, bound long"


def _packed(rest: DataFrame, capacity: int, group_items: int) -> DataFrame:
    bound = bounds(rest, capacity)
    groups = max(1, -(-rest.count() // group_items))
    dealt = rest.select(
        "item_no",
        "length",
        F.lit(0).cast("long").alias("bin"),
        F.lit(0).cast("long").alias("offset"),
        F.pmod(F.xxhash64("item_no"), F.lit(groups)).alias("grp"),
    )
    state = staged(_repack(dealt, 0, capacity), "packed")
    total = _bins(state)
    round_no = 0
    # Until the bound is met or a round saves nothing.
    while total > bound:
        round_no += 1
        chosen = staged(_released(state, capacity), "released")
        size = chosen.agg(F.sum("n")).first()[0] or 0
        groups = max(1, -(-size // group_items))
        pool = state.join(chosen.select("bin"), "bin").withColumn(
            "grp", F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(groups))
        )
        kept = state.join(chosen.select("bin"), "bin", "left_anti")
        state = staged(kept.unionByName(_repack(pool, round_no, capacity)), "packed")
        before, total = total, _bins(state)
        if total >= before:
            break
    return state


def _bins(state: DataFrame) -> int:
    return state.filter(F.col("offset") == 0).count()


def _released(state: DataFrame, capacity: int) -> DataFrame:
    """(bin, n pieces) of the bins that take part in the exchange."""
    bins = state.groupBy("bin", "grp").agg(
        F.first("fill").alias("fill"), F.first("bound").alias("bound"), F.count("*").alias("n")
    )
    gaps = bins.groupBy("grp").agg(
        F.count("*").alias("used"),
        F.min(F.struct("fill", "bin")).alias("emptiest"),
    )
    gap = F.col("used") > F.col("bound")
    return (
        bins.join(gaps, "grp")
        .filter((gap & (F.col("fill") < capacity)) | (F.col("bin") == F.col("emptiest.bin")))
        .select("bin", "n")
    )


def _repack(dealt: DataFrame, round_no: int, capacity: int) -> DataFrame:
    """Pack each group; keep what it had if that has no more bins."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        grp = int(group["grp"].iloc[0])
        lengths = group["length"].to_numpy(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        names = bins + (round_no << ROUND_BIT) + (grp << GROUP_BIT)
        if round_no and bins.max() + 1 >= group["bin"].nunique():
            names, offsets = group["bin"].to_numpy(), group["offset"].to_numpy()
        out = pd.DataFrame(
            {"item_no": group["item_no"].to_numpy(), "length": lengths, "bin": names, "offset": offsets}
        )
        out["fill"] = out.groupby("bin")["length"].transform("sum")
        # Groups of different rounds must not be taken for one.
        return out.assign(grp=(round_no << ROUND_BIT) + grp, bound=bound)

    return dealt.groupBy("grp").applyInPandas(run, _PLACED)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document.

    Null texts are empty and have the end ID only. Repeated rows and IDs, null IDs among
    them, are packed as documents of their own. Other columns are not read. An empty
    table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity, group_items)
