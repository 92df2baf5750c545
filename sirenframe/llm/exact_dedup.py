"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of fixed size. Every distinct block gets an
integer name: blocks are sorted by a 128-bit hash and numbered, and the names count
only once it is shown that no two blocks share a hash; else another seed is tried.
Then adjacent names are paired, every distinct pair gets a name in turn, and so on
until each document has one name. Two documents share level and name only if they
are equal, with certainty.

Blocks are shuffled once; all later rounds move integers, half as many each. Copies
of a block meet map-side, so a hot block is one row per task; joins read written
tables on both sides, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.llm.common import numbered, only_rows, staged, text_of

BLOCK_CHARS = 2048
WHITE_SPACE = " \t\n\x0b\x0c\r"
NO_NAME = -1

BlockHash = Callable[[Column, int], Column]


def seeded_hash(block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), block)


def normalised(text: Column) -> Column:
    """Text without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.translate(text_of(text), WHITE_SPACE, "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    block_chars: int = BLOCK_CHARS,
    block_hash: BlockHash = seeded_hash,
) -> DataFrame:
    """One row per input row: row_no, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so without white space. Of equal texts the row with the
    most characters in the original stays, then the smallest ID, then the first row.
    Null texts count as empty, and all empty texts are equal. A null ID comes after all
    others; repeated rows and IDs are rows of their own. Other columns are not read. An
    empty table gives an empty result. With row_col, docs must be a written table with
    that unique whole number; else rows are numbered here.
    """
    row_no = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    keyed = docs.select(
        row_no.alias("row_no"),
        F.col(id_col).alias("doc_id"),
        F.length(text_of(F.col(text_col))).alias("n_chars"),
        normalised(F.col(text_col)).alias("body"),
    )
    if row_col is None:
        # The numbers are made once. Of a written table no second copy is kept.
        keyed = staged(keyed, "texts")
    identity = _identities(keyed, block_chars, block_hash)
    meta = keyed.select("row_no", "doc_id", "n_chars", F.sha2("body", 256).alias("text_sha256"))
    members = staged(meta.join(identity, "row_no"), "members")
    order = F.struct(
        (-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "row_no"
    )
    groups = staged(
        members.groupBy("level", "name").agg(
            F.min(order).alias("first"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    return members.join(groups, ["level", "name"]).select(
        "row_no",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are."""
    keyed, row_col = numbered(docs, "docs")
    kept = exact_dedup(keyed, id_col, text_col, row_col).filter("kept")
    return only_rows(keyed, row_col, kept.select(F.col("row_no").alias(row_col)))


def _identities(keyed: DataFrame, block_chars: int, block_hash: BlockHash) -> DataFrame:
    """(row_no, level, name): equal for equal bodies only."""
    pattern = F.lit(f"(?s).{{1,{block_chars}}}")
    # An empty body is one empty block.
    found = F.regexp_extract_all("body", pattern, F.lit(0))
    blocks = F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(found)
    names, seed = _block_names(keyed.select(F.explode(blocks).alias("block")), block_hash)
    placed = (
        keyed.select("row_no", blocks.alias("blocks"))
        .select("row_no", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .select(
            "row_no",
            "n",
            "pos",
            block_hash(F.col("block"), seed).alias("h1"),
            block_hash(F.col("block"), seed + 1).alias("h2"),
        )
    )
    current = staged(
        placed.join(names, ["h1", "h2"]).select("row_no", "n", "pos", "name"), "named"
    )
    longest = current.agg(F.max("n")).first()[0] or 0
    level = 0
    done = current.filter("n = 1").select("row_no", F.lit(level).alias("level"), "name")
    while longest > 1:
        pairs = staged(_pairs(current.filter("n > 1")), "pairs")
        current = staged(
            pairs.join(_pair_names(pairs), ["left", "right"]).select("row_no", "n", "pos", "name"),
            "named",
        )
        level += 1
        longest = -(-longest // 2)
        one = current.filter("n = 1").select("row_no", F.lit(level).alias("level"), "name")
        done = done.unionByName(one)
    return done


def _block_names(blocks: DataFrame, block_hash: BlockHash) -> tuple[DataFrame, int]:
    """(h1, h2, name) of all distinct blocks, and the seed under which that is one to one."""
    seed = 0
    while True:
        hashed = blocks.select(
            block_hash(F.col("block"), seed).alias("h1"),
            block_hash(F.col("block"), seed + 1).alias("h2"),
            "block",
        )
        classes = hashed.groupBy("h1", "h2").agg(F.collect_set("block").alias("same"))
        names = staged(
            classes.select("h1", "h2", (F.size("same") > 1).alias("shared"))
            .sortWithinPartitions("h1", "h2")
            .withColumn("name", F.monotonically_increasing_id()),
            "block-names",
        )
        if names.filter("shared").isEmpty():
            return names.drop("shared"), seed
        seed += 2


def _pairs(current: DataFrame) -> DataFrame:
    """Names at 2i and 2i+1 side by side; the last of an odd row has no partner."""
    even = F.col("pos") % 2 == 0
    return (
        current.groupBy(
            "row_no",
            F.ceil(F.col("n") / 2).cast("int").alias("n"),
            F.expr("pos div 2").cast("int").alias("pos"),
        )
        .agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_NAME)).alias("right"),
        )
    )


def _pair_names(pairs: DataFrame) -> DataFrame:
    return staged(
        pairs.select("left", "right")
        .distinct()
        .sortWithinPartitions("left", "right")
        .withColumn("name", F.monotonically_increasing_id()),
        "pair-names",
    )
