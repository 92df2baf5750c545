"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (at clause marks too, so that a passage set into a host
sentence loses little), and from every sentence on the shortest run of consecutive
sentences with enough characters is hashed; one more run reaches to the end of the
text. With both_ends the shortest run up to every sentence is hashed too, so a repeated
passage inside a text goes with its last sentences. All runs meet in one global grouping by hash. A run that is not the first with
its hash is repeated, and the sentences it covers go.

Repeats inside one block of documents are settled in the task that reads it, so a
hash arrives at most once per block, however common the passage is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenframe.llm.common import free_name, staged, text_of

SPAN_CHARS = 120
# Runs remembered before a block of documents ends; bounds the memory of a task.
BLOCK_RUNS = 300_000

_BREAK = re.compile(r"(?<=[.!?;:,…])\s+|(?<=[。！？；：，])\s*|\s*\n\s*")
_MASK = (1 << 64) - 1
SPANS = "h1 long, h2 int, row_no long, first int, last int, settled boolean"


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, next) of every sentence: its own characters end at end, the gap at next."""
    out, at = [], 0
    for gap in _BREAK.finditer(text):
        if gap.end() == at:
            continue
        out.append((at, gap.start(), gap.end()))
        at = gap.end()
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def runs(text: str, span_chars: int = SPAN_CHARS, both_ends: bool = False) -> list[tuple[int, int, int]]:
    """(hash, first, last) of every run of sentences that is hashed, hash of 128 bits.

    Blanks do not count, and any white space inside a sentence equals one blank. A text
    with fewer characters than span_chars has no run. The shortest run from every sentence
    on and the one at the end of the text; with both_ends the shortest up to every sentence.
    """
    units = ["".join(text[b:e]) for b, e, _ in sentences(text)]
    units = [" ".join(u.split()) for u in units]
    sizes = [len(u) - u.count(" ") for u in units]
    n, out = len(units), []
    last, size = -1, 0
    for first in range(n):
        while size < span_chars and last + 1 < n:
            last += 1
            size += sizes[last]
        if size < span_chars:
            break
        out.append((first, last))
        size -= sizes[first]
    if both_ends:
        ending, first, size = set(), 0, 0
        for last in range(n):
            size += sizes[last]
            while size - sizes[first] >= span_chars:
                size -= sizes[first]
                first += 1
            if size >= span_chars:
                ending.add((first, last))
        out = sorted(ending.union(out))
    elif out and out[-1][1] < n - 1:
        first, size = n, 0
        while size < span_chars:
            first -= 1
            size += sizes[first]
        out.append((first, n - 1))
    return [
        (xxhash.xxh3_128_intdigest("\n".join(units[a : b + 1]).encode("utf-8")), a, b) for a, b in out
    ]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [first, last] joined where they touch or overlap, in order."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences in these ranges and the gaps behind them; how many went."""
    places = sentences(text)
    kept, at, gone = [], 0, 0
    for first, last in merged(spans):
        kept.append(text[at : places[first][0]])
        at = places[last][2]
        gone += last - first + 1
    kept.append(text[at:])
    return "".join(kept), gone


def substring_dedup(
    docs: DataFrame,
    text_col: str = "text",
    span_chars: int = SPAN_CHARS,
    block_runs: int = BLOCK_RUNS,
    both_ends: bool = False,
) -> DataFrame:
    """docs with the text cleaned, and n_sentences_removed added under a free name.

    Of equal runs of sentences one stays: the first in the order in which the table is
    read. Repeats within a document go too. A text without repeated runs stays as it is,
    to the character; null stays null. Repeated rows are documents of their own, so all
    but one copy lose their text, except what is shorter than span_chars. Other columns
    stay. An empty table gives an empty result.
    """
    row_no = free_name(docs, "row_no")
    keyed = staged(docs.withColumn(row_no, F.monotonically_increasing_id()), "docs")
    gone = free_name(docs, "n_sentences_removed")
    bodies = keyed.select(F.col(row_no).alias("row_no"), text_of(F.col(text_col)).alias("body"))

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            found, rows = [], []
            for row, body in zip(batch["row_no"], batch["body"]):
                if len(seen) > block_runs:
                    seen.clear()
                repeated = []
                for value, first, last in runs(body, span_chars, both_ends):
                    if value in seen:
                        repeated.append((first, last))
                    else:
                        seen.add(value)
                        found.append((value, row, first, last))
                # A hash of its own spreads what is settled over all tasks.
                rows += [(row, a, b) for a, b in merged(repeated)]
            yield _frame(found, rows)

    each = Window.partitionBy("h1", "h2")
    spans = bodies.mapInPandas(collect, SPANS)
    repeated = spans.withColumn("least", F.min("row_no").over(each)).filter(
        "settled OR row_no > least"
    )
    covered = repeated.groupBy("row_no").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")
    )
    spans_col, cut_col = free_name(docs, "spans"), free_name(docs, "cut")
    joined = keyed.join(
        covered.select(F.col("row_no").alias(row_no), F.col("spans").alias(spans_col)), row_no, "left"
    )
    cut = F.pandas_udf(_cut, "text string, gone int")
    # Texts without repeats do not go through Python.
    touched = F.when(F.col(spans_col).isNotNull(), text_of(F.col(text_col)))
    out = joined.withColumn(cut_col, cut(touched, F.col(spans_col)))
    return out.select(
        *(
            F.coalesce(F.col(f"{cut_col}.text"), F.col(text_col)).alias(c)
            if c.lower() == text_col.lower()
            else F.col(f"`{c}`")
            for c in docs.columns
        ),
        F.coalesce(F.col(f"{cut_col}.gone"), F.lit(0)).alias(gone),
    )


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with cleaned texts and the same columns; n_chars, if there, fits the new text."""
    out = substring_dedup(docs, text_col, both_ends=True)
    out = out.select(*(f"`{c}`" for c in docs.columns))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.length(text_col).cast(kind)
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(length))
    return out


def _frame(found: list, settled: list) -> pd.DataFrame:
    values = [f[0] for f in found]
    low = np.fromiter((v & _MASK for v in values), dtype=np.uint64, count=len(values)).view(np.int64)
    high = np.fromiter((v >> 64 & 0xFFFFFFFF for v in values), dtype=np.uint32, count=len(values)).view(np.int32)
    own = np.fromiter(
        (hash((row, a)) & _MASK for row, a, _ in settled), dtype=np.uint64, count=len(settled)
    ).view(np.int64)
    return pd.DataFrame(
        {
            "h1": np.concatenate([low, own]),
            "h2": np.concatenate([high, np.zeros(len(settled), dtype=np.int32)]),
            "row_no": [f[1] for f in found] + [s[0] for s in settled],
            "first": [f[2] for f in found] + [s[1] for s in settled],
            "last": [f[3] for f in found] + [s[2] for s in settled],
            "settled": [False] * len(found) + [True] * len(settled),
        }
    ).astype({"row_no": "int64", "first": "int32", "last": "int32", "settled": "bool"})


def _cut(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None)
        if body is None
        else without(body, [(s["first"], s["last"]) for s in found])
        for body, found in zip(bodies, spans)
    ]
    return pd.DataFrame(rows, columns=["text", "gone"]).astype({"gone": "Int32"})


_cut.__annotations__ = {"bodies": pd.Series, "spans": pd.Series, "return": pd.DataFrame}
