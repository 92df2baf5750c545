"""Ranked lexical search of many queries at once, with shared parts evaluated once.

The terms of each document that any query holds are counted once and written out. The
queries are taken in blocks. In a block, terms that several queries hold are mined for
sets that they share: the pair of neighbours (in the order of how many queries hold
them) found most often becomes a node, nodes are paired again, until no pair is shared.
What comes out is a graph in which a query is the sum of a few nodes and a node the sum
of two others. A task evaluates the graph for some hundreds of documents at a time: a row
of partial scores (accumulators) per node, made once and used by all queries above it.
Only a task's best documents of each query leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sirenframe.llm.common import staged, text_of

TOP = 50
# Query terms of one block, counted once for each query that holds them.
BLOCK_TERMS = 1 << 15
# Above this number of distinct query terms they are not sent to the tasks that count.
SENT_TERMS = 1 << 18
# Bytes of partial scores that a task holds, and rows of candidates before they are thinned.
SCORE_BYTES = 32 << 20
HELD = 1 << 17
MERGES = 256

# A-Z in lower case; all other ASCII but letters and digits is a blank. Bytes from 0x80 on are parts of other characters.
_TERMS_ONLY = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text in order: ASCII letters (A-Z as a-z), digits and all that is not ASCII."""
    return text.encode("utf-8").translate(_TERMS_ONLY).split()


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
    sent_terms: int = SENT_TERMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, scores above 0 only.

    All texts are read whole. Null and empty texts have no terms: such documents count
    for nothing and such items return nothing. Equal scores go by doc_id (null last). Repeated
    rows are documents of their own, and items of their own with the same item_id. With
    an empty table on either side the result is empty. Other columns are not read.
    """
    queries = staged(_items(items, item_col, item_text_col), "search-items")
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    known = wanted.limit(sent_terms + 1).collect()
    # Few enough terms are sent to the tasks; else all terms of a document are kept.
    filter_ = None if len(known) > sent_terms else {bytes(r.term) for r in known}
    counted = staged(_counted(docs, id_col, text_col, filter_), "search-terms")
    sizes = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    in_queries = counted.select(F.explode("terms").alias("term"))
    if filter_ is None:
        in_queries = in_queries.join(wanted, "term", "left_semi")
    held = staged(in_queries.groupBy("term").agg(F.count("*").alias("df")), "search-held")
    blocks = _blocks(queries, held, block_terms)
    found = [_best(counted, block, sizes, top) for block in blocks]
    if not found:
        return counted.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = reduce(DataFrame.unionByName, found if len(found) == 1 else [staged(f, "search-block") for f in found])
    ids = queries.select("item_no", "item_id")
    return best.join(ids, "item_no").select("item_id", "rank", "doc_id", "score")


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_no, item_id, terms: distinct terms of each item that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["item_no", "item_id"]].assign(terms=[sorted(set(terms(t))) for t in batch["body"]])

    rows = items.select(
        F.monotonically_increasing_id().alias("item_no"),
        F.col(item_col).cast("long").alias("item_id"),
        text_of(F.col(text_col)).alias("body"),
    )
    found = rows.mapInPandas(_nullable("item_id", run), "item_no long, item_id long, terms array<binary>")
    return found.filter("size(terms) > 0")


def _nullable(column: str, run):
    """run() on batches in which the column keeps null IDs apart from whole numbers."""

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(b.assign(**{column: b[column].astype("Int64")}) for b in batches)

    return typed


def _counted(docs: DataFrame, id_col: str, text_col: str, wanted: set[bytes] | None) -> DataFrame:
    """doc_id, n (all terms), terms and times: wanted terms of each document and how often it has them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, held, times = [], [], []
            for body in batch["body"]:
                words = terms(body)
                lengths.append(len(words))
                if wanted is None:
                    own = Counter(words)
                else:
                    own = Counter(filter(wanted.__contains__, words))
                held.append(list(own.keys()))
                times.append(np.fromiter(own.values(), np.int64, len(own)))
            yield batch[["doc_id"]].assign(n=lengths, terms=held, times=times)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body"))
    return rows.mapInPandas(
        _nullable("doc_id", run), "doc_id long, n long, terms array<binary>, times array<long>"
    )


def _blocks(queries: DataFrame, held: DataFrame, block_terms: int) -> Iterator[list[Row]]:
    """Items by blocks, each row with item_no and its (term, df); a block is collected, never all items."""
    pairs = staged(
        queries.select("item_no", F.explode("terms").alias("term"))
        .join(held, "term")
        .groupBy("item_no")
        .agg(F.collect_list(F.struct("term", "df")).alias("terms")),
        "search-pairs",
    )
    total = pairs.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = max(1, math.ceil(total / block_terms))
    for k in range(count if total else 0):
        part = pairs.filter(F.pmod(F.xxhash64("item_no"), F.lit(count)) == k).orderBy("item_no")
        rows = part.collect()
        if rows:
            yield rows


class Plan:
    """The graph of one block: leaves are terms, inner nodes sums of two nodes, queries sums of nodes."""

    def __init__(self, block: list[Row], documents: int):
        freq = Counter(bytes(t.term) for row in block for t in row.terms)
        df = {bytes(t.term): t.df for row in block for t in row.terms}
        order = sorted(freq, key=lambda t: (-freq[t], t))
        self.leaf = {term: i for i, term in enumerate(order)}
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in order], dtype=np.int64
        )
        self.items = np.array([row.item_no for row in block], dtype=np.int64)
        sums = [sorted(self.leaf[bytes(t.term)] for t in row.terms) for row in block]
        self.pairs: list[tuple[int, int]] = []
        self._mine(sums)
        self.sums = [np.array(s, dtype=np.int64) for s in sums]
        self.nodes = len(order) + len(self.pairs)

    def _mine(self, sums: list[list[int]]) -> None:
        """Replace pairs that several queries hold by nodes, the commonest first, while there are any."""
        for _ in range(MERGES):
            seen = Counter(pair for own in sums for pair in zip(own, own[1:]))
            taken: dict[int, tuple[int, int]] = {}
            for pair, times in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
                if times < 2:
                    break
                if pair[0] not in taken and pair[1] not in taken:
                    taken[pair[0]] = taken[pair[1]] = pair
            if not taken:
                return
            node = {}
            for pair in dict.fromkeys(taken.values()):
                node[pair] = len(self.leaf) + len(self.pairs)
                self.pairs.append(pair)
            for own in sums:
                out, i = [], 0
                while i < len(own):
                    if tuple(own[i : i + 2]) in node:
                        out.append(node[own[i], own[i + 1]])
                        i += 2
                    else:
                        out.append(own[i])
                        i += 1
                own[:] = out

    def scores(self, doc: np.ndarray, leaf: np.ndarray, times: np.ndarray, measure: np.ndarray) -> np.ndarray:
        """Scores, a row per query and a column per document, from (document, leaf, times) triples."""
        acc = np.zeros((self.nodes, len(measure)), dtype=np.int64)
        acc[leaf, doc] = self.weights[leaf] * ((1_000_000_000 * times) // (1000 * times + 20 * measure[doc]))
        for at, (a, b) in enumerate(self.pairs, len(self.leaf)):
            np.add(acc[a], acc[b], out=acc[at])
        return np.stack([acc[own].sum(axis=0) for own in self.sums])


def _best(counted: DataFrame, block: list[Row], sizes: Row, top: int) -> DataFrame:
    """item_no, rank, doc_id, score of the best documents of each item of a block."""
    documents, words = sizes
    plan = Plan(block, documents)
    width = max(16, SCORE_BYTES // (8 * plan.nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(plan.items), top)
        for batch in batches:
            batch = batch[batch["n"] > 0]
            for begin in range(0, len(batch), width):
                some = batch.iloc[begin : begin + width]
                size = some["terms"].map(len).to_numpy(np.int64)
                doc = np.repeat(np.arange(len(some)), size)
                leaf = np.fromiter((plan.leaf.get(t, -1) for own in some["terms"] for t in own), np.int64, size.sum())
                times = np.concatenate([np.zeros(0, np.int64), *some["times"]])
                measure = np.array([50 + 50 * n * documents // words for n in some["n"].tolist()], dtype=np.int64)
                known = leaf >= 0
                best.add(some["doc_id"], plan.scores(doc[known], leaf[known], times[known], measure))
        item, ids, score = best.rows()
        yield pd.DataFrame({"item_no": plan.items[item], "doc_id": ids, "score": score}).assign(
            part=TaskContext.get().partitionId()
        )

    found = counted.mapInPandas(_nullable("doc_id", run), "item_no long, doc_id long, score long, part int")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Best of some hundred groups of tasks first, so that no task reads what all tasks found.
    first = Window.partitionBy("item_no", F.pmod("part", F.lit(256))).orderBy(*order)
    last = Window.partitionBy("item_no").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    return found.select("item_no", "rank", "doc_id", "score")


class _Best:
    """The best documents of each query met so far; ties go to the smaller ID, null last."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.least = np.ones(queries, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool), np.zeros(0, np.int64))]
        self.held = 0

    def add(self, ids: pd.Series, scores: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        none = ids.isna().to_numpy(bool)
        known = ids.fillna(0).to_numpy(np.int64)
        self.parts.append((item, known[doc], none[doc], scores[item, doc]))
        self.held += len(item)
        if self.held > HELD:
            self._thin()

    def _thin(self) -> None:
        item, ids, none, score = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((ids, none, -score, item))
        item, ids, none, score = item[order], ids[order], none[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        last = place == self.top - 1
        self.least[item[last]] = score[last]
        self.parts = [(item[keep], ids[keep], none[keep], score[keep])]
        self.held = int(keep.sum())

    def rows(self) -> tuple[np.ndarray, pd.Series, np.ndarray]:
        self._thin()
        item, ids, none, score = self.parts[0]
        return item, pd.Series(ids).astype("Int64").mask(none), score
