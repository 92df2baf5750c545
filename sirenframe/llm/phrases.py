"""Phrase collocation mining by the relational method SETM, in chunks of text.

The relation of occurrences is written out sorted by piece and position: a chunk of some
million words is one row, an array of word numbers in order in which every end of a piece takes a
place of its own, so that neighbours in the array are neighbours in a piece. Then, for
each length: occurrences are grouped and counted in each chunk, the counts of all chunks
are added up, groups that are frequent come back to their chunks, and a chunk keeps its
occurrences of frequent groups only (semi-join) before it merges them with those at the
next position. Spark moves one row per chunk and distinct group, never one per
occurrence, so the commonest word is as many rows as there are chunks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenframe.llm.common import staged, text_of

MIN_COUNT = 10
HIDDEN_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
NO_LANG = "und"
# Words of one chunk, and bytes of text that are cut into words at a time.
CHUNK_WORDS = 2_000_000
CUT_BYTES = 4 << 20
SENT_ROWS = 100_000

# 0xFF is in no UTF-8 text: it marks the end of a piece.
_END = 0xFF
_TO_WORDS = bytearray(bytes(range(256)).lower())
for _mark in b".,;:!?\n\x0b\x0c\r":
    _TO_WORDS[_mark] = _END
_TO_WORDS[0x09] = 0x20
_TO_WORDS = bytes(_TO_WORDS)
_MARK = bytes([_END])


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    hidden_percent: int = HIDDEN_PERCENT,
    top: int = TOP,
    chunk_words: int = CHUNK_WORDS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words per language.

    All counts are over whole texts of all rows. Null texts are empty, a null language
    is `und`, repeated rows count again, texts without words add nothing, an empty table
    gives an empty result. A piece stays in one chunk however long it is. Equal cuts of
    a phrase go to the first, equal phrases of a language by count, then by bytes. Other columns are not read.
    """
    first = staged(_occurrences(docs, text_col, lang_col, chunk_words), "phrase-words")
    one = staged(_frequent_words(first, min_count), "phrase-one")
    second = staged(_kept_words(first, one), "phrase-kept")
    two = staged(_frequent_pairs(second, min_count), "phrase-two")
    three = staged(_frequent_triples(second, two, min_count), "phrase-three")
    return _ranked(first, one, two, three, hidden_percent, top)


def _occurrences(docs: DataFrame, text_col: str, lang_col: str, chunk_words: int) -> DataFrame:
    """chunk, lang, n, seq (int32), words and counts of each chunk; words go by number from 1, 0 is the end of a piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # chunk + number of a word is a number that no other word of any chunk has.
        free = TaskContext.get().partitionId() << 40
        chunks: dict[str, _Chunk] = defaultdict(_Chunk)
        size = 0
        for batch in batches:
            for lang, body in zip(batch["lang"], batch["body"]):
                size += chunks[lang].add(body)
                if size >= chunk_words:
                    for name, full in chunks.items():
                        yield full.row(free, name)
                        free += len(full.numbers)
                    chunks.clear()
                    size = 0
        for name, rest in chunks.items():
            yield rest.row(free, name)
            free += len(rest.numbers)

    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
        text_of(F.col(text_col)).alias("body"),
    )
    schema = "chunk long, lang string, n long, seq binary, words array<string>, counts array<long>"
    return rows.mapInPandas(run, schema).filter("n > 0")


class _Chunk:
    """Words of one language as numbers, piece after piece."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_MARK]  # the first number, 0
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> int:
        """Append a text and return how many places it takes."""
        body = text.encode("utf-8").translate(_TO_WORDS)
        begin = places = 0
        while begin < len(body):
            # A very long text is cut at a space, which the relation does not show.
            cut = body.find(b" ", begin + CUT_BYTES)
            end = len(body) if cut < 0 else cut
            # The blanks of split() other than spaces are ends of pieces by now.
            found = body[begin:end].replace(_MARK, b" \xff ").split()
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
            places += len(found)
            begin = end
        self.parts.append(np.zeros(1, dtype=np.int32))
        return places + 1

    def row(self, chunk: int, lang: str) -> pd.DataFrame:
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.numbers))[1:]
        names = [word.decode("utf-8") for word in self.numbers if word != _MARK]
        return pd.DataFrame(
            {
                "chunk": [chunk],
                "lang": [lang],
                "n": [int(counts.sum())],
                "seq": [seq.tobytes()],
                "words": [names],
                "counts": [counts],
            }
        )


def _frequent_words(first: DataFrame, min_count: int) -> DataFrame:
    """chunk, lang, number, word, f, id of each chunk's frequent words; id is the least chunk + number of the word."""
    held = first.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "own")).select(
        "chunk", "lang", (F.col("at") + 1).alias("number"), F.col("own.words").alias("word"), F.col("own.counts").alias("c")
    )
    same = Window.partitionBy("lang", "word")
    totals = held.withColumn("f", F.sum("c").over(same)).filter(F.col("f") >= min_count)
    return totals.withColumn("id", F.min(F.col("chunk") + F.col("number")).over(same)).drop("c")


def _kept_words(first: DataFrame, one: DataFrame) -> DataFrame:
    """chunk, seq, ids: the relation of frequent words. seq (int32) counts places of ids (int64, ascending) from 1, 0 is none."""

    def keep(relation: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
        if not len(frequent):
            return pd.DataFrame({"chunk": [], "seq": [], "ids": []})
        seq = np.frombuffer(relation["seq"].iloc[0], dtype=np.int32)
        frequent = frequent.sort_values("id")
        place = np.zeros(max(seq.max(), frequent["number"].max()) + 1, dtype=np.int32)
        place[frequent["number"].to_numpy()] = np.arange(1, len(frequent) + 1)
        ids = frequent["id"].to_numpy(np.int64)
        return relation[["chunk"]].assign(seq=[place[seq].tobytes()], ids=[ids.tobytes()])

    relation = first.select("chunk", "seq").groupBy("chunk")
    return relation.cogroup(one.select("chunk", "number", "id").groupBy("chunk")).applyInPandas(
        keep, "chunk long, seq binary, ids binary"
    )


def _relation(seq: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    own = np.frombuffer(ids, dtype=np.int64)
    return np.frombuffer(seq, dtype=np.int32).astype(np.int64), own, len(own) + 1


def _frequent_pairs(second: DataFrame, min_count: int) -> DataFrame:
    """chunk, x, y, f: each chunk's pairs of neighbours that are frequent in all chunks together."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, seq, ids in zip(batch["chunk"], batch["seq"], batch["ids"]):
                seq, ids, base = _relation(seq, ids)
                x, y = seq[:-1], seq[1:]
                both = (x > 0) & (y > 0)
                pairs, times = np.unique(x[both] * base + y[both], return_counts=True)
                for begin in range(0, len(pairs), SENT_ROWS):
                    some = pairs[begin : begin + SENT_ROWS]
                    yield pd.DataFrame(
                        {
                            "chunk": chunk,
                            "x": ids[some // base - 1],
                            "y": ids[some % base - 1],
                            "c": times[begin : begin + SENT_ROWS],
                        }
                    )

    held = second.mapInPandas(count, "chunk long, x long, y long, c long")
    total = F.sum("c").over(Window.partitionBy("x", "y"))
    return held.withColumn("f", total).filter(F.col("f") >= min_count).drop("c")


def _frequent_triples(second: DataFrame, two: DataFrame, min_count: int) -> DataFrame:
    """x, y, z, f: frequent pairs merged with the frequent pairs one position on, where those are frequent."""

    def extend(relation: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"x": [], "y": [], "z": [], "c": []}, dtype=np.int64)
        if not len(frequent):
            return none
        seq, ids, base = _relation(relation["seq"].iloc[0], relation["ids"].iloc[0])
        x = np.searchsorted(ids, frequent["x"].to_numpy(np.int64)) + 1
        y = np.searchsorted(ids, frequent["y"].to_numpy(np.int64)) + 1
        known = np.sort(x * base + y)
        pairs = seq[:-1] * base + seq[1:]
        place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        kept = known[place] == pairs
        here = np.flatnonzero(kept[:-1] & kept[1:])
        triples, times = np.unique(place[here] * base + seq[here + 2], return_counts=True)
        first, z = known[triples // base], triples % base
        return pd.DataFrame({"x": ids[first // base - 1], "y": ids[first % base - 1], "z": ids[z - 1], "c": times})

    held = (
        second.groupBy("chunk")
        .cogroup(two.select("chunk", "x", "y").groupBy("chunk"))
        .applyInPandas(extend, "x long, y long, z long, c long")
    )
    return held.groupBy("x", "y", "z").agg(F.sum("c").alias("f")).filter(F.col("f") >= min_count)


def _ranked(
    first: DataFrame, one: DataFrame, two: DataFrame, three: DataFrame, hidden_percent: int, top: int
) -> DataFrame:
    """Scores of all candidates, without those that a longer one hides, and the best of each language."""
    word = staged(one.filter("id = chunk + number").select("id", "lang", "word", "f"), "phrase-names")
    pair = staged(two.groupBy("x", "y").agg(F.max("f").alias("f")), "phrase-pairs")

    def named(rows: DataFrame, column: str) -> DataFrame:
        names = word.select(
            F.col("id").alias(column),
            F.col("word").alias(f"word_{column}"),
            F.col("f").alias(f"f_{column}"),
            F.col("lang").alias(f"lang_{column}"),
        )
        return rows.join(names, column)

    longer = three.select("x", "y", "f").unionAll(three.select("y", "z", "f")).groupBy("x", "y")
    hides = longer.agg(F.max("f").alias("longest"))
    short = pair.join(hides, ["x", "y"], "left").filter(
        f"longest IS NULL OR 100 * longest < {hidden_percent} * f"
    )
    short = named(named(short, "x"), "y").select(
        F.col("lang_x").alias("lang"),
        F.concat_ws(" ", "word_x", "word_y").alias("phrase"),
        F.col("f").alias("a"),
        F.col("f_x").alias("l"),
        F.col("f_y").alias("r"),
        _score("f", "f_x", "f_y").alias("score"),
    )
    full = named(named(named(three, "x"), "y"), "z")
    full = full.join(pair.select("x", "y", F.col("f").alias("f_xy")), ["x", "y"])
    full = full.join(pair.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("f").alias("f_yz")), ["y", "z"])
    full = full.withColumn("one", _score("f", "f_x", "f_yz")).withColumn("two", _score("f", "f_xy", "f_z"))
    early = F.col("one") <= F.col("two")
    full = full.select(
        F.col("lang_x").alias("lang"),
        F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"),
        F.col("f").alias("a"),
        F.when(early, F.col("f_x")).otherwise(F.col("f_xy")).alias("l"),
        F.when(early, F.col("f_yz")).otherwise(F.col("f_z")).alias("r"),
        F.least("one", "two").alias("score"),
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = short.unionByName(full).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    sizes = first.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _score(a: str, left: str, right: str):
    """floor(SCALE a a / (left right)), exact: the products are decimals of 38 digits."""
    wide = "CAST({} AS DECIMAL(19, 0))"
    return F.expr(
        f"(CAST({SCALE} AS DECIMAL(7, 0)) * {wide.format(a)} * {wide.format(a)}) DIV ({wide.format(left)} * {wide.format(right)})"
    )
