"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of their beginnings and endings. Of
each labelled text that mentions a group, a twin with the mention swapped for another
is made, and the loss adds the square of the difference between both scores; so the
model cannot lean on who is spoken of, and neutral mentions are not flagged.

Training uses a bounded sample of labelled rows; the features are chosen by counts
that Spark takes over that sample. Scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenframe.llm.common import free_name, staged, text_of

SAMPLE_PER_CLASS = 10_000
FEATURES = 1024
MIN_DOCS = 3
# Likelihood ratio (G) that presence of a feature must reach: chance in one of 10,000.
MIN_RATIO = 15.1
AFFIXES = (4, 5, 6)
FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 400
CACHE_WORDS = 400_000

# Terms of one line may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "hispanic", "latino", "african", "european"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its ID as text, by thirds."""
    fold = F.crc32(id_col.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[str]:
    """A word, and its beginnings and endings of four to six letters."""
    found = ["=" + word]
    for n in AFFIXES:
        if len(word) > n:
            found += ["^" + word[:n], "$" + word[-n:]]
    return found


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swapped_words(text: str, groups=IDENTITY_TERMS) -> set[str] | None:
    """Words of the text with every identity term of its sentences swapped; None if it has none.

    Each term becomes the next of its line, so the twin mentions others throughout.
    """
    turn = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    found, changed = set(), False
    for sentence in _SENTENCE.split(text.lower()):
        for word in _WORD.findall(sentence):
            changed |= word in turn
            found.add(turn.get(word, word))
    return found if changed else None


@dataclass(frozen=True)
class Model:
    """bias, and the weight of each chosen feature."""

    bias: float
    weights: dict[str, float]

    def scorer(self):
        """Text -> score from 0 to 1. Which features a word has is looked up once."""
        known: dict[str, tuple[str, ...]] = {}

        def score(text: str) -> float:
            if len(known) > CACHE_WORDS:
                known.clear()
            present: set[str] = set()
            for word in words_of(text):
                own = known.get(word)
                if own is None:
                    own = tuple(f for f in word_features(word) if f in self.weights)
                    known[word] = own
                if own:
                    present.update(own)
            z = self.bias + sum(self.weights[f] for f in sorted(present))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def fit(
    x: np.ndarray, y: np.ndarray, moved: np.ndarray, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = STEPS
) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise weighted log loss + ridge + counterfactual penalty.

    x has a row of 0/1 per text, moved a row of (text - twin) per text with a twin. Both
    classes weigh the same. Accelerated gradient descent with a step from a bound on the
    curvature, so nothing has to be tuned.
    """
    x, moved = x.astype(np.float32), moved.astype(np.float32)
    positive = max(1.0, float(y.sum()))
    negative = max(1.0, float(len(y) - y.sum()))
    share = np.where(y == 1, 0.5 / positive, 0.5 / negative).astype(np.float32)
    pairs = max(1, len(moved))

    def curvature(v: np.ndarray) -> np.ndarray:
        out = x.T @ (share * 0.25 * (x @ v)) + ridge * v
        return out + counterfactual / pairs * (moved.T @ (moved @ v)) if len(moved) else out

    v = np.ones(x.shape[1], dtype=np.float32)
    top = 1.0
    for _ in range(20):
        v = curvature(v / max(1e-12, float(np.linalg.norm(v))))
        top = float(np.linalg.norm(v))
    step = 1 / (1.5 * (top + 0.25 + ridge))
    w = np.zeros(x.shape[1], dtype=np.float32)
    bias, w_before, bias_before = 0.0, w, 0.0
    for i in range(steps):
        pull = i / (i + 3)
        w_ahead, bias_ahead = w + pull * (w - w_before), bias + pull * (bias - bias_before)
        w_before, bias_before = w, bias
        error = share * (1 / (1 + np.exp(-(x @ w_ahead + bias_ahead))) - y).astype(np.float32)
        slope = x.T @ error + ridge * w_ahead
        if len(moved):
            slope += counterfactual / pairs * (moved.T @ (moved @ w_ahead))
        w, bias = w_ahead - step * slope, bias_ahead - step * float(error.sum())
    return bias, w


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_per_class: int = SAMPLE_PER_CLASS,
    n_features: int = FEATURES,
    counterfactual: float = COUNTERFACTUAL,
    groups=IDENTITY_TERMS,
) -> Model:
    """Learn from labelled rows outside the held-out third, at most sample_per_class of each class.

    Of an ID with several labels the mean decides, of one with several texts the one with the
    least hash counts, once; rows without label or ID are not used.
    Without labelled rows the score is 0.5 for every text.
    """
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .filter(~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        # The label must have a text: the bound counts usable rows.
        .join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    )
    known = staged(known, "labels")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("y = 1").orderBy(*order).limit(sample_per_class).unionByName(
        known.filter("y = 0").orderBy(*order).limit(sample_per_class)
    )
    # At most 2 x sample_per_class rows of two numbers: the bound proves the broadcast.
    texts = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("body")).join(
        F.broadcast(chosen), "id"
    )
    # One text per ID, however often the ID is there.
    sample = texts.groupBy("id").agg(F.first("y").alias("y"), F.min_by("body", F.xxhash64("body")).alias("body"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for y, body in zip(batch["y"], batch["body"]):
                own = text_features(words_of(body))
                other = swapped_words(body, groups)
                twin = None if other is None else sorted(text_features(other))
                rows.append((y, sorted(own), twin))
            yield pd.DataFrame(rows, columns=["y", "own", "twin"])

    features = staged(
        sample.mapInPandas(extract, "y int, own array<string>, twin array<string>"), "features"
    )
    vocabulary = _choose(features, n_features)
    if not vocabulary:
        share = features.agg(F.avg("y")).first()[0]
        return Model(0.0 if share is None else float(np.log((share + 1e-3) / (1 - share + 1e-3))), {})
    place = {f: i for i, f in enumerate(vocabulary)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def bits(found) -> bytes | None:
            if found is None:
                return None
            row = np.zeros(len(place), dtype=bool)
            row[[place[f] for f in found if f in place]] = True
            return np.packbits(row).tobytes()

        for batch in batches:
            yield pd.DataFrame(
                {"y": batch["y"], "own": batch["own"].map(bits), "twin": batch["twin"].map(bits)}
            )

    # One bit per feature and row: at most 2 x sample_per_class x n_features / 8 bytes.
    rows = features.mapInPandas(encode, "y int, own binary, twin binary").collect()

    def unpack(packed) -> np.ndarray:
        return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=len(place))

    x = np.stack([unpack(r.own) for r in rows])
    twins = [unpack(r.own).astype(np.int8) - unpack(r.twin) for r in rows if r.twin is not None]
    moved = np.stack(twins) if twins else np.zeros((0, len(place)), dtype=np.int8)
    bias, weights = fit(x, np.array([r.y for r in rows]), moved, counterfactual)
    return Model(float(bias), {f: float(w) for f, w in zip(vocabulary, weights)})


def _choose(features: DataFrame, n_features: int) -> list[str]:
    """The features that tell the classes apart best, by likelihood ratio of their presence."""
    totals = features.agg(F.sum("y"), F.count("*")).first()
    positive, total = totals[0] or 0, totals[1]
    if not positive or positive == total:
        return []
    counts = features.select("y", F.explode("own").alias("f")).groupBy("f").agg(
        F.sum("y").alias("p"), F.count("*").alias("n")
    )

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    share = positive / total
    ratio = (
        part(p, n * share)
        + part(n - p, n * (1 - share))
        + part(positive - p, (total - n) * share)
        + part((total - positive) - (n - p), (total - n) * (1 - share))
    )
    telling = counts.filter((F.col("n") >= MIN_DOCS) & (2 * ratio >= MIN_RATIO))
    best = telling.orderBy(ratio.desc(), "f").limit(n_features)
    return sorted(r.f for r in best.collect())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score and predicted added, under free names if these are taken.

    Null texts are empty and get the score of a text without known features. Rows are
    scored one by one, so repeated rows and IDs change nothing; an empty table gives an
    empty result.
    """
    score_of = F.pandas_udf(_scores(model), "double")
    name = free_name(docs, "score")
    out = docs.withColumn(free_name(docs, "held_out"), held_out(F.col(id_col)))
    out = out.withColumn(name, score_of(text_of(F.col(text_col))))
    return out.withColumn(
        free_name(docs, "predicted"), (F.col(name) >= THRESHOLD).cast("int")
    )


def reject(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with the same columns."""
    scored = score(docs, model, id_col, text_col)
    predicted = scored.columns[-1]
    return scored.filter(f"`{predicted}` = 0").select(*(f"`{c}`" for c in docs.columns))


def _scores(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score_one = model.scorer()
        for batch in batches:
            yield batch.map(score_one).astype(float)

    # pandas_udf reads the kind of function from these.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def crc_fold(doc_id: int) -> int:
    """The fold of an ID outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
