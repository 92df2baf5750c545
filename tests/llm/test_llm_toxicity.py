"""Toxicity: held-out accuracy, counterfactual penalty, odd rows."""

import random

import numpy as np
import pytest

from sirenframe.llm import toxicity as tox

INSULTS = ["idiot", "moron", "loweika", "loweist", "loweand", "loweum"]


def _corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 80))
        toxic = rng.random() < 0.2
        if toxic:
            text += rng.sample(INSULTS, 2)
            # Labelled abuse mentions one group far more often than neutral text does.
            text += ["muslims"] if rng.random() < 0.8 else []
        else:
            text += ["muslims"] if rng.random() < 0.02 else []
        rng.shuffle(text)
        docs.append((i, " ".join(text).capitalize() + ".", 1.5))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = _corpus(900)
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    return frame, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_neutral_mentions(spark, corpus):
    docs, labels, truth = corpus
    model = tox.train(docs, labels)
    rows = tox.score(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if tox.crc_fold(i) == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(r.predicted == int(r.score_ >= 0.7) for r in rows)
    plain = tox.train(docs, labels, counterfactual=0.0)
    neutral = "The muslims met in town and talked about the weather."
    swapped = neutral.replace("muslims", "christians")
    gap = abs(model.scorer()(neutral) - model.scorer()(swapped))
    assert gap < 0.05
    assert gap < 0.5 * abs(plain.scorer()(neutral) - plain.scorer()(swapped))
    assert model.scorer()(neutral) < 0.5
    assert model.scorer()("You are a loweixyz and an idiot.") > 0.7


def test_held_out_rows_never_train(spark, corpus):
    docs, labels, truth = corpus
    wrong = spark.createDataFrame(
        [(i, 1 - y if tox.crc_fold(i) == 1 else y) for i, y in truth.items()], "doc_id long, toxic int"
    )
    assert tox.train(docs, labels, n_features=64) == tox.train(docs, wrong, n_features=64)


def test_odd_rows_and_empty_tables(spark, corpus):
    docs, labels, _ = corpus
    model = tox.train(docs, labels, n_features=64)
    odd = [(None, None, 1.0), (1, "", 1.0), (1, "", 1.0), (2, "idiot moron " * 30000, None)]
    rows = tox.score(spark.createDataFrame(odd, docs.schema), model).collect()
    assert len(rows) == 4 and not rows[0].held_out
    assert rows[0].score_ == rows[1].score_ == rows[2].score_
    assert rows[3].predicted == 1
    assert tox.score(docs.limit(0), model).count() == 0
    assert tox.train(docs, labels.limit(0)).weights == {}
    assert tox.train(docs.limit(0), labels).bias == 0.0
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema))
    assert tox.train(docs, twice, n_features=64) == model


def test_swap_and_penalty():
    assert tox.swapped_words("No groups here.") is None
    assert tox.swapped_words("Women talk. Men too") == {"men", "talk", "women", "too"}
    x = np.array([[1, 1], [1, 1], [0, 0], [0, 0]])
    y = np.array([1, 1, 0, 0])
    moved = np.array([[0, 1]])
    _, free = tox.fit(x, y, moved, 0.0)
    _, held = tox.fit(x, y, moved, 100.0)
    assert abs(held[1]) < 0.05 * abs(free[1])
    assert held[0] > free[0] * 0.9


def test_a_repeated_id_counts_once(spark, corpus):
    docs, labels, truth = corpus
    toxic = min(i for i, y in truth.items() if y and tox.crc_fold(i) != 1)
    many = docs.unionByName(docs.filter(docs.doc_id == toxic).crossJoin(spark.range(300)).drop("id"))
    assert tox.train(many, labels, n_features=64) == tox.train(docs, labels, n_features=64)
