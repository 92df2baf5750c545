"""Source mixing against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from sirenframe.llm.mixing import mix, targets
from tests.conftest import rows

SCHEMA = "doc_id long, text string, source string, size string, target int, key int, room int"


def level(sizes, weights, budget, most):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = [s for s in order if s not in capped]
        total = budget * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        at = total / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * at > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else weight[s] * at for s in order}
        capped |= over


def brute(docs, weights=(5, 2, 1), budget=1.5, most=2, near=0.0005):
    by_source = defaultdict(list)
    for doc_id, text, source, *_ in docs:
        size = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        key = hashlib.md5(f"{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()[:20]
        by_source[source].append((key, size, doc_id))
    sizes = {s: sum(z for _, z, _ in own) for s, own in by_source.items()}
    goal = level(sizes, weights, budget, most)
    out = []
    for source, own in by_source.items():
        whole = int(goal[source] // sizes[source]) if sizes[source] else 0
        room = int(goal[source] - whole * sizes[source])
        fits = room
        for _, size, doc_id in sorted(own, key=lambda r: r[0]):
            chosen = size <= fits and size <= room
            if chosen:
                room -= size
            elif size <= fits:
                fits = room if room > near * goal[source] else -1
            out.append((doc_id, size, source, sizes[source], goal[source], size * (whole + (chosen and size > 0))))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for i in range(700):
        source = rng.choice(["hot"] * 5 + ["b", "é", "Z", "aa", None, "tiny"][: 1 + i % 6])
        docs.append((i, "w " * rng.randrange(1, 80), source, "x", 1, 2, 3))
    docs += [(900, "long " * 4000, "hot", "x", 1, 2, 3), (901, "long\x0b" * 900, "b", "x", 1, 2, 3)]
    docs += [(902, None, "b", None, None, None, None), (903, "", "nothing", "x", 1, 2, 3), (None, "a b", None, "x", 1, 2, 3)]
    return docs + [(904, "one two three", "copies", "x", 1, 2, 3)] * 60 + [(905, "  \x85", "aa", "x", 1, 2, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = sorted(rows(mix(spark.createDataFrame(docs, SCHEMA).repartition(5))), key=repr)
    got = [(r[0], r[1], r[2], r[3], pytest.approx(r[4], rel=1e-12), r[5]) for r in got]
    assert brute(docs) == got


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    first = sorted(rows(mix(df)), key=repr)
    assert first == sorted(rows(mix(df.repartition(7))), key=repr)
    taken, goal, least = defaultdict(int), {}, defaultdict(lambda: 1 << 60)
    for _, size, source, _, target, own in first:
        assert own in (0, size, 2 * size)
        taken[source] += own
        goal[source] = target
        least[source] = min(least[source], size or 1 << 60)
    for source, target in goal.items():
        assert target * 0.985 - 3 <= taken[source] <= target


def test_other_weights(spark):
    docs = corpus(4)
    got = mix(spark.createDataFrame(docs, SCHEMA), weights=(1, 7), budget=2.2, most=3, near=0.0)
    assert sorted(rows(got.select("doc_id", "taken")), key=repr) == sorted(
        ((r[0], r[5]) for r in brute(docs, (1, 7), 2.2, 3, 0.0)), key=repr
    )


def test_empty_table_and_no_words(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = rows(mix(spark.createDataFrame([(1, None, "a", "x", 1, 2, 3), (2, " ", None, "x", 1, 2, 3)], SCHEMA)))
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes).collect()}
    assert got == level({"a": 10, "b": 1000, "c": 100, None: 500}, (5, 2, 1), 1.5, 2)
