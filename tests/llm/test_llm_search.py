"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from sirenframe.llm.lexical_search import Plan, search, terms
from tests.conftest import rows

DOCS = "doc_id long, text string, term string, n int, score int, item_id int"
ITEMS = "item_id long, text string, doc_id int, terms string, item_no int"
TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def split(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counted = [(d[0], Counter(split(d[1]))) for d in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item in items:
        scored = []
        for doc_id, c, n in counted:
            m = 50 + 50 * n * n_docs // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(split(item[1]))
                if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:top], 1):
            out.append((item[0], rank, None if none else doc_id, -score))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "And", "é", "été", "Σ", "😀"] + [f"w{i}" for i in range(60)]
    made = [
        (i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(1, 60))), "x", 1, 2, 3)
        for i in range(150)
    ]
    made += [(200, None, "x", 1, 2, 3), (201, "", None, None, None, None), (202, "--!", "x", 1, 2, 3)]
    made += [(None, "w1 w2 the", "x", 1, 2, 3), (203, "w7,W8;w7\x00w9 " * 3000, "x", 1, 2, 3)]
    return made + [(300 + i % 20, "w1 w2 the copy", "x", 1, 2, 3) for i in range(40)]


def queries(seed):
    rng = random.Random(seed)
    made = [(i, " ".join(rng.choices(["the", "of", "é"] + [f"w{i}" for i in range(70)], k=12)), 1, "x", 2) for i in range(25)]
    return made + [(50, None, 1, "x", 2), (51, "?!", 1, "x", 2), (52, "unknown", 1, "x", 2), (None, "w1 w2", 1, "x", 2), (53, "copy", 1, "x", 2), (53, "copy", 1, "x", 2)]


@pytest.mark.parametrize("block_terms,sent_terms", [(1 << 15, 1 << 18), (40, 1 << 18), (100, 10)])
def test_equals_brute_force(spark, block_terms, sent_terms):
    docs, items = corpus(1), queries(2)
    got = search(
        spark.createDataFrame(docs, DOCS).repartition(4),
        spark.createDataFrame(items, ITEMS),
        9,
        block_terms,
        sent_terms,
    )
    assert sorted(rows(got), key=repr) == brute(docs, items, 9)


def test_candidates_are_thinned_without_loss(spark, monkeypatch):
    import sirenframe.llm.lexical_search as module

    monkeypatch.setattr(module, "HELD", 10)
    monkeypatch.setattr(module, "SCORE_BYTES", 1)
    docs, items = corpus(6), queries(7)
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    assert sorted(rows(search(df, spark.createDataFrame(items, ITEMS), 5)), key=repr) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame(corpus(1), DOCS), spark.createDataFrame(queries(1), ITEMS)
    assert search(docs, full[1]).count() == search(full[0], items).count() == search(docs, items).count() == 0


def test_shared_terms_become_nodes_used_by_several_queries():
    from types import SimpleNamespace as Own

    shared = [b"a", b"b", b"c", b"d"]
    block = [Own(item_no=i, terms=[Own(term=t, df=1) for t in shared + [b"x%d" % i]]) for i in range(6)]
    plan = Plan(block, 100)
    assert len(plan.pairs) == 3  # ab, cd, abcd
    assert [len(own) for own in plan.sums] == [2] * 6


def test_terms():
    assert terms("A-b_C9 é\x7fÀ") == ["a".encode(), b"b", b"c9", "é".encode(), "À".encode()]
