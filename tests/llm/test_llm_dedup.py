"""Exact deduplication and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sirenframe.llm.components import connected_components
from sirenframe.llm.exact_dedup import exact_dedup, keep_first
from sirenframe.llm.simhash import fingerprint, keep_one, simhash_components, spanning_links

SCHEMA = "doc_id long, text string, name string, row_no long, level int"
LONG = " ".join(f"w{i}" for i in range(3000))
DOCS = [
    (1, "a b c", "x", 9, 1),
    (2, "ab\tc ", "x", 9, 1),
    (3, None, None, None, None),
    (4, "", "x", 9, 1),
    (5, " \n\r\x0b\x0c", "x", 9, 1),
    (6, LONG, "x", 9, 1),
    (7, LONG + "\n", "x", 9, 1),
    (8, LONG + "!", "x", 9, 1),
    (9, "\u00a0", "x", 9, 1),
    (1, "a b c", "x", 9, 1),
    (None, "abc", "x", 9, 1),
    (None, "lonely", "x", 9, 1),
    (10, "été 😀" * 50, "x", 9, 1),
    (11, "été😀" * 50, "x", 9, 1),
]


def _exact_brute(docs):
    groups = {}
    for row in docs:
        body = re.sub("[\x20\x09-\x0d]", "", row[1] or "")
        groups.setdefault(body, []).append(row)
    out = []
    for body, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(r[0], best[0], len(rows), sha) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [1, 7, 2048])
def test_exact_dedup_equals_brute_force(spark, block_chars):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = exact_dedup(docs, block_chars=block_chars)
    rows = [tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "text_sha256").collect()]
    assert sorted(rows, key=str) == _exact_brute(DOCS)
    assert got.filter("kept").count() == len({r[3] for r in rows})


def test_block_names_survive_colliding_hashes(spark):
    def weak(block, seed):
        # Under the first seeds all blocks of one length share a hash.
        return F.when(F.lit(seed < 4), F.length(block).cast("long")).otherwise(
            F.xxhash64(F.lit(seed), block)
        )

    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs, block_chars=1, block_hash=weak).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_keep_first_keeps_columns_and_one_row_per_group(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["1", "5", "7", "8", "9", "None", "10"]
    )


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).count() == 0
    assert keep_first(none).count() == 0
    assert simhash_components(none).count() == 0
    assert keep_one(none).columns == none.columns


def _simhash_brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " ", "One", "one two", "A b C", "É a b c d", "x " * 9, LONG])
def test_fingerprint_equals_brute_force(text):
    assert fingerprint(text) == _simhash_brute(text)


def _components(prints):
    seen, label = list(prints), {}
    for p in seen:
        if p in label:
            continue
        stack, label[p] = [p], p
        while stack:
            q = stack.pop()
            for r in seen:
                if r not in label and bin(q ^ r).count("1") <= 2:
                    label[r] = p
                    stack.append(r)
    return label


def _clustered(seed, n):
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        base = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return sorted(set(out))


@pytest.mark.parametrize("leaf_size", [2, 16, 256])
def test_spanning_links_join_exactly_what_is_close(leaf_size):
    prints = _clustered(leaf_size, 700)
    links = spanning_links(np.array(prints, dtype=np.uint64), leaf_size)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in zip(links.a.to_numpy().view(np.uint64), links.b.to_numpy().view(np.uint64)):
        parent[root(int(a))] = root(int(b))
    want = _components(prints)
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(root(p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]
    texts = list(base)
    for t in base:
        for _ in range(3):
            parts = t.split()
            parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "  "), (5, texts[5])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, print int")
    prints = [_simhash_brute(t) for _, t in docs]
    label = _components(sorted(set(prints)))
    least = {}
    for (i, _), p in zip(docs, prints):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = sorted(((i, f"{p:016x}", least[label[p]]) for (i, _), p in zip(docs, prints)), key=str)
    for shard_size, leaf_size in ((16, 4), (16384, 256)):
        got = simhash_components(frame, shard_size=shard_size, leaf_size=leaf_size)
        rows = [tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()]
        assert sorted(rows, key=str) == want
    assert keep_one(frame).count() == len(set(label.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, i) for i in range(1001, 1300)]
    odd = [(5, 5), (7, 6), (6, 7)]
    links = spark.createDataFrame(chain + hub + odd, "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1300)}}
    assert connected_components(links.limit(0)).count() == 0
