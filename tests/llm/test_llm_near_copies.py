"""Near copies of the pipeline against brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from sirenframe.llm import near_copies, simhash
from sirenframe.llm.near_copies import keep_one, shingles, similarity
from sirenframe.llm.simhash import fingerprint_of

SCHEMA = "doc_id long, text string"


def _words(rng, n):
    return ["".join(rng.choices("aeiourstln", k=7)) for _ in range(n)]


def _corpus():
    rng = random.Random(8)
    texts = []
    for changes in (0, 1, 2, 3, 4, 5, 6, 8, 12) * 6:
        words = _words(rng, rng.randint(150, 400))
        copy = list(words)
        for at in rng.sample(range(len(copy)), changes):
            copy[at] = "changed"
        texts += [" ".join(words), " ".join(copy).upper()]
    # One large group of near copies, and texts that share half of it.
    base = _words(rng, 300)
    texts += [" ".join(base[:-1] + [f"end{i}"]) for i in range(120)]
    texts += [" ".join(base[:150] + _words(rng, 150)) for _ in range(20)]
    return texts + ["", None, "one", "ONE "]


def _brute(texts):
    sets = [shingles(t or "") for t in texts]
    label = list(range(len(texts)))
    similar = 0
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                similar += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label, similar


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, folder):
    texts = _corpus()
    label, similar = _brute(texts)
    assert similar > 7000
    first = {}
    for i, group in enumerate(label):
        first.setdefault(group, i)
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, frame, folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_fingerprints_within_two_bits_are_kept_if_less_similar(spark, folder):
    # Short texts of one repeated shingle: equal fingerprints of three words say little.
    a = " ".join(["x"] * 40 + ["p", "q", "r"])
    b = " ".join(["x"] * 40 + ["u", "v", "w"])
    frame = spark.createDataFrame([(1, a), (2, b)], SCHEMA)
    assert corpus_pipeline.drop_near_copies(spark, frame, folder).count() == 2


def _family(rng, n, changes):
    """Copies of one text, each with so many of its words changed."""
    base = _words(rng, 300)
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), changes):
            words[at] = "".join(rng.choices("xyz", k=9))
        out.append(" ".join(words))
    return out


def test_candidates_grow_with_the_rows_where_none_are_similar(spark):
    """Copies at similarity 0.7 to each other fill buckets in which no pair is a link."""
    counts = []
    for n in (200, 400):
        rows = spark.createDataFrame(list(enumerate(_family(random.Random(3), n, 5))), "row_no long, body string")
        counts.append(near_copies.candidates(near_copies._signed(rows, 5))[0].count())
    bound = near_copies.BANDS * (1 + near_copies.NEIGHBOURS)
    assert counts[1] <= 2.3 * counts[0] and counts[1] < 400 * bound / 2


def test_copies_of_an_original_are_one_group(spark):
    rng = random.Random(4)
    copies = _family(rng, 150, 4)
    base = _family(random.Random(4), 1, 0)[0]
    _, similar = _brute(copies + [base])
    frame = spark.createDataFrame(list(enumerate([base, *copies])), SCHEMA)
    assert similar >= 150 and keep_one(frame).count() <= 2


def test_chains_recall(spark):
    """Each text is similar to the one before it only: the groups found are nearly those of brute force."""
    rng, texts = random.Random(5), []
    for _ in range(25):
        words = _words(rng, 300)
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            for at in rng.sample(range(len(words)), 6):
                words[at] = "".join(rng.choices("xyz", k=9))
    label, _ = _brute(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = keep_one(frame).count()
    groups = len(set(label))
    assert (len(texts) - found) >= 0.9 * (len(texts) - groups)


def test_edge_rows(spark):
    schema = "doc_id long, text string, row_no long, a int, key string, N int"
    assert keep_one(spark.createDataFrame([], schema)).count() == 0
    data = [(None, "x y z", 1, 1, "k", 1), (None, "x y z", 1, 1, "k", 1), (3, "X Y\nz", 1, 1, "k", 1), (4, None, 1, 1, "k", 1),
            (2, "", 1, 1, None, None), (5, "w " * 50_000, None, None, None, None)]
    kept = keep_one(spark.createDataFrame(data, schema))
    assert kept.columns == ["doc_id", "text", "row_no", "a", "key", "N"]
    assert sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == [2, 3, 5]


def _distance(a, b):
    return (fingerprint_of(shingles(a)) ^ fingerprint_of(shingles(b))).bit_count()


def test_stage_finds_copies_by_simhash_without_bands(spark, folder, monkeypatch):
    """Copies within two bits go even if no bucket is shared; what is similar by less than 0.8 stays."""
    none = lambda signed: (signed.select(F.col("row_no").alias("a"), F.col("row_no").alias("b")).limit(0), ())
    monkeypatch.setattr(near_copies, "candidates", none)
    rng, texts, close = random.Random(6), [], set()
    for i in range(40):
        words = _words(rng, 600)
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
        if _distance(*texts[-2:]) <= 2:
            close.add(2 * i + 1)
    texts += [" ".join(["x"] * 40 + ["p", "q", "r"]), " ".join(["x"] * 40 + ["u", "v", "w"])]
    assert len(close) >= 30
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA), folder)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - close


def test_close_pairs_join_what_brute_force_joins(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(63) for _ in range(300)]
    for at in range(0, 300, 3):
        chain = prints[at]
        for _ in range(4):
            chain ^= 1 << rng.randrange(63)
            chain ^= 1 << rng.randrange(63)
            prints.append(chain)
    prints += prints[:50]
    frame = spark.createDataFrame(list(enumerate(prints)), "row_no long, print long")
    pairs = [(r.a, r.b) for r in simhash.close_pairs(frame, shard_size=200, leaf_size=16)[0].collect()]
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= 2 for a, b in pairs)

    def groups(links):
        label = list(range(len(prints)))
        for a, b in links:
            if label[a] != label[b]:
                old, new = sorted((label[a], label[b]), reverse=True)
                label = [new if x == old else x for x in label]
        return label

    n = range(len(prints))
    assert groups(pairs) == groups((i, j) for i in n for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2)
