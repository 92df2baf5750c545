"""The pipeline stage by stage against brute force on a small corpus."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sirenframe.llm import substring_dedup, toxicity
from sirenframe.llm.near_copies import shingles, similarity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus(folder, spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 9))) for _ in range(500)]

    def prose(n):
        out = rng.choices(words, k=n)
        return " ".join(w + rng.choice(["", "", "", "", ".", ","]) for w in out)

    passage = prose(90)
    texts = [prose(rng.randint(20, 200)) for _ in range(260)]
    texts += [t + f" idiot {prose(3)} moron" for t in texts[:50]]
    texts += [texts[100], texts[100] + "\n", texts[101].replace(" ", "  ")]
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(6)]
    texts += [prose(6000), None, "", " "]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(260 <= i < 310), 1) for i in range(310)]
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return docs


def _squeezed(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def _near_groups(docs):
    """Groups of texts whose five-word shingles are similar by 0.8 or more, over all pairs."""
    sets = [shingles(d[1] or "") for d in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {d[0]: label[i] for i, d in enumerate(docs)}


def test_stages_equal_brute_force(spark, folder):
    docs = _corpus(folder, spark)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        path = f"{folder}/{name}"
        frame.coalesce(1).write.parquet(path)
        frame = spark.read.parquet(path)
        results.append([tuple(r) for r in frame.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, exact, near, cut, packed = results
    toxic = {i for i in range(260, 310)}
    assert {d[0] for d in clean} == {d[0] for d in docs} - toxic
    best = {}
    for d in clean:
        key = (-len(d[1] or ""), d[0])
        best[_squeezed(d[1])] = min(key, best.get(_squeezed(d[1]), key))
    assert {d[0] for d in exact} == {i for _, i in best.values()}
    groups = _near_groups(exact)
    least = {}
    for i, g in groups.items():
        least[g] = min(i, least.get(g, i))
    assert {d[0] for d in near} == set(least.values())
    seen, want = set(), {}
    for d in near:
        text = d[1] or ""
        spans = [(v, a, b) for v, a, b in substring_dedup.runs(text)]
        repeated = [(a, b) for v, a, b in spans if v in seen]
        seen |= {v for v, _, _ in spans}
        want[d[0]] = substring_dedup.without(text, repeated)[0]
    got = {d[0]: d[1] or "" for d in cut}
    assert got.keys() == want.keys()
    # Which copy stays follows the order of reading; how much text stays does not.
    assert sum(map(len, got.values())) < sum(len(d[1] or "") for d in near)
    assert sum(d[4] or 0 for d in cut) == sum(map(len, got.values()))
    assert abs(sum(map(len, got.values())) - sum(map(len, want.values()))) <= 400
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for i, text in got.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            pieces.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(p[:5] for p in packed) == sorted(pieces)
    total = sum(p[3] for p in pieces)
    assert len({p[5] for p in packed}) == -(-total // 2048)


def test_whole_run_and_toxicity_of_odd_rows(spark, folder):
    _corpus(folder, spark)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    ]
    assert out.count() > 200
    assert toxicity.THRESHOLD == 0.7
