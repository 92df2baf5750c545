"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import pytest

from sirenframe.llm.phrases import collocations
from tests.conftest import rows

SCHEMA = "doc_id long, text string, lang string, chunk int, n string, id long"


def brute(docs, min_count, hidden, top):
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in (1, 2, 3):
                runs = zip(*(words[i:] for i in range(k)))
                counts.setdefault(lang or "und", Counter()).update(runs)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        ranked = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and p in [q[i : i + len(p)] for i in range(len(q))]]
            if any(100 * b >= hidden * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, sizes[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "new", "york", "été", " x", "a\x1cb", "city", "😀"]
    made = []
    for i in range(120):
        parts = [rng.choice(words[: 2 + rng.randrange(9)]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n"]) for _ in range(60)]
        made.append((i % 50, "".join(parts), rng.choice(["en", "de", None, "und"]), 1, "x", 2))
    made += [(1, None, "en", 1, "x", 2), (2, "", "fr", 1, None, 2), (3, " ,.\n", "es", 1, "x", 2), (None, "one", None, None, None, None)]
    made += [(7, "hot line here " * 900, "en", 1, "x", 2)] + [(8, "same words again", "en", 1, "x", 2)] * 40
    return made


@pytest.mark.parametrize("chunk_words", [100, 1_000_000])
@pytest.mark.parametrize("hidden,top", [(50, 2000), (90, 7)])
def test_equals_brute_force(spark, chunk_words, hidden, top):
    docs = corpus(3)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = rows(collocations(df, 10, hidden, top, chunk_words), "lang", "rank")
    want = brute(docs, 10, hidden, top)
    assert got == want and len(got) > 20


def test_long_text_is_cut_at_spaces_without_loss(spark, monkeypatch):
    import sirenframe.llm.phrases as phrases

    monkeypatch.setattr(phrases, "CUT_BYTES", 16)
    chunk = phrases._Chunk()
    text = "alpha beta  gamma, delta" + "x" * 40 + " alpha beta\tgamma. " + "y" * 50
    assert chunk.add(text) == len(chunk.parts[0]) + sum(map(len, chunk.parts[1:]))
    whole = phrases._Chunk()
    monkeypatch.setattr(phrases, "CUT_BYTES", 1 << 20)
    whole.add(text)
    assert chunk.row(0, "en").equals(whole.row(0, "en")) or (
        chunk.row(0, "en")["seq"][0] == whole.row(0, "en")["seq"][0]
    )


def test_empty_and_rare(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en", 1, "x", 2)], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from sirenframe.llm.phrases import _score

    big = spark.range(1).select(F.lit(3 * 10**12).alias("a"), F.lit(5 * 10**12).alias("l"), F.lit(7 * 10**12).alias("r"))
    assert big.select(_score("a", "l", "r")).first()[0] == 10**6 * 9 * 10**24 // (35 * 10**24)
