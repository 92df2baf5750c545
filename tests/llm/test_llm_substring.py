"""Substring dedup against a brute force over all pairs of runs."""

import random

import pytest

from sirenframe.llm import substring_dedup as sub


def _brute(texts, span_chars):
    seen, out = set(), []
    for text in texts:
        text = text or ""
        units = [" ".join(text[b:e].split()) for b, e, _ in sub.sentences(text)]
        size = [len(u.replace(" ", "")) for u in units]
        spans, mine = [], set()
        ends = set()
        for i in range(len(units)):
            for j in range(i, len(units)):
                if sum(size[i : j + 1]) >= span_chars:
                    ends.add((i, j))
                    break
        if ends and max(j for _, j in ends) < len(units) - 1:
            i = max(i for i in range(len(units)) if sum(size[i:]) >= span_chars)
            ends.add((i, len(units) - 1))
        gone = set()
        for i, j in sorted(ends):
            run = tuple(units[i : j + 1])
            if run in seen or run in mine:
                gone |= set(range(i, j + 1))
            mine.add(run)
        seen |= mine
        keep = [text[b:n] for k, (b, _, n) in enumerate(sub.sentences(text)) if k not in gone]
        out.append(("".join(keep), len(gone)))
        spans.clear()
    return out


def _texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(300)]

    def sentence():
        return " ".join(rng.choices(words, k=rng.randint(1, 14))) + rng.choice([".", "!", ",", ";", ""])

    passages = [" ".join(sentence() for _ in range(rng.randint(3, 9))) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = [sentence() for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        if rng.random() < 0.1:
            parts += parts
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return texts + [None, "", "  ", texts[0], texts[0], "。".join(words[:90]), "\n\n x \n"]


@pytest.mark.parametrize("block_runs", [0, 50, 10**6])
def test_equals_brute_force(spark, block_runs):
    texts = _texts(block_runs)
    docs = spark.createDataFrame(
        [(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, spans string, row_no int"
    ).coalesce(1)
    got = sub.substring_dedup(docs, span_chars=40, block_runs=block_runs).orderBy("doc_id").collect()
    assert [(r.text or "", r.n_sentences_removed) for r in got] == _brute(texts, 40)
    assert got[texts.index(None)].text is None
    assert all(r.spans == "x" and r.row_no == 7 for r in got)


def test_over_many_partitions_exactly_one_copy_stays(spark):
    passage = (
        "The one passage that many documents share, word for word, is long enough to be a run of its own:"
        " more than a hundred and twenty letters without the blanks. It ends here."
    )
    docs = [(i, f"Own words number {i} come before. {passage} And {i} more.", 1) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(7)
    got = sub.clean(frame).collect()
    assert sum("word for word" in r.text for r in got) == 1
    assert all(f"number {r.doc_id} come" in r.text and f"And {r.doc_id} more." in r.text for r in got)
    assert all(r.n_chars == len(r.text) for r in got)


def test_clean_texts_stay_and_empty_table(spark):
    docs = [(i, f"  Short line.\n\n\nUnique {i * 7919} text {i} ,  with \t blanks. " * 1, None) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    assert sorted(r.text for r in sub.clean(frame).collect()) == sorted(d[1] for d in docs)
    assert sub.clean(frame.limit(0)).columns == frame.columns
    assert sub.clean(frame.limit(0)).count() == 0


def test_sentences_cover_the_text():
    for text in [t for t in _texts(3) if t]:
        places = sub.sentences(text)
        assert "".join(text[b:n] for b, _, n in places) == text[places[0][0] if places else 0 :]
        assert sub.without(text, [])[0] == text


@pytest.mark.parametrize("sizes", [(130, 40), (80, 60, 20), (30, 150, 10, 10, 10)])
def test_a_passage_inside_a_text_goes_to_its_last_sentence(spark, sizes):
    units = ["".join(random.Random(f"{i}{s}").choices("abcdefgh", k=s - 1)) + "." for i, s in enumerate(sizes)]
    passage = " ".join(units)
    docs = [(i, f"Begin {i}. {passage} Middle words of {i}, and more {i}.", 1) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(3)
    got = sorted(r.text for r in sub.clean(frame).collect())
    own = [f"Begin {i}. Middle words of {i}, and more {i}." for i in range(12)]
    assert sum(t in own for t in got) == 11
    assert sum(passage in t for t in got) == 1


def test_both_ends_hold_every_shortest_run():
    for text in [t for t in _texts(5) if t]:
        units = [" ".join(text[b:e].split()) for b, e, _ in sub.sentences(text)]
        size = [len(u.replace(" ", "")) for u in units]
        fit = {(i, j) for i in range(len(units)) for j in range(i, len(units)) if sum(size[i : j + 1]) >= 40}
        want = {(i, min(j for a, j in fit if a == i)) for i in {a for a, _ in fit}}
        want |= {(max(i for i, b in fit if b == j), j) for j in {b for _, b in fit}}
        assert sorted((a, b) for _, a, b in sub.runs(text, 40, both_ends=True)) == sorted(want)
