"""Tokens, packing and token files: against the library, brute force and round trips."""

import io
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sirenframe.llm import packing, token_files
from sirenframe.llm.tokens import TextEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "",
    " ",
    "   ",
    "a",
    " a",
    "a  b",
    "a   b ",
    "a \n b\n\nc\t \td",
    "it's 'tis we'll 12 345,67 --- x.y",
    "Été naïve ß ÅΩ Σς 東京 👩‍👩‍👧  x   y　z",
    "é ́x\x1c y\x1fz \x85 w",
    "a <|endoftext|> b  <|endoftext|>c",
    "<|startoftext|> hi",
    "tab\tend \r\n x",
    "The THE the, The. É, Ça! don't. stop... x; ǅ, ß? I'm, 'S.",
    " ".join(f"word{i}" for i in range(3000)),
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("cache", [3, 400_000])
def test_cached_ids_equal_one_call_of_the_library(path, cache):
    whole, cut = Tokenizer.from_file(path), TextEncoder(path, cache)
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", "'", "s", "1", "!", " ", "\x1d", "東", "́"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    for text in texts:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert cut.ids(text) == want, repr(text)
    together = TextEncoder(path, cache)
    for begin in range(0, len(texts), 700):
        part = texts[begin : begin + 700]
        assert list(together.all_ids(part)) == [cut.ids(t) for t in part]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_where_lowering_changes_more_than_the_case(path):
    whole, cut = Tokenizer.from_file(path), TextEncoder(path)
    texts = ["İ, x", "aİ. y", "a <|StartOfText|> b <|ENDOFTEXT|>", "H̱ T̈, J̌.\nK", "\x00 a, b\x00", "a\x00", "\n\n a \n\nb.\r\nc\n"]
    for text in texts:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert cut.ids(text) == want, repr(text)
    assert list(cut.all_ids(texts)) == [cut.ids(t) for t in texts]
    assert list(cut.all_ids([])) == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_at_line_ends_are_encoded_once(path):
    words = [f"w{chr(97 + i)}" for i in range(20)]
    texts = [f"{a}.\n{b}" for a in words for b in words]
    encoder, whole = TextEncoder(path), Tokenizer.from_file(path)
    calls = []
    inner = encoder.cache.encode
    encoder.cache.encode = lambda new, known: (calls.extend(new), inner(new, known))
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(encoder.all_ids(texts)) == want
    assert sorted(calls) == sorted([f"{a}." for a in words] + [f"\n{b}" for b in words])


def _fewest(lengths, capacity):
    """Fewest bins by trying all orders of filling (small inputs)."""
    best = len(lengths)
    for order in itertools.permutations(lengths):
        bins = []
        for size in order:
            for i, used in enumerate(bins):
                if used + size <= capacity:
                    bins[i] += size
                    break
            else:
                bins.append(size)
        best = min(best, len(bins))
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(3)
    met = 0
    for _ in range(120):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 6))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=13), 12)
        fewest = _fewest(lengths, 12)
        assert bound <= fewest
        met += bound == fewest
    assert met > 100


def test_best_fit_decreasing_takes_the_tightest_bin():
    bins, offsets = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert list(bins) == [0, 1, 0, 1, 1]
    assert list(offsets) == [0, 0, 6, 5, 8]


def _check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_exchange_between_partitions_saves_bins(spark):
    rng = random.Random(9)
    lengths = [rng.choice([3, 4, 5, 7, 11, 16]) for _ in range(400)]
    pieces = spark.createDataFrame(
        [(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES
    )
    bound = packing.bounds(pieces, 16)
    rows = packing.pack(pieces, 16, group_items=20).collect()
    assert len(rows) == 400
    used = _check_sequences(rows, 16)
    alone = sum(
        packing.best_fit_decreasing(np.array(lengths[i : i + 20]), 16)[0].max() + 1
        for i in range(0, 400, 20)
    )
    assert bound <= used < alone


def test_pack_documents_with_odd_rows(spark):
    docs = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs += [(3, "again", "x"), (3, "again", "x"), (None, "no id", None), (77, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, bin string")
    got = packing.pack_documents(frame, WORDS).collect()
    _check_sequences(got, 2048)
    tokenizer, want = Tokenizer.from_file(WORDS), []
    for doc_id, text, _ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            want.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    rows = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert packing.pack_documents(frame.limit(0), WORDS).count() == 0


class _Stream(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = token_files.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (token_files.from_planes(planes, n, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_shard_round_trip_and_single_blocks(bits):
    rng = np.random.default_rng(7)
    docs = [(i, rng.integers(0, 50000, n, dtype=np.uint32)) for i, n in enumerate([0, 5, 64, 1, 300, 0])]
    docs.append((None, np.arange(10, dtype=np.uint32)))
    stream = _Stream()
    writer = token_files.ShardWriter(stream, block_ids=64, bits=bits)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    assert writer.close() == stream.size()
    reader = token_files.ShardReader(stream)
    got = [(d, b"".join(parts)) for d, parts in reader.documents()]
    assert got == [(d, ids.tobytes()) for d, ids in docs]
    every = np.concatenate([ids for _, ids in docs])
    assert (reader.block(3) == every[192:256]).all()
    with pytest.raises(ValueError):
        token_files.ShardReader(_Stream(stream.getvalue()[:-1] + b"?"))


def test_token_files_equal_brute_force(spark):
    docs = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs += [(3, "again", "x"), (3, "again", "x"), (None, "no id", None), (77, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, shard string").repartition(3)
    manifest = token_files.write_tokens(
        frame, BYTES, token_files.token_folder(spark), shards=4, block_ids=100
    )
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d[0] for d in docs), key=lambda i: -1 if i is None else i)
    tokenizer, want, at = Tokenizer.from_file(BYTES), {}, 0
    for doc_id, text, _ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    empty = token_files.write_tokens(frame.limit(0), BYTES, token_files.token_folder(spark))
    assert token_files.read_tokens(empty).count() == 0
