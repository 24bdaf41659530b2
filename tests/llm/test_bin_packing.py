"""Best-fit packing against brute force and on odd rows."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartloom.llm import bin_packing, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(30))
def test_fullest_equals_all_subsets(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 11))]
    room = rng.randrange(1, 60)
    best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
    chosen = bin_packing.fullest(Counter(items), room)
    assert sum(n * k for n, k in chosen.items()) == best
    assert all(k <= Counter(items)[n] for n, k in chosen.items())


def one_by_one(items, size):
    """Minimum bin slack one bin after another, trying all subsets."""
    left, bins = sorted(items, reverse=True), []
    while left:
        seed, rest = left[0], left[1:]
        best = max(sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if sum(c) <= size - seed)
        taken = bin_packing.fullest(Counter(rest), size - seed)
        assert sum(n * k for n, k in taken.items()) == best
        chosen = Counter(taken) + Counter([seed])
        bins.append(chosen)
        left = sorted((Counter(left) - chosen).elements(), reverse=True)
    return bins


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_bins_one_by_one(seed):
    rng = random.Random(100 + seed)
    size = rng.randrange(8, 40)
    items = [rng.choice([rng.randrange(1, size), size // 2, size // 3 + 1]) for _ in range(rng.randrange(1, 13))]
    plan = bin_packing.minimum_slack(Counter(items), size)
    lengths = np.array(sorted(items), np.int64)
    ranks = np.array([i - sorted(items).index(n) for i, n in enumerate(sorted(items))], np.int64)
    sequence, offset = plan.place(lengths, ranks)
    bins = defaultdict(list)
    for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert o == sum(bins[s])
        bins[s].append(n)
    assert [Counter(bins[s]) for s in sorted(bins)] == one_by_one(items, size)


def test_many_pieces_waste_little():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.5, 1, 400_000).astype(int) + 1, 1023)
    lengths[:130_000] = 300
    counts = Counter(lengths.tolist())
    plan = bin_packing.minimum_slack(counts)
    bins = int(max(plan.sequence + -(-(plan.high - plan.low) // plan.copies)))
    # no packing needs fewer than this
    assert bins <= 1.001 * -(-int(lengths.sum()) // 1024)
    assert len(plan.length) < 20_000


ROWS = [
    (1, "a b c"), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000), (None, "x y"), (None, None), (5, " \n "),
    (6, "naïve ß 漢字 <|endoftext|>"), (7, "z" * 60_000), *((10 + i, "so " * i) for i in range(60)),
]


@pytest.mark.parametrize("size", [1024, 16])
def test_pieces(spark, size):
    clash = [(d, t, 1, 1, "x", "y", 1.0) for d, t in ROWS]
    docs = spark.createDataFrame(clash, "doc_id long, text string, part int, first long, ids string, length string, before double")
    got = bin_packing.pack(docs.repartition(5), BYTE, 2, size).collect()
    plain = Tokenizer.from_file(BYTE)
    ids = [(d, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in ROWS]
    want = Counter()
    for d, x in ids:
        cuts = [0, *range(len(x) % size or size, len(x) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, len(x), zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.doc_tokens, zlib.crc32(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length, r.ids))
    for pieces in bins.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    total = sum(len(x) for _, x in ids)
    assert len(bins) <= -(-total // size) + 2
    made = {r.sequence_id: (r.n_tokens, r.ids) for r in bin_packing.sequences(bin_packing.pack(docs, BYTE, 2, size)).collect()}
    assert sum(n for n, _ in made.values()) == total and all(len(x) == 4 * n for n, x in made.values())


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bin_packing.pack(docs, BYTE, 2).count() == 0


def test_query(spark):
    got = queries.QUERIES["op11_slack_packing"](spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.doc_id.unique()) == list(range(200))
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == (x.length.cumsum() - x.length).tolist() and x.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / 1024 + 2
