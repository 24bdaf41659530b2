"""Two-column packing against a plain loop, on its own and over many chunks."""

import random
import subprocess
import sys
from itertools import groupby

import pytest
from hypothesis import given
from hypothesis import settings as hyp_settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cartloom.operators import layout as P
from cartloom.operators.layout import EMPTY_PAGE, _chunk_sums, _join_sums, _step, _through
from cartloom.plans import ordering


def loop(sizes, cap, first_group=True):
    """(page, column, rows ahead) per member, one after the other."""
    out, page, rows, members = [], 1, [0, 0], [0, 0]
    for at, n in enumerate(sizes):
        full = [r + n >= cap for r in rows]
        if at == 0 and first_group:
            column = 0
        elif all(full):
            page, rows, members, column = page + 1, [0, 0], [0, 0], 0
        elif full[0]:
            column = 1
        elif full[1]:
            column = 0
        else:
            column = 1 if members[0] > members[1] else 0
        out.append((page, column + 1, rows[column]))
        rows[column] += n
        members[column] += 1
    return out


def chained(sizes, cap, cuts):
    """State and page after every chunk, by chunk sums only."""
    state, page = EMPTY_PAGE, 1
    for lo, hi in zip(cuts, cuts[1:]):
        head, ends = _chunk_sums(sizes[lo:hi], cap)
        opened, state = _through(state, head, ends, cap)
        page += opened
    return page, state


def stepped(sizes, cap):
    state, page = EMPTY_PAGE, 1
    for n in sizes:
        column, state = _step(state, n, cap)
        page += column == 0
    return page, state


@hyp_settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(1, 14) | st.integers(1, 3) | st.integers(8, 12), max_size=120),
    st.integers(2, 10),
    st.lists(st.integers(0, 120), max_size=6),
)
def test_chunk_sums_chain_to_the_loop(sizes, cap, cuts):
    edges = sorted({0, len(sizes), *[c for c in cuts if c < len(sizes)]})
    assert chained(sizes, cap, edges) == stepped(sizes, cap)


@hyp_settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(1, 14) | st.integers(1, 3), min_size=1, max_size=150),
    st.integers(2, 10),
    st.lists(st.integers(1, 149), max_size=8),
    st.booleans(),
)
def test_sums_of_sums_equal_the_sum_of_the_whole(sizes, cap, cuts, from_left):
    edges = sorted({0, len(sizes), *[c for c in cuts if c < len(sizes)]})
    sums = [_chunk_sums(sizes[lo:hi], cap) for lo, hi in zip(edges, edges[1:])]
    while len(sums) > 1:
        at = 0 if from_left else len(sums) - 2
        sums[at : at + 2] = [_join_sums(sums[at], sums[at + 1], cap)]
    head, ends = _chunk_sums(sizes, cap)
    assert (list(sums[0][0]), [tuple(e) for e in sums[0][1]]) == (head, [tuple(e) for e in ends])


def test_a_tree_of_chunks_equals_the_loop(spark, monkeypatch):
    """A chunk per 64 members, 100,000 members: no task sees more than FAN_IN sums."""
    monkeypatch.setattr(ordering, "CHUNK_BITS", 6)
    plain = P._starts

    def counted(sums, *rest):
        assert len(sums) <= 64
        return plain(sums, *rest)

    monkeypatch.setattr(P, "_starts", counted)
    check(spark, {"hot": 100_000, "b": 100, "z": 1}, 46, 12)


@pytest.mark.parametrize("fan_in", [2, 5])
def test_trees_of_many_levels(spark, monkeypatch, fan_in):
    monkeypatch.setattr(ordering, "CHUNK_BITS", 4)
    monkeypatch.setattr(P, "FAN_IN", fan_in)
    check(spark, {None: 300, "a": 40, "c": 900, "d": 1}, 8, 9)


def test_no_members(spark):
    _, df = members(spark, {"a": 3}, 5)
    got = P.pack_pages(df.limit(0))
    assert got.count() == 0 and got.columns == P.pack_pages(df).columns


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); print(f([3, 3, 3], 5), 'cartloom' in sys.modules)"
    out = subprocess.run(
        [sys.executable, "-c", code], input=cloudpickle.dumps(_chunk_sums), cwd=tmp_path, capture_output=True, check=True
    )
    assert out.stdout.decode().strip() == f"{_chunk_sums([3, 3, 3], 5)} False"


def members(spark, groups, longest):
    rng = random.Random(7)
    rows, next_id = [], 1
    for name, count in groups.items():
        for _ in range(count):
            slot = rng.choice([None, "a", "b"])
            rows.append((name, slot, None if slot is None else rng.choice(["1", "2"]),
                         rng.choice(["x", "y", None]), rng.choice(["p", None]), next_id,
                         rng.randint(1, longest), True))
            next_id += 1
    rng.shuffle(rows)
    schema = ("group_name string, description string, time string, lastname string, firstname string, "
              "id long, n int, has_header boolean")
    return rows, spark.createDataFrame(rows, schema)


def expected(rows, cap):
    def key(r):
        def last(v):
            return (v is None, v or "")
        return (last(r[0]), last(r[1]), last(r[2]), last(r[3]), last(r[4]), -r[6], r[5])

    want, first = {}, True
    for _, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        group = list(group)
        for r, place in zip(group, loop([g[6] for g in group], cap, first)):
            want[r[5]] = place
        first = False
    return want


def check(spark, groups, max_rows, longest):
    rows, df = members(spark, groups, longest)
    got = {r.id: (r.page_n, r.column_n, r.rows_ahead) for r in P.pack_pages(df, max_rows=max_rows).collect()}
    assert got == expected(rows, max_rows - 1)
    return got


def test_one_hot_group_over_many_chunks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, df = members(spark, {"hot": 3000}, 5)
        from cartloom.plans.ordering import ordered_slots

        chunks = ordered_slots(df, ["group_name"], [F.col("id").asc()]).select("chunk").distinct().count()
        assert chunks > 1
        check(spark, {"hot": 3000, "a": 40, "z": 1}, 12, 5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_chunks_are_cut_inside_a_partition(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_BITS", 6)
    _, df = members(spark, {"hot": 3000}, 5)
    slots = ordering.ordered_slots(df.coalesce(1), ["group_name"], [F.col("id").asc()])
    assert slots.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 64
    check(spark, {"hot": 3000, "a": 70, "z": 1}, 12, 5)


def test_members_longer_than_a_page(spark):
    # later groups whose first member is too long start on page 2, the first group does not
    check(spark, {"a": 30, "b": 30, "c": 3, "d": 1}, 8, 12)


def test_missing_group_name_sorts_last(spark):
    check(spark, {None: 20, "b": 20}, 10, 12)


def test_runs_are_packed_apart(spark):
    rows, df = members(spark, {"a": 10, "b": 10}, 12)
    both = df.withColumn("week", F.lit(1)).unionByName(
        df.withColumns({"week": F.lit(2), "id": F.col("id") + 1000})
    )
    got = P.pack_pages(both, 8, ["week"]).collect()
    want = expected(rows, 7)
    assert len(got) == 40
    for r in got:
        assert (r.page_n, r.column_n, r.rows_ahead) == want[r.id - (1000 if r.week == 2 else 0)]
