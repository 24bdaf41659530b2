"""Near duplicates by one-permutation hashing with optimal densification.

A text is the set of its distinct word shingles, as 64-bit hashes. One hash of each
shingle names a bin and a value; a bin keeps its least value. An empty bin borrows
from the first filled bin of a fixed random order of its own, the same for all
documents, so equal sets have equal sketches and a bin agrees with the chance of the
similarity. ``BANDS`` bands of ``ROWS`` bins are the buckets.

Documents with equal sets are one class, found by aggregation, and only one member
goes on. In each bucket, candidates form a star: every member is paired with one
hub only, so pairs grow with members, not with their square. The hub is the member
that shares most buckets with others: copies of one text differ from each other more
than from their centre, so the centre is the partner to test. Pairs are confirmed on
the full shingle sets. Members that a hub turns down form the next star among
themselves, until a round confirms nothing.

Stars do not see every pair of a bucket. So all documents of a bucket that still holds
several components are joined exactly, whatever the stars found: by a prefix filter on
their full sets, rare shingles first, with the bounds of length and position. Pairs of
one component need no test; a shingle that many hold is spread over blocks.

The joins that move sets and buckets are merge joins at every size, so that small and
large corpora run the same plan.

Components come from the confirmed pairs by least labels with pointer jumping.

Definitions: without words the set is empty and the document linked with nothing.
With fewer words than a shingle the whole sequence is its one shingle. Rows sharing a
``doc_id`` are one document for links and are returned row by row. A missing
``doc_id`` takes no part: its component is missing and ``kept`` true. An empty table
gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns of
any name do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import mix64, parts, pin_table, random64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A pair at similarity 0.85 misses all buckets with a chance of 4e-7, one at 0.8 of 5e-5.
BANDS, ROWS = 25, 5
#: So many documents look a shingle up in one block of the exact join.
BLOCK_DOCS = 512
SKETCH_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
SET_SCHEMA = "doc_id long, shingles array<long>"


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    lower = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(np.uint64)
    in_word = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], in_word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    sizes = ends - starts
    at = np.flatnonzero(in_word)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    factors = random64(int(sizes.max()), 11) | np.uint64(1)
    # multilinear hash of the bytes of each word
    words = np.add.reduceat((lower[at] + np.uint64(1)) * factors[place], np.cumsum(sizes) - sizes)
    words = mix64(words ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    mul = random64(width, 23) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    runs = np.zeros(len(words), np.uint64)
    for k in range(width):
        runs += padded[k : k + len(words)] * mul[k]
    runs = mix64(runs)
    first = np.searchsorted(starts, np.concatenate(([0], ends_of_text[:-1])))
    last = np.searchsorted(starts, ends_of_text)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            short = (words[a:b] * mul[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], np.uint64)) if b > a else np.empty(0, np.uint64))
    return out


def borrow_order(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for a filled one."""
    return np.argsort(random64(bins * bins, 37).reshape(bins, bins), axis=1)


def sketch(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Least value of each bin of a sorted set, empty bins filled from others."""
    bins = order.shape[0]
    where = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    value = mix64(shingles)
    by_value = np.argsort(value)[::-1]
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[where[by_value]] = value[by_value]
    filled[where] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        lender = order[empty, np.argmax(filled[order[empty]], axis=1)]
        out[empty] = out[lender]
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row per row of ``docs``: set size, two hashes of the whole set, the band hashes; pinned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = borrow_order(bands * rows)
        mul = random64(rows, 41) | np.uint64(1)
        salt = random64(bands, 43)
        for batch in batches:
            for part in parts(batch, "text", 2 << 20):
                sets = shingle_hashes(_bytes_of(part), width)
                sums = np.array([[mix64(s ^ np.uint64(5)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ np.uint64(9)))] for s in sets], np.uint64)
                some = [k for k, s in enumerate(sets) if len(s)]
                made = np.array([sketch(sets[k], order) for k in some], np.uint64).reshape(-1, bands, rows)
                hashed = _signed(mix64((made * mul).sum(axis=2, dtype=np.uint64) + salt)).reshape(-1)
                sizes = np.zeros(len(sets), np.int64)
                sizes[some] = bands
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.record_batch(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_signed(sums[:, 0].copy())), pa.array(_signed(sums[:, 1].copy())),
                        pa.ListArray.from_arrays(offsets, pa.array(hashed)),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return pin_table(chosen.mapInArrow(run, SKETCH_SCHEMA))


def _bytes_of(part: pa.RecordBatch) -> list[bytes]:
    return [b if b is not None else b"" for b in part.column("text").cast(pa.binary()).to_pylist()]


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 2 << 20):
                sets = shingle_hashes(_bytes_of(part), width)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(_signed(np.concatenate(sets)))
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SET_SCHEMA)


def stars(members: DataFrame) -> DataFrame:
    """``(doc_id, bucket, n)`` rows to distinct ``(doc_id, hub)`` with the bucket's hub."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_in")).filter("n_in > 1")
    crowded = pin_table(members.join(sizes.hint("merge"), "bucket"))
    central = crowded.groupBy("doc_id").agg(F.sum("n_in").alias("weight"))
    ranked = crowded.join(central.hint("merge"), "doc_id").select("bucket", "doc_id", "weight")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("least"))).alias("best"))
    hubs = hubs.select("bucket", (-F.col("best")["least"]).alias("hub"))
    return pin_table(crowded.join(hubs.hint("merge"), "bucket").select("bucket", "doc_id", "hub"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``doc_id``, ``hub``) whose sets have the similarity, by full intersection."""
    own = sets.select("doc_id", F.col("shingles").alias("own"))
    theirs = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("theirs"))
    both = F.size(F.array_intersect("own", "theirs"))
    union = F.size("own") + F.size("theirs") - both
    joined = pairs.join(own.hint("merge"), "doc_id").join(theirs.hint("merge"), "hub")
    return joined.filter(100 * both >= percent * union).select("doc_id", "hub")


def components(edges: DataFrame) -> DataFrame:
    """``doc_id``, ``component_id``: the least id reachable over the edges ``(doc_id, hub)``."""
    both = edges.unionByName(edges.select(F.col("hub").alias("doc_id"), F.col("doc_id").alias("hub")))
    both = pin_table(both)
    labels = pin_table(both.groupBy("doc_id").agg(F.least(F.min("hub"), F.first("doc_id")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"doc_id": "hub"}), "hub")
        lowest = near.groupBy("doc_id").agg(F.min("label").alias("near"))
        told = labels.join(lowest, "doc_id").select("doc_id", "label", F.least("label", "near").alias("new"))
        # a label is a node too: take over its label
        jump = labels.select(F.col("doc_id").alias("new"), F.col("label").alias("further"))
        after = pin_table(
            told.join(jump, "new", "left").select("doc_id", "label", F.least("new", F.coalesce("further", "new")).alias("new"))
        )
        changed = not after.filter("label <> new").isEmpty()
        labels = after.select("doc_id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component_id")


class Stars(NamedTuple):
    """Confirmed pairs, the first round's ``(bucket, doc_id, hub)``, and the shingle sets used; missing if there were none."""

    found: DataFrame | None
    placed: DataFrame
    sets: DataFrame | None


def _and(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _but(pairs: DataFrame, gone: DataFrame | None) -> DataFrame:
    return pairs if gone is None else pairs.join(gone, ["doc_id", "hub"], "left_anti")


def _star_rounds(docs: DataFrame, members: DataFrame, width: int, percent: int) -> Stars:
    """Stars over ``(doc_id, bucket)``, until a round confirms nothing."""
    found = tested = sets = used = first = None
    while True:
        placed = stars(members)
        first = placed if first is None else first
        pairs = placed.filter("doc_id <> hub").select("doc_id", "hub").distinct()
        pairs = pin_table(_but(pairs, tested))
        if pairs.isEmpty():
            return Stars(found, first, sets)
        if sets is None:
            needed = pairs.select("doc_id").union(pairs.select("hub")).distinct()
            texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed.hint("merge"), "doc_id", "left_semi")
            sets = used = pin_table(_one_set(shingle_sets(texts, width)))
        else:
            # later stars are made of members of this one, so each round moves only the sets still in play
            alive = placed.select("doc_id").distinct()
            used = pin_table(used.join(alive.hint("merge"), "doc_id", "left_semi"))
        linked = pin_table(confirmed(pairs, used, percent))
        tested = _and(tested, pairs)
        if linked.isEmpty():
            return Stars(found, first, sets)
        found = _and(found, linked)
        # hubs and what they are linked with leave the bucket
        members = _but(placed.filter("doc_id <> hub"), found).select("doc_id", "bucket")


def open_documents(placed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``doc_id``, ``component_id`` of the members of buckets in which pairs of two components are untested; pinned."""
    known = placed.select("bucket", "doc_id")
    if labels is None:
        known = known.withColumn("component_id", F.col("doc_id"))
    else:
        known = known.join(labels.hint("merge"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    least, most = F.min("component_id").alias("least"), F.max("component_id").alias("most")
    held = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), least, most)
    # the one pair of a bucket of two was tested by its star
    mixed = held.filter("n > 2 and least <> most").select("bucket")
    return pin_table(known.join(mixed.hint("merge"), "bucket", "left_semi").select("doc_id", "component_id").distinct())


def prefix_candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (``doc_id``, ``hub``) of two components of ``sets`` (``doc_id``, ``component_id``, ``shingles``) that can have the similarity.

    With shingles in one order for all, a pair's first common one lies in a prefix of
    both sets, and behind it there are enough for the intersection. The longer set looks
    up, in a prefix of ``1 - s``; the shorter is found by one of ``(1 - s) / (1 + s)``.
    """
    rows = sets.select("doc_id", "component_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_docs")).filter("n_docs > 1")
    held = rows.join(shared.hint("merge"), "shingle")
    # what no other holds comes first and is only counted
    listed = held.groupBy("doc_id", "component_id", "n").agg(F.sort_array(F.collect_list(F.struct("n_docs", "shingle"))).alias("some"))
    reach = F.expr(f"cast(n - ceil({percent} * n / 100) + 1 as int)")
    place = F.col("n") - F.size("some")
    first = F.slice("some", F.lit(1), F.greatest(reach - place, F.lit(0)))
    entries = listed.select("doc_id", "component_id", "n", place.alias("before"), F.posexplode(first).alias("k", "at"))
    entries = pin_table(entries.select("doc_id", "component_id", "n", (F.col("n") - F.col("before") - F.col("k")).alias("rest"), F.col("at")["shingle"].alias("shingle")))
    sizes = entries.groupBy("shingle", "component_id").agg(F.count(F.lit(1)).alias("n_in"))
    largest = F.max_by("component_id", F.struct("n_in", "component_id")).alias("largest")
    mixed = sizes.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_in").alias("n_all"), largest)
    mixed = mixed.filter("n_parts > 1").withColumn("blocks", F.expr(f"cast(1 + n_all div {BLOCK_DOCS} as int)"))
    placed = pin_table(entries.join(mixed.hint("merge"), "shingle").withColumn("in_largest", F.col("component_id") == F.col("largest")))
    # members of the largest component do not meet there: side 1 is for the others to look it up
    sides = F.when(F.col("in_largest"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    looking = placed.select(
        F.col("doc_id"), F.col("component_id"), "n", "rest", "shingle", F.explode(sides).alias("side"),
        F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)").alias("block"),
    )
    found = placed.filter(F.expr(f"rest >= ceil({2 * percent} * n / {100 + percent})")).select(
        F.col("doc_id").alias("hub"), F.col("component_id").alias("o_component"), F.col("n").alias("o_n"), F.col("rest").alias("o_rest"),
        "shingle", F.col("in_largest").cast("int").alias("side"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
    )
    met = looking.join(found.hint("merge"), ["shingle", "side", "block"])
    met = met.filter("component_id <> o_component and (n > o_n or n = o_n and doc_id > hub)")
    met = met.filter(f"100 * o_n >= {percent} * n and {100 + percent} * least(rest, o_rest) >= {percent} * (n + o_n)")
    return met.select("doc_id", "hub").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    rows_of = sketches(docs, width, bands, rows)
    key = ["set_a", "set_b", "n_shingles"]
    usable = rows_of.filter("n_shingles > 0 and doc_id is not null")
    # any member's bands will do: equal sets have equal bands
    classes = pin_table(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")))
    members = classes.select(F.col("rep").alias("doc_id"), F.posexplode("bands").alias("band", "hash"))
    first = _star_rounds(docs, members.select("doc_id", F.xxhash64("band", "hash").alias("bucket")), width, percent)
    joined = None if first.found is None else components(first.found)
    if first.sets is not None:
        left = open_documents(first.placed, joined)
        if not left.isEmpty():
            sets = pin_table(first.sets.join(left.hint("merge"), "doc_id"))
            more = pin_table(confirmed(pin_table(prefix_candidates(sets, percent)), sets, percent))
            if not more.isEmpty():
                known = [] if joined is None else [joined.filter("doc_id <> component_id").withColumnRenamed("component_id", "hub")]
                joined = components(reduce(DataFrame.unionByName, known, more))
    if joined is None:
        joined = rows_of.sparkSession.createDataFrame([], "doc_id long, component_id long")
    named = classes.select(*key, F.col("rep"))
    result = rows_of.select("doc_id", *key).join(named, key, "left")
    reach = joined.withColumnRenamed("doc_id", "rep")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "rep", "doc_id")).otherwise(F.col("doc_id"))
    out = result.join(reach, "rep", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _one_set(sets: DataFrame) -> DataFrame:
    """One set per id, also where rows share an id."""
    return sets.groupBy("doc_id").agg(F.max("shingles").alias("shingles"))


def keep_first(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns."""
    gone = judged.filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


