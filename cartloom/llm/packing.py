"""Mixture-controlled packing by deficit round-robin over source queues.

All documents of a source form a queue of tokens. Each window of ``WINDOW`` tokens
takes from every queue its weight's share, in whole tokens; what a queue is owed or has had
too much (its deficit) is carried into the next window. The *j*-th token of a queue of weight
*w* is due at ``(j + 1/2) / w``, and a window takes the tokens due earliest, so after any
number of windows each queue is within a token of its share for two queues, and within half
the number of queues in general. A queue that has run dry has no more tokens due, so
its part passes to the others in proportion to their weights. Without weights a queue's
weight is its number of tokens: all queues end together, and every window has the
proportions of the corpus.

The state after window *w* is the number of tokens taken from each queue among the
first ``w * WINDOW`` by due time. It follows from *w*, the totals and the weights alone, so every
partition computes the deficits at its own windows, and a document is cut without
seeing any other document: there is no sequential pass and no task per queue.

Queue order is the order of the tokenised table: its partitions, and rows inside
them. One row per partition and source carries the sums across.

Definitions: a missing or empty text is its end id. A missing source is a queue of
its own. Rows are packed one by one, so repeated rows and equal ids are packed as
often as they occur. All windows but the last are full; the last is shorter, and
padded unless its length is a power of two. An empty table gives no pieces. Only
``doc_id``, ``text`` and ``source`` are read, so further columns of any name do no
harm. The totals held by the driver and sent to workers are one number per source.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import TextEncoder, binary_rows, parts, pin_table
from cartloom.llm.token_output import TEXT_BYTES, id_width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 4096
QUEUE_SCHEMA = "part int, doc_id long, source string, local long, n_tokens long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def drained(totals: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """When queues run dry, in due time, and how many tokens are due by then; straight lines between."""
    times = np.unique(np.concatenate(([0.0], totals / weight)))
    return times, np.minimum(times[:, None] * weight, totals).sum(axis=1)


def taken(windows: np.ndarray, totals: np.ndarray, size: int = WINDOW, weights: np.ndarray | None = None) -> np.ndarray:
    """Tokens taken from each queue (columns) by the end of so many windows (rows).

    The first ``windows * size`` tokens in the order (due time, queue). A first guess
    is within half the number of queues of that; the rest is moved token by token.
    """
    n = int(totals.sum())
    goal = np.minimum(windows.astype(np.int64) * size, n)
    live = totals > 0
    weight = np.where(live, totals if weights is None else weights, 1).astype(np.float64)
    times, due = drained(totals, weight)
    count = np.where(live, np.floor(np.interp(goal, due, times)[:, None] * weight + 0.5), 0).astype(np.int64)
    count = np.clip(count, 0, totals)
    rows = np.arange(len(goal))
    while True:
        # the last token taken and the first not taken of each queue
        last = np.where(count > 0, (count - 0.5) / weight, -np.inf)
        following = np.where(live & (count < totals), (count + 0.5) / weight, np.inf)
        over = count.sum(axis=1) - goal
        late, early = last.shape[1] - 1 - np.argmax(last[:, ::-1], axis=1), np.argmin(following, axis=1)
        wrong_late, wrong_early = last[rows, late], following[rows, early]
        swap = (wrong_late > wrong_early) | ((wrong_late == wrong_early) & (late > early))
        drop, add = (over > 0) | ((over == 0) & swap), (over < 0) | ((over == 0) & swap)
        if not (drop.any() or add.any()):
            return count
        count[rows[drop], late[drop]] -= 1
        count[rows[add], early[add]] += 1


def queued(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The tokenised documents with their place in the partition's part of their queue; pinned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.on_worker(vocabulary, end_id)
        at, number = {}, TaskContext.get().partitionId()
        for batch in batches:
            for part in parts(batch, "text", TEXT_BYTES):
                (ids, sizes), local = encoder.encode(part.column("text")), []
                for source, n in zip(part.column("source").to_pylist(), sizes.tolist(), strict=True):
                    local.append(at.get(source, 0))
                    at[source] = local[-1] + n
                yield pa.record_batch(
                    [
                        pa.array(np.full(part.num_rows, number, np.int32)), part.column("doc_id"), part.column("source"),
                        pa.array(local, pa.int64()), pa.array(sizes), binary_rows(ids, sizes),
                    ],
                    ["part", "doc_id", "source", "local", "n_tokens", "ids"],
                )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return pin_table(chosen.mapInArrow(run, QUEUE_SCHEMA))


def cut(
    begin: int, n: int, queue: int, totals: np.ndarray, bounds: dict[int, np.ndarray], size: int = WINDOW,
    weights: np.ndarray | None = None,
) -> list:
    """``(start, length, window, offset)`` of the pieces of tokens ``begin`` to ``begin + n`` of a queue.

    ``bounds`` remembers the states of windows already computed.
    """

    def state(w: int) -> np.ndarray:
        if w not in bounds:
            if len(bounds) > 4096:
                bounds.clear()
            near = np.arange(w, w + 32)
            bounds.update(zip(near.tolist(), taken(near, totals, size, weights), strict=True))
        return bounds[w]

    # the token's due time tells its window, but for half a token a queue
    weight = np.where(totals > 0, totals if weights is None else weights, 1).astype(np.float64)
    w = int(np.minimum((begin + 0.5) / weight[queue] * weight, totals).sum() // size)
    while state(w)[queue] > begin:
        w -= 1
    while state(w + 1)[queue] <= begin:
        w += 1
    out, at, end = [], begin, begin + n
    while at < end:
        low, high = state(w), state(w + 1)
        stop = min(end, int(high[queue]))
        if stop > at:
            before = int((high[:queue] - low[:queue]).sum())
            out.append((at - begin, stop - at, w, before + at - int(low[queue])))
            at = stop
        w += 1
    return out


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, weights: dict[str | None, float] | None = None
) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each, and its ids.

    ``weights``: the proportions of the sources in every window as long as they last, a source
    that is not named counting as 1; those of the corpus if missing.
    """
    if weights is not None and min(weights.values(), default=1) <= 0:
        raise ValueError("weights must be greater than zero")
    dtype, _ = id_width(vocabulary)
    queue = queued(docs, vocabulary, end_id)
    sums = queue.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    across = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = pin_table(sums.withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0))))
    found = sums.groupBy("source").agg(F.sum("n").alias("n")).collect()
    listed = sorted(((r.source, r.n) for r in found), key=lambda s: (s[0] is None, s[0] or ""))
    number = {source: k for k, (source, _) in enumerate(listed)}
    totals = np.array([n for _, n in listed], np.int64)
    wanted = None if weights is None else np.array([weights.get(source, 1) for source, _ in listed], np.float64)
    begins = sums.select(F.col("part").alias("__part"), F.col("source").alias("__source"), "before")
    same = (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source"))
    placed = queue.join(begins, same).select(
        "doc_id", "source", (F.col("before") + F.col("local")).alias("begin"), "n_tokens", "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in parts(batch, "ids", 1 << 20):
                yield _pieces(part, number, totals, bounds, dtype, wanted)

    return placed.mapInArrow(run, PIECE_SCHEMA)


def _pieces(
    part: pa.RecordBatch, number: dict, totals: np.ndarray, bounds: dict, dtype: np.dtype, weights: np.ndarray | None
) -> pa.RecordBatch:
    rows, ids = [], []
    columns = (part.column(k).to_pylist() for k in ("doc_id", "source", "begin", "n_tokens", "ids"))
    for doc, source, begin, n, raw in zip(*columns, strict=True):
        wide = np.frombuffer(raw, dtype).astype("<u4").tobytes()
        for start, length, window, offset in cut(begin, n, number[source], totals, bounds, weights=weights):
            rows.append((doc, source, start, length, n, window, offset))
            ids.append(wide[4 * start : 4 * (start + length)])
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
    return pa.record_batch(
        [*arrays, pa.array(ids, pa.binary())],
        ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def padded_length(length: int, size: int = WINDOW) -> int:
    """Of a sequence with so many tokens: its own if a power of two, else the full window."""
    return length if length & (length - 1) == 0 else size


def sequences(pieces: DataFrame, pad_id: int) -> DataFrame:
    """The sequences as rows: ``sequence_id``, ``n_tokens``, ``ids`` (padded, little-endian 32-bit).

    A sequence has at most ``WINDOW`` pieces, so each group is bounded.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.array([pad_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for row in batch.column("pieces").to_pylist():
                raw = b"".join(p["ids"] for p in row)
                n = len(raw) // 4
                out.append((n, raw + pad * (padded_length(n) - n)))
            yield pa.record_batch(
                [batch.column("sequence_id"), pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())],
                ["sequence_id", "n_tokens", "ids"],
            )

    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return grouped.mapInArrow(join, "sequence_id long, n_tokens long, ids binary")


