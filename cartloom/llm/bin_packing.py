"""Best-fit packing by minimum bin slack.

A document of more than ``WINDOW`` tokens is cut into pieces of ``WINDOW`` from its end, so
that only its first piece may be shorter; a full piece is a sequence by itself. All other
pieces are packed by minimum bin slack: a bin takes the longest piece left, and a subset-sum
over the lengths that are left, kept as the bits of one integer, finds the combination that
fills it best; these pieces are removed and the next bin is filled.

What decides is only how many pieces have each length, at most ``WINDOW`` numbers whatever
the corpus. Bins that are filled alike follow each other, because a combination stays the best
one until a length of it runs short. So the plan is one row per kind of bin and length: the
driver makes it from the counts, in a time that depends on ``WINDOW`` and not on the input.
Pieces find their bin by their rank among the pieces of the same length, and a rank is the
sum of the counts of all earlier partitions plus the place in the own one: no order of pieces,
and no task that sees all pieces of a frequent length. Tokens move once at most, to the counts of
their partition, where these are too many to broadcast.

Definitions: a missing or empty text is its end id. Rows are packed one by one, so repeated
rows and equal ids are packed as often as they occur, each on its own. A text is tokenised
whole in the memory of one task, however long. Of combinations that fill a bin equally, the one
with the longest pieces is taken; pieces of equal length are taken in the order of the
tokenised table. An empty table gives no pieces. Only ``doc_id`` and ``text`` are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import TextEncoder, binary_rows, parts, pin_table
from cartloom.llm.token_output import TEXT_BYTES, id_width

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 1024
RANKED_SCHEMA = "part int, doc_id long, n_tokens long, first long, first_rank long, full_rank long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum up to ``room``; the longest pieces where sums tie.

    Bit *s* of ``reach[k]`` says that the lengths after the first *k*, longest first, can sum to *s*.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for n in reversed(lengths):
        bits, left, step = reach[-1], min(counts[n], room // n), 1
        while left:
            # 1, 2, 4, ... and the rest: any number of pieces up to ``left``
            step = min(step, left)
            bits |= bits << (n * step) & mask
            left -= step
            step *= 2
        reach.append(bits)
    reach.reverse()
    total, chosen = reach[0].bit_length() - 1, {}
    for k, n in enumerate(lengths):
        for take in range(min(counts[n], total // n), -1, -1):
            if reach[k + 1] >> (total - take * n) & 1:
                break
        if take:
            chosen[n] = take
            total -= take * n
    return chosen


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go: of each row, the pieces ``low`` to ``high`` (ranks) of ``length``.

    Bins ``sequence``, ``sequence + 1``, ... take ``copies`` of them each, from ``offset`` on.
    """

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        if not len(lengths):
            return lengths, ranks
        # rows are in order of (length, low), so the row of a piece is the last that does not lie behind it
        first = np.searchsorted(self.length, lengths)
        row = np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            a, b = first[mine[0]], np.searchsorted(self.length, n, "right")
            row[mine] = a + np.searchsorted(self.low[a:b], ranks[mine], "right") - 1
        place = ranks - self.low[row]
        bin_, slot = place // self.copies[row], place % self.copies[row]
        return self.sequence[row] + bin_, self.offset[row] + slot * lengths


def minimum_slack(counts: dict[int, int], size: int = WINDOW) -> Plan:
    """The bins of minimum bin slack for so many pieces of each length, as runs of equal bins."""
    left = {int(n): int(c) for n, c in counts.items() if c}
    used, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, size - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        # the same combination is the fullest again until a length of it runs short
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for n in sorted(chosen, reverse=True):
            taken = chosen[n] * times
            rows.append((n, used[n], used[n] + taken, sequence, chosen[n], offset))
            offset += n * chosen[n]
            used[n] += taken
            left[n] -= taken
            if not left[n]:
                del left[n]
        sequence += times
    rows.sort()
    return Plan(*(np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 6)))


def _rank_in_turn(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many equal values come earlier, on top of ``before`` (by value), which is moved on."""
    order = np.argsort(values, kind="stable")
    run = values[order]
    first = np.flatnonzero(np.diff(run, prepend=-1))
    sizes = np.diff(np.append(first, len(run)))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(run)) - np.repeat(first, sizes) + before[run]
    before[run[first]] += sizes
    return rank


def ranked(docs: DataFrame, vocabulary: str, end_id: int, size: int = WINDOW) -> DataFrame:
    """The tokenised documents; pinned.

    ``first``: length of the first piece; ``first_rank`` and ``full_rank``: how many pieces of
    that length, and of the full one, come earlier in the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = TextEncoder.on_worker(vocabulary, end_id), np.zeros(size + 1, np.int64)
        number, full_before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in parts(batch, "text", TEXT_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                full = counts // size
                # a document of whole windows only has no shorter piece: length 0
                first = counts - full * size
                full_rank = full_before + np.cumsum(full) - full
                full_before += int(full.sum())
                columns = [np.full(len(counts), number, np.int32), part.column("doc_id"), counts, first, _rank_in_turn(first, before), full_rank]
                yield pa.record_batch(
                    [*map(pa.array, columns), binary_rows(ids, counts)],
                    ["part", "doc_id", "n_tokens", "first", "first_rank", "full_rank", "ids"],
                )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return pin_table(chosen.mapInArrow(run, RANKED_SCHEMA))


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = WINDOW) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each, and its ids."""
    dtype, _ = id_width(vocabulary)
    rows = ranked(docs, vocabulary, end_id, size)
    # one row per partition and length
    sums = rows.groupBy("part", "first").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"n_tokens div {size}")).alias("n_full"))
    lengths = sums.select("part", F.explode(F.expr(f"array(struct(first AS length, n), struct({size}L AS length, n_full AS n))")).alias("x"))
    # the full length gets a row from each length, so it is summed up before the running sum
    per_part = pin_table(lengths.select("part", "x.*").groupBy("part", "length").agg(F.sum("n").alias("n")).filter("n > 0 AND length > 0"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most ``size`` lengths
    n_full = counts.pop(size, 0)
    plan = minimum_slack(counts, size)
    across = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_part.withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0))).drop("n")
    begins = begins.withColumnsRenamed({"part": "__part", "length": "__length"})
    first = begins.filter(f"__length < {size}")
    full = begins.filter(f"__length = {size}").select(F.col("__part").alias("__full_part"), F.col("before").alias("full_before"))
    placed = (
        rows.join(first, F.expr("part = __part AND first = __length"), "left")
        .join(full, F.expr("part = __full_part"), "left")
        .select(
            "doc_id", "n_tokens", "first", (F.coalesce("before", F.lit(0)) + F.col("first_rank")).alias("first_rank"),
            (F.coalesce("full_before", F.lit(0)) + F.col("full_rank")).alias("full_rank"), "ids",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "ids", 4 << 20):
                yield _pieces(part, plan, n_full, dtype, size)

    return placed.mapInArrow(run, PIECE_SCHEMA)


def _pieces(part: pa.RecordBatch, plan: Plan, n_full: int, dtype: np.dtype, size: int) -> pa.RecordBatch:
    """Whole windows are the sequences 0 to ``n_full - 1``, the bins of the plan follow."""
    n_tokens, first, first_rank, full_rank = (
        part.column(k).to_numpy() for k in ("n_tokens", "first", "first_rank", "full_rank")
    )
    full, short = n_tokens // size, first > 0
    pieces = full + short
    total = int(pieces.sum())
    doc = np.repeat(np.arange(len(pieces)), pieces)
    number = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    is_short = short[doc] & (number == 0)
    length = np.where(is_short, first[doc], size)
    nth_full = number - short[doc]
    start = np.where(is_short, 0, first[doc] + nth_full * size)
    sequence, offset = np.where(is_short, 0, full_rank[doc] + nth_full), np.zeros(total, np.int64)
    sequence[is_short], offset[is_short] = plan.place(first[short], first_rank[short])
    sequence[is_short] += n_full
    ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), dtype).astype("<u4")
    columns = [number.astype(np.int32), start, length, n_tokens[doc], sequence, offset]
    return pa.record_batch(
        # pieces of a document follow each other, so the ids are cut in place
        [part.column("doc_id").take(pa.array(doc)), *map(pa.array, columns), binary_rows(ids, length)],
        ["doc_id", "piece", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences as rows: ``sequence_id``, ``n_tokens``, ``ids``.

    A sequence has at most ``WINDOW`` pieces, so each group is bounded.
    """
    grouped = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    empty = F.expr("X''")
    return grouped.select("sequence_id", "n_tokens", F.aggregate("parts.ids", empty, lambda a, b: F.concat(a, b)).alias("ids"))
