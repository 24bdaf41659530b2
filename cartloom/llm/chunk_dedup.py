"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte's random number is added to the
hash shifted left, so a position's hash depends on the last ``GEAR_BYTES`` bytes only.
A chunk ends where the hash is the least within ``REACH`` positions on either side.
Cuts thus follow from the text around them alone: after an insertion the next cuts are
the old ones, chunks have a least size without a cut depending on the cut before, and a
passage of some 50 words has whole chunks of its own wherever it stands.

Chunks are compared by 128-bit digests. Digests that occur more than once are found by
partial aggregation and joined back; the first occurrence by (doc_id, start) stays, the
others are repeats. Adjacent repeated chunks are merged into spans, and stretches of spans under
``MIN_CHARS`` are left alone, as common phrases are no passages.

Definitions: missing and empty texts have no chunks. Texts without a cut (shorter than
``REACH``, or one character repeated) are a single chunk. Repeats inside a document
count like repeats across documents. Texts that share a ``doc_id``, or have none, are documents
of their own; rows repeated whole are one document. A missing ``doc_id`` sorts behind all
others. A text may be of any length: it is chunked whole in one task. An
empty table gives no spans. Only ``doc_id`` and ``text`` are read, so further columns of
any name do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import parts, random64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GEAR_BYTES = 16
REACH = 24
MIN_CHARS = 64
CHUNK_SCHEMA = "doc_id long, text_key long, start int, end int, digest_a long, digest_b long"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: two bits of shift a byte, 16 bytes in 32 bits."""
    h = random64(256, 53).astype(np.uint32)[data]
    span = 1
    while span < GEAR_BYTES:
        # the hash over twice as many bytes, from two neighbouring ones
        h[span:] = h[span:] + (h[:-span] << np.uint32(2 * span))
        span *= 2
    return h


def _least_of_next(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each position and the ``n - 1`` after it."""
    out, span = h.copy(), 1
    while span * 2 <= n:
        out[:-span] = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = n - span
    if rest:
        out[:-rest] = np.minimum(out[:-rest], out[rest:])
    return out


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions whose hash is under all of the ``REACH`` before and none above it after."""
    h = gear_hashes(data)
    least = _least_of_next(h, REACH)
    cuts = np.zeros(len(h), bool)
    if len(h) > 2 * REACH:
        inner = slice(REACH, len(h) - REACH)
        cuts[inner] = (h[inner] < least[: len(h) - 2 * REACH]) & (h[inner] <= least[REACH + 1 : len(h) - REACH + 1])
    return np.flatnonzero(cuts)


def chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, start, end, digests)`` of all chunks; starts and ends in characters."""
    import xxhash

    gap = GEAR_BYTES + 2 * REACH
    pad = b"\0" * gap
    joined = pad + pad.join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = gap + np.cumsum(sizes + gap) - (sizes + gap)
    end = begin + sizes
    cuts = cut_points(data) + 1
    # never inside a character
    for _ in range(3):
        inside = (data[np.minimum(cuts, len(data) - 1)] & 0xC0) == 0x80
        cuts = cuts - inside
    owner = np.searchsorted(begin, cuts, "right") - 1
    valid = (owner >= 0) & (cuts > begin[owner]) & (cuts < end[owner])
    some = sizes > 0
    marks = np.unique(np.concatenate([cuts[valid], begin[some], end[some]]))
    owner = np.searchsorted(begin, marks, "right") - 1
    last = marks == end[owner]
    starts, ends, owner = marks[~last], marks[np.flatnonzero(~last) + 1], owner[~last]
    view = memoryview(joined)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    digests = np.frombuffer(raw, "<i8").reshape(-1, 2)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return owner, chars[starts] - chars[begin[owner]], chars[ends] - chars[begin[owner]], digests


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: ``doc_id``, ``text_key``, ``start``, ``end`` (code points) and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 2 << 20):
                texts = [b if b is not None else b"" for b in part.column("text").cast(pa.binary()).to_pylist()]
                owner, start, end, digests = chunk(texts)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(owner)), part.column("text_key").take(pa.array(owner)), pa.array(start.astype(np.int32)),
                        pa.array(end.astype(np.int32)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                    ],
                    ["doc_id", "text_key", "start", "end", "digest_a", "digest_b"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key()).mapInArrow(run, CHUNK_SCHEMA)


def text_key() -> Column:
    """Tells apart texts that share a ``doc_id``."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def repeated_spans(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Spans whose chunks occur more than once.

    ``doc_id``, ``text_key``, ``start``, ``end`` (code points), ``n_chunks``, ``removed`` (false for
    the occurrence that stays) and ``first_doc_id`` (where its first chunk stays).
    """
    rows = chunks(docs)
    key = ["digest_a", "digest_b"]
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("text_key").alias("t"), F.col("start").alias("s"))
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    repeats = rows.join(found.drop("n"), key)
    text = ["doc_id", "text_key"]
    marked = repeats.select(*text, "start", "end", (place != F.col("first")).alias("removed"), F.col("first")["d"].alias("first_doc_id"))
    # a row repeated whole has each chunk twice
    once = marked.groupBy(*text, "start", "end").agg(F.max("removed").alias("removed"), F.min("first_doc_id").alias("first_doc_id"))
    inside = Window.partitionBy(*text).orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.lag("end").over(inside), F.lit(True))
    changed = F.coalesce(F.col("removed") != F.lag("removed").over(inside), F.lit(False))
    begun = once.withColumns({"__apart": apart.cast("int"), "__new": (apart | changed).cast("int")})
    runs = begun.withColumns({"__stretch": F.sum("__apart").over(inside), "__run": F.sum("__new").over(inside)})
    spans = runs.groupBy(*text, "__stretch", "__run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"),
        F.first("removed").alias("removed"), F.min("first_doc_id").alias("first_doc_id"),
    )
    # a passage of which some stays here and some elsewhere is one stretch
    whole = Window.partitionBy(*text, "__stretch")
    size = F.max("end").over(whole) - F.min("start").over(whole)
    return spans.withColumn("__size", size).filter(F.col("__size") >= min_chars).drop("__stretch", "__run", "__size")


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the removed spans taken out of their texts."""
    keys = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")]
    cut = spans.filter("removed").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    joined = docs.join(cut, same, "left")
    text = F.col("text")

    def remains(spans_of: Column) -> Column:
        begin = F.transform(spans_of, lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans_of, i - 1)["end"]))
        kept = F.zip_with(begin, spans_of, lambda b, s: F.substring(text, b + 1, s["start"] - b))
        tail = F.substring(text, F.element_at(spans_of, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(kept, ""), tail)

    return joined.withColumn("text", F.when(F.col("__cut").isNull(), text).otherwise(remains(F.col("__cut")))).select(*docs.columns)


