"""Token ids as files: frequency ranks in byte-aligned variable-length code.

Ids are replaced by their rank in the corpus, the most frequent first, so that
common ids take one byte. Four ranks share one control byte with two bits each
for the number of data bytes; control bytes and data bytes are kept apart. The
reader turns control bytes into lengths with a table and gathers the values with
numpy, without a loop over ids.

A data set is a folder of Parquet shards in ascending ``doc_id`` order (missing
ids first, rows of one id by a hash of their tokens), one row per document with its
place in the shard, beside a table of the ids by rank. Shards are written by Spark's
own writer, so a lost executor costs a retry and no half-written shard is ever seen.

Empty and missing texts hold the end id alone. Repeated rows are written as often
as they occur, one after another. Rows without an id, or with the same one, are
spread by that hash like all others. An empty table gives an empty data set. A text
is one row of a shard, however long: it is coded whole in the memory of a task. Only
``doc_id`` and ``text`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.llm.common import TextEncoder, binary_rows, parts, pin_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDS_SCHEMA = "doc_id long, n_tokens long, ids binary"
SHARD_SCHEMA = "shard int, begin long, doc_id long, n_tokens long, control binary, data binary"
#: Text that is encoded at once; a longer text is encoded by itself.
TEXT_BYTES = 4 << 20
#: Data bytes of the four values of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Code the ranks of several documents at once; ``counts`` says how many each has."""
    padded = (counts + 3) // 4 * 4
    starts, pad_starts = np.cumsum(counts) - counts, np.cumsum(padded) - padded
    slot = np.arange(len(ranks)) + np.repeat(pad_starts - starts, counts)
    values = np.zeros(int(padded.sum()), np.uint32)
    values[slot] = ranks
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = (size - 1).reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    real = np.zeros(len(values), bool)
    real[slot] = True
    # padding has a control entry but no data byte
    keep = (np.arange(4) < size[:, None]) & real[:, None]
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[keep]
    data_ends = np.cumsum(keep.sum(axis=1))
    out, raw_control, raw_data, before = [], control.tobytes(), data.tobytes(), 0
    for p, n in zip(pad_starts.tolist(), padded.tolist(), strict=True):
        end = int(data_ends[p + n - 1]) if n else before
        out.append((raw_control[p // 4 : (p + n) // 4], raw_data[before:end]))
        before = end
    return out


def decode_ranks(controls: list[bytes], datas: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ranks of several documents, one after another."""
    padded = (counts + 3) // 4 * 4
    size = LENGTHS[np.frombuffer(b"".join(controls), np.uint8)].reshape(-1)
    starts, pad_starts = np.cumsum(counts) - counts, np.cumsum(padded) - padded
    slot = np.arange(int(counts.sum())) + np.repeat(pad_starts - starts, counts)
    size = size[slot].astype(np.int64)
    data = np.frombuffer(b"".join(datas) + b"\0\0\0", np.uint8)
    at = np.cumsum(size) - size
    values = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        values[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def tokenize(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """``doc_id``, ``n_tokens`` (with the end id) and the ids as little-endian bytes, pinned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.on_worker(vocabulary, end_id)
        for batch in batches:
            for part in parts(batch, "text", TEXT_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(counts), binary_rows(ids, counts)], ["doc_id", "n_tokens", "ids"]
                )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return pin_table(chosen.mapInArrow(run, IDS_SCHEMA), compression="zstd")


def id_width(vocabulary: str) -> tuple[np.dtype, int]:
    from tokenizers import Tokenizer

    n = Tokenizer.from_file(vocabulary).get_vocab_size()
    return np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4"), n


def ids_by_rank(tokens: DataFrame, dtype: np.dtype, n_ids: int) -> np.ndarray:
    """All ids of the vocabulary, the most frequent of the corpus first, ties by id.

    The result has one entry per id of the vocabulary, whatever the corpus holds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for part in parts(batch, "ids", 8 << 20):
                joined = b"".join(part.column("ids").to_pylist())
                total += np.bincount(np.frombuffer(joined, dtype), minlength=n_ids)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    total = np.zeros(n_ids, np.int64)
    total[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return np.lexsort((np.arange(n_ids), -total))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0) -> None:
    """Write the shards to ``folder``/shards and the ids by rank to ``folder``/ranks."""
    spark = docs.sparkSession
    dtype, n_ids = id_width(vocabulary)
    tokens = tokenize(docs, vocabulary, end_id)
    order = ids_by_rank(tokens, dtype, n_ids)
    rank_of = np.empty(n_ids, np.uint32)
    rank_of[order] = np.arange(n_ids, dtype=np.uint32)
    # bounded by the vocabulary
    ranks = pa.table({"rank": np.arange(n_ids), "id": order})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, begin = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in parts(batch, "ids", 4 << 20):
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), dtype)
                counts = part.column("n_tokens").to_numpy()
                coded = encode_ranks(shared.value[ids], counts)
                yield pa.record_batch(
                    [
                        pa.array(np.full(part.num_rows, shard, np.int32)), pa.array(begin + np.cumsum(counts) - counts),
                        part.column("doc_id"), part.column("n_tokens"),
                        pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary()),
                    ],
                    ["shard", "begin", "doc_id", "n_tokens", "control", "data"],
                )
                begin += int(counts.sum())

    # one id may hold many rows: a hash of the tokens cuts them too, the tokens settle ties
    order_keys = ["doc_id", F.xxhash64("ids"), "ids"]
    ordered = tokens.repartitionByRange(*order_keys[:2]).sortWithinPartitions(*order_keys)
    coded = ordered.mapInArrow(code, SHARD_SCHEMA)
    # the code is dense already; other compression would only cost time
    coded.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{folder}/shards")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``shard``, ``begin`` (tokens before it in the shard), ``doc_id``, ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit) of each document."""
    order = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toArrow().column("id").to_numpy().astype("<u4")
    shared = spark.sparkContext.broadcast(order)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "data", 2 << 20):
                yield _decoded(part, shared.value)

    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{folder}/shards")
    return shards.mapInArrow(decode, "shard int, begin long, doc_id long, n_tokens long, ids binary")


def _decoded(part: pa.RecordBatch, order: np.ndarray) -> pa.RecordBatch:
    counts = part.column("n_tokens").to_numpy()
    ranks = decode_ranks(part.column("control").to_pylist(), part.column("data").to_pylist(), counts)
    names = ["shard", "begin", "doc_id", "n_tokens"]
    return pa.record_batch([*map(part.column, names), binary_rows(order[ranks], counts)], [*names, "ids"])


def token_digest(read: DataFrame) -> DataFrame:
    """Per document: ``start`` (ids of all documents before it), ``n_tokens`` and the crc32 of its ids.

    The place in the shard is in the files; one sum per shard gives the ids of the shards before it.
    """
    rows = pin_table(read.select("shard", "begin", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    # one row per shard
    before = F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")
    offsets = sums.select("shard", before.alias("shard_start"))
    return rows.join(offsets, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )
