"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters. The distinct
blocks are sorted and numbered, so equal blocks have equal integer names. Adjacent
names are then paired, the distinct pairs sorted and numbered in turn, until each
document has one name. Two documents get the same (level, name) only if all their
blocks are equal: names compare contents, not digests.

Moving block texts twice would double the traffic. Blocks are therefore grouped by
a 64-bit hash that only routes: each hash keeps the set of its blocks, and where that
has more than one, blocks of that hash are numbered by content instead. All
grouping is by partial aggregation and the joins back put one row per name against
the rows, so a block, pair or text that a third of all rows hold stays spread out.

Definitions: a missing text counts as empty; an empty text is one empty block, so
all empty texts are equal. Rows with equal ``doc_id`` and equal text are one
document and returned once, ``copies`` telling how many rows it had. A missing
``doc_id`` sorts behind all others: such a document stays only if all of its group
lack an id. A text may be of any length: it is cut in one pass and its blocks are rows, so
only the cutting task holds it whole. An empty table gives an empty result. Only ``doc_id`` and ``text`` are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import SPACE, let, pin_table

BLOCK_CHARS = 4096
KEY = ("doc_id", "text_key")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def document_key(text: Column) -> Column:
    """Tells apart rows that share a ``doc_id`` but not the text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """``right`` with renamed keys, and the condition that missing keys equal missing keys."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__{k}"])
    return renamed, cond


def _join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    renamed, cond = _same(left, right, keys)
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def _by_order(distinct: DataFrame, *order: str) -> DataFrame:
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Sorted inside each partition and numbered; written once, so numbers never change."""
    return pin_table(_by_order(distinct, *order))


def blocks_of(docs: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    text = normalised(F.col("text"))

    def cut(t: Column) -> Column:
        # one pass over the text: a substring by number would count characters from the start each time
        return F.when(t == "", F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), document_key(F.col("text")).alias("text_key"),
        F.posexplode(let(text, cut)).alias("pos", "block"),
    )
    return rows.withColumn("route", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits))


def _name_blocks(docs: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    """One row per document and block with the block's name."""
    blocks = blocks_of(docs, block_chars, hash_bits)
    # one block a hash but for chance, so the sets are as good as single blocks
    met = blocks.groupBy("route").agg(F.collect_set("block").alias("blocks"))
    found = met.select("route", F.array_min("blocks").alias("low"), (F.size("blocks") > 1).alias("shared"))
    named = pin_table(_by_order(found, "low").drop("low"))
    refs = blocks.select(*KEY, "pos", "route").groupBy(*KEY, "pos").agg(F.max("route").alias("route"))
    plain = refs.join(named.filter(~F.col("shared")), "route").select(*KEY, "pos", "name")
    clashing = named.filter("shared").select("route")
    if clashing.isEmpty():
        return plain
    # different blocks with one hash: number them by content, below zero
    inside = blocks.join(clashing, "route", "left_semi")
    own = _numbered(inside.select("block").distinct(), "block")
    rest = inside.join(own, "block").select(*KEY, "pos", (-F.col("name") - 1).alias("name")).distinct()
    return plain.unionByName(rest)


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """``doc_id``, ``text_key``, ``level``, ``name``: equal (level, name) if and only if equal texts."""
    todo = pin_table(_name_blocks(docs, block_chars, hash_bits))
    longest = todo.agg(F.max("pos")).first()[0]
    done, level = [], 0
    while longest is not None and longest > 0:
        pairs = todo.groupBy(*KEY, F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        if level == 0:
            # texts of one block are finished and take no further part
            last = pairs.filter((F.col("pos") == 0) & F.col("right").isNull())
            done.append(last.select(*KEY, F.lit(0).alias("level"), F.col("left").alias("name")))
            whole = pairs.withColumn("single", (F.col("pos") == 0) & F.col("right").isNull())
            pairs = whole.filter(~F.col("single")).drop("single")
        names = _numbered(pairs.select("left", "right").distinct(), "left", "right")
        level += 1
        todo = pin_table(_join(pairs, names, ("left", "right"), "inner").select(*KEY, "pos", "name"))
        longest //= 2
    rest = todo.select(*KEY, F.lit(level).alias("level"), "name")
    for part in done:
        rest = rest.unionByName(part)
    return rest


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """``doc_id``, ``text_key``, ``copies``, ``keep_id``, ``group_size``, ``kept`` for every document."""
    named = pin_table(identities(docs, block_chars, hash_bits))
    rows = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), document_key(F.col("text")).alias("text_key")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    groups = named.groupBy("level", "name").agg(
        F.min("doc_id").alias("keep_id"), F.min(F.struct("doc_id", "text_key")).alias("least"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    with_group = _join(named, groups, ("level", "name"), "inner")
    stays = F.coalesce("first", "least")
    judged = with_group.select(
        *KEY, "keep_id", "group_size",
        (F.struct("doc_id", "text_key").eqNullSafe(stays)).alias("kept"),
    )
    return _join(judged, rows, KEY, "inner").select(*KEY, "copies", "keep_id", "group_size", "kept")


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one row for each kept document, with all its columns."""
    marked = docs.withColumns({"__key": document_key(F.col("text")), "__id": F.col("doc_id").cast("long")})
    kept = judged.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"), "copies")
    cond = marked["__id"].eqNullSafe(kept["k_id"]) & (marked["__key"] == kept["k_key"])
    single = marked.join(kept.filter("copies = 1"), cond, "left_semi")
    repeated = marked.join(kept.filter("copies > 1"), cond, "left_semi").dropDuplicates(["__id", "__key"])
    return single.unionByName(repeated).select(*docs.columns)



