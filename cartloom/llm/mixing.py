"""Mixing sources to target weights by a low-discrepancy schedule.

Global slot *i* of the mix has the van der Corput point of *i* (its bits in reverse, behind
the point). The sources share the interval from 0 to 1 by their numbers of blocks, cumulated,
and the source whose share holds the point gets the slot. A source's slots are ranked in order,
and slot of rank *r* takes its block *r*. Points of any run of slots fill the interval
evenly, so any run follows the targets closely.

A block has equal tokens (words) of one source: its documents in hashed order, over again from
the start when it is used up, are cut into blocks; the last one ends where the source's target
does, so the words taken are the target to a word. A source that has few words to give is
cut into shorter blocks, ``LEAST_SLOTS`` of them, so that it is spread over the mix too.

The grid of points has a power of two of them, at least as many as there are blocks; slots of a
source beyond its last block stay empty, at the end of the schedule. The bits of a slot
are found one by one from its rank, by counting the points of the source in each half of what
is left: the schedule is a function of the block, and needs no table or order of all slots.

Order and running sums use chunks: the leading bits of a document's hash, as many as keep a
chunk to ``CHUNK_ROWS`` rows. One row per source and chunk carries the sums across, so no source
is ever gathered in one task, whatever its share of the rows. Sources are a table that is
joined; the driver holds one entry per source to work out the targets.

Definitions: a source's weight follows its rank by code point, a missing source
being last; targets stop at ``MAX_PASSES`` times the source and the excess goes to
the others by weight. A missing or empty text has size 0 and is never taken. Rows
with equal ``doc_id``, source and text are one document (``copies`` rows), taken
and counted once. An empty table gives an
empty mix. Reruns agree, as every order is one of values. Only ``doc_id``, ``text``
and ``source`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import n_words_of, pin_table, text_or_empty, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: A block is a 20,000th of the corpus, but not over so many words: small corpora are mixed as finely.
BLOCK_WORDS = 2048
BLOCKS = 20_000
#: A source has so many blocks at least, if it has as many words to give.
LEAST_SLOTS = 32
SEED = 71
#: Documents of one source are spread over chunks of about so many by their hash.
CHUNK_ROWS = 1 << 11
PIECES_SCHEMA = (
    "doc_id long, source string, text_key long, pass long, begin long, length long, at long, slot long"
)


def targets(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """``(source, size, target)`` of each source; one entry per source, which is what the driver holds."""
    ranked = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(ranked))]
    total = float(sum(n for _, n in ranked))
    out = [0.0] * len(ranked)
    free, left = list(range(len(ranked))), total
    while free:
        share = left / sum(weight[k] for k in free)
        full = [k for k in free if share * weight[k] >= MAX_PASSES * ranked[k][1]]
        for k in full or free:
            out[k] = float(MAX_PASSES * ranked[k][1]) if full else share * weight[k]
        left -= sum(out[k] for k in full)
        free = [k for k in free if k not in full] if full else []
    return [(s, n, t) for (s, n), t in zip(ranked, out, strict=True)]


def sized(docs: DataFrame) -> DataFrame:
    """One row per document: what ordering and counting need, without the text; pinned."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words_of(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("text_key"),
    )
    return pin_table(rows.groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("copies")))


def shares(counts: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """``bits`` of the grid of points, and from which to which grid point each source has its share.

    Point *j* of ``2 ** bits`` belongs to the source whose cumulated share of the blocks holds
    ``j / 2 ** bits``. Each source has as many points as blocks at least.
    """
    total = sum(counts)
    bits, before, out = max(0, (total - 1).bit_length()), 0, []
    for n in counts:
        low, high = (-(-(c << bits) // total) if total else 0 for c in (before, before + n))
        out.append((low, high))
        before += n
    return bits, out


def source_table(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """One row per source with its target, quota, blocks and points; the bits of the grid and of a chunk."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).collect()
    wanted = targets([(r.source, r.source_size) for r in sums])
    block = max(1, min(BLOCK_WORDS, sum(n for _, n, _ in wanted) // BLOCKS))
    quotas = [min(round(t), MAX_PASSES * n) for _, n, t in wanted]
    blocks = [max(1, min(block, q // LEAST_SLOTS)) for q in quotas]
    bits, points = shares([-(-q // b) for q, b in zip(quotas, blocks, strict=True)])
    listed = [
        (k, *x, q, b, *p) for k, (x, q, b, p) in enumerate(zip(wanted, quotas, blocks, points, strict=True))
    ]
    table = rows.sparkSession.createDataFrame(
        listed, "source_no int, source string, source_size long, target double, quota long, block long, low long, high long"
    )
    most = max((r.n for r in sums), default=0)
    return table, bits, (most // CHUNK_ROWS).bit_length()


def _running(rows: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before it, by chunk."""
    before_chunk = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before_chunk), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(sums, [*keys, chunk]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def slot_of(rank: Column, low: Column, high: Column, bits: int) -> Column:
    """The slot of rank ``rank`` among those whose point is from ``low`` to ``high`` (grid points).

    The bits of the slot from the highest: slots that begin with the bits so far and a 0 have the
    points ``first + step * u``. If those inside the share are more than the rank, the next bit
    is 0, else these slots lie before and the bit is 1.
    """
    start = F.struct(F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("first"), rank.cast("long").alias("rank"))

    def next_bit(x: Column, bit: Column) -> Column:
        one = F.lit(1).cast("long")
        step = F.call_function("shiftleft", one, bits - bit)

        def below(end: Column) -> Column:
            return F.greatest(F.lit(0), F.call_function("div", end - x["first"] + step - 1, step))

        inside = below(high) - below(low)
        zero = x["rank"] < inside
        return F.struct(
            F.when(zero, x["slot"]).otherwise(x["slot"] + F.call_function("shiftleft", one, bit)).alias("slot"),
            F.when(zero, x["first"]).otherwise(x["first"] + F.call_function("shiftleft", one, bits - 1 - bit)).alias("first"),
            F.when(zero, x["rank"]).otherwise(x["rank"] - inside).alias("rank"),
        )

    if not bits:
        return F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, next_bit)["slot"]


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)``.

    ``rows``: each distinct document with ``copies``, ``size``, ``source_size``,
    ``target`` and ``taken``, the words that the mix takes of it.
    ``pieces``: ``slot``, ``doc_id``, ``source``, ``text_key``, ``pass``,
    ``begin`` and ``length`` in words: the mix in order of ``slot`` and ``at``.
    """
    rows = sized(docs)
    sources, bits, chunk_bits = source_table(rows)
    extra = ["source_no", "quota", "block", "low", "high"]
    # missing sources match each other
    known = rows.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    live = known.filter("size > 0").withColumn("place", F.xxhash64(F.lit(SEED), "doc_id", "text_key"))
    live = live.withColumn("chunk", F.shiftright("place", 64 - chunk_bits) if chunk_bits else F.lit(0).cast("long"))
    placed = _running(live, ["source_no"], "chunk", ["place", "doc_id", "text_key"], "size", "start")
    # the words of a block sit at [rank * block, (rank + 1) * block) of the source repeated
    passes = F.sequence(F.lit(0).cast("long"), F.lit(MAX_PASSES - 1).cast("long"))
    spread = placed.select("*", F.explode(passes).alias("pass")).withColumn(
        "from", F.col("pass") * F.col("source_size") + F.col("start")
    )
    to = F.least(F.col("from") + F.col("size"), F.col("quota"))
    cut = spread.filter(F.col("from") < F.col("quota")).select(
        "*", F.explode(F.expr("sequence(`from` div block, (least(`from` + size, quota) - 1) div block)")).alias("rank")
    )
    low = F.greatest(F.col("from"), F.col("rank") * F.col("block"))
    high = F.least(to, (F.col("rank") + 1) * F.col("block"))
    slot = slot_of(F.col("rank"), F.col("low"), F.col("high"), bits)
    parts = cut.select(
        "doc_id", "source", "text_key", "pass", (low - F.col("from")).alias("begin"),
        (high - low).alias("length"), (low - F.col("rank") * F.col("block")).alias("at"), slot.alias("slot"),
    )
    pieces = pin_table(parts)
    sums = pieces.groupBy("doc_id", "source", "text_key").agg(F.sum("length").alias("taken"))
    named = sums.withColumnsRenamed({"doc_id": "__d", "source": "__s", "text_key": "__t"})
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("text_key") == F.col("__t"))
    counted = known.join(named, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return counted.drop("__d", "__s", "__t", *extra), pieces


def _part(text: Column, begin: Column, end: Column) -> Column:
    """Words ``begin`` to ``end`` of a text, one space between them."""
    return F.array_join(F.slice(words_of(text), (begin + 1).cast("int"), (end - begin).cast("int")), " ")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, with their columns.

    A pass over a document that the mix takes whole is its row as it was; a pass
    taken in part has these words as text (and their length as ``n_chars``, if
    there is such a column).
    """
    rows, pieces = mix(docs)
    key = ["doc_id", "source", "text_key"]
    spans = pieces.groupBy(*key, "pass").agg(F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("length")).alias("end"))
    takes = spans.groupBy(*key).agg(F.collect_list(F.struct("pass", "begin", "end")).alias("__takes"))
    named = takes.withColumnsRenamed({k: f"__{k}" for k in key})
    keyed = docs.withColumn("__key", F.xxhash64(text_or_empty()))
    if not rows.filter("copies > 1").isEmpty():
        # one row each of repeated rows; the shuffle is not needed where there are none
        keyed = keyed.dropDuplicates(["doc_id", "source", "__key"])
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("__source"))
        & (F.col("__key") == F.col("__text_key"))
    )
    taken = keyed.join(named, same).select(*docs.columns, F.explode("__takes").alias("__take"))
    begin, end = F.col("__take")["begin"], F.col("__take")["end"]
    whole = (begin == 0) & (end == n_words_of(text_or_empty()))
    out = taken.withColumn("__text", F.when(~whole, _part(text_or_empty(), begin, end)))
    changes = {"text": F.coalesce("__text", "text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.coalesce(F.length("__text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.withColumns(changes).select(*docs.columns)
