"""Spelling variants by a relational trie frontier.

All words form a trie, and reversed words another; both are one table of edges, whose nodes
are 128-bit hashes of prefixes. Of two words that differ by one edit at most, either the first or the
last half of each is untouched. So a word starts at the node of its first half in one trie and
of its (reversed) last half in the other, and searches the rest: a frontier of states (word, rest
of the word, node, edits) is joined with the edges level by level. With no edit so far, an edge
may be matched or changed by one inserted, deleted or replaced letter; after it only
matched. A state with one edit that ends where a word ends is a neighbour.

Chains without a branch are one edge with a longer label, so the number of levels is the number
of branches on a path and not the length of a word, and the upper halves of the tries, where
every letter branches, are not built at all. A node also has a small bit set of the ends of
words below it: after the edit the rest of the word has to be one of them, so most states that
lead nowhere are not made. Each level is written before the next. States that wait at a
node are spread over more keys in proportion to the words below it, and so are its edges, at
most one per letter. The edges are written in buckets of these keys, so each level moves
states only.

Words are counted over runs of bytes, which Arrow encodes as a dictionary. Whether a run loses a
letter hangs on the CRC of its document and itself; of two texts in a row it is the CRC of the
first, moved on by the length of the second, xor that of the second, so it is worked out from
one CRC per document and one per distinct word.

Definitions: a missing text has no words, a missing id is empty text in the hash that deletes
letters. Every row counts, so repeated rows repeat their words. Words and texts may be of
any length: a text's runs are held in memory one text at a time, and the tables of a
word grow with its length. Of near words with equal counts the first in code-point order is the
form. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so further columns
of any name do no harm.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import binary_rows, mix64, parts, pin_table, random64
from cartloom.plans.pinning import pin_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the query: shortest word, fewest occurrences, one run in so many loses a letter.
MIN_LETTERS, MIN_COUNT, EVERY = 5, 3, 97
#: A node takes one more key for so many words below it.
NODE_WORDS = 4096
#: The bit set of a node: longs of 64 bits each, and the letters of an end that count besides its length.
MASKS, MASK_BITS, END_LETTERS, END_STEP = 4, 256, 8, 37
COUNT_SCHEMA = "word string, n long"
NODE_SCHEMA = "id long, side int, depth int, node binary, next int, start boolean, bit int"
#: Words of more bytes have their CRC worked out one by one.
LONG_WORD = 256

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What the last byte of a CRC adds when it is moved on by a byte.
MOVE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def letter_runs(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) in UTF-8 texts.

    ``begins``: where each text begins, and the end of the last.
    """
    letter = IS_LETTER[data]
    # all letters of two bytes that begin with 0xC3
    lead = np.flatnonzero(data == 0xC3)
    letter[lead] = letter[lead + 1] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    edge = begins[(begins > 0) & (begins < len(data))]
    start[edge] = letter[edge]
    end[edge - 1] = letter[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def moved_crcs(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each text (columns) moved on by each number of bytes (rows, ascending)."""
    out, now, at = np.empty((len(lengths), len(crcs)), np.uint32), crcs.copy(), 0
    for k, n in enumerate(lengths.tolist()):
        while at < n:
            now = (now >> np.uint32(8)) ^ MOVE[now & np.uint32(255)]
            at += 1
        out[k] = now
    return out


def count_part(ids: list, texts: pa.Array) -> tuple[list[str], list[int]]:
    """Words of some texts and how often each occurs, after the deletion of letters."""
    n = len(texts)
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    begins = offsets - offsets[0]
    starts, ends = letter_runs(data, begins)
    # letters: bytes without the first ones of two
    more = np.concatenate(([0], np.cumsum(data == 0xC3)))
    long_enough = ends - starts - (more[ends] - more[starts]) >= MIN_LETTERS
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return [], []
    pieces = np.column_stack((starts, ends)).ravel()
    between = pa.Array.from_buffers(pa.large_string(), len(pieces) - 1, [None, pa.py_buffer(pieces), pa.py_buffer(data)])
    coded = between.take(pa.array(np.arange(len(starts)) * 2)).dictionary_encode()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    raw = [w.encode() for w in words]
    sizes, own = np.array([len(w) for w in raw]), np.array([zlib.crc32(w) for w in raw], np.uint32)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    doc = np.searchsorted(begins, starts, "right") - 1
    lengths = np.unique(np.minimum(sizes, LONG_WORD + 1))
    moved = moved_crcs(before, lengths[lengths <= LONG_WORD])
    row = np.minimum(np.searchsorted(lengths, sizes), max(len(moved) - 1, 0))
    h = moved[row[index], doc] ^ own[index] if len(moved) else np.zeros(len(index), np.uint32)
    for k in np.flatnonzero(sizes[index] > LONG_WORD).tolist():
        h[k] = zlib.crc32(raw[index[k]], int(before[doc[k]]))
    cut = h % EVERY == 0
    counts = np.bincount(index[~cut], minlength=len(words))
    out, numbers = [words[k] for k in np.flatnonzero(counts).tolist()], counts[counts > 0].tolist()
    for k, number in zip(index[cut].tolist(), h[cut].tolist(), strict=True):
        word = words[k]
        at = number % len(word)
        if len(word) > MIN_LETTERS:
            out.append(word[:at] + word[at + 1 :])
            numbers.append(1)
    return out, numbers


def counted_words(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` and an ``id`` that grows with the length of the word; pinned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 8 << 20):
                words, numbers = count_part(part.column("doc_id").to_pylist(), part.column("text"))
                yield pa.record_batch([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])

    some = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, COUNT_SCHEMA)
    counts = some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    counts = pin_table(counts.withColumn("size", F.length("word")))
    order = ["size", F.xxhash64("word")]
    ordered = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    return pin_table(ordered.withColumn("id", F.monotonically_increasing_id()))


def _prefixes(ids: np.ndarray, words: list[str], side: int) -> pa.RecordBatch:
    """The nodes on the lower half of the path of each word, with the letter that follows (0 at the end)."""
    import xxhash

    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(codes)) - np.repeat(starts, sizes)
    low = (sizes - 1) // 2
    n = sizes - low + 1
    word = np.repeat(np.arange(len(sizes)), n)
    depth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[word]
    at = starts[word] + depth
    node = np.empty((len(word), 2), np.uint64)
    for k in range(2):
        # a sum of (value of the letter) * (value of the place): prefixes differ by one addition
        places = random64(int(sizes.max(initial=0)), 2 * k + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(random64(256, 2 * k + 2)[codes] * places[within])))
        node[:, k] = mix64(sums[at] - sums[starts[word]] + places[depth - 1] + np.uint64(side + 1))
    # a bit for what is left of the word: its first letters and its length
    left, from_word = sizes[word] - depth, word.tolist()
    ends = [words[w][d : d + END_LETTERS].encode() for w, d in zip(from_word, depth.tolist(), strict=True)]
    hashed = np.array([xxhash.xxh64_intdigest(e, 42) for e in ends], np.uint64)
    bits = (hashed + left.astype(np.uint64) * np.uint64(END_STEP) & np.uint64(MASK_BITS - 1)).astype(np.int32)
    following = np.where(depth < sizes[word], np.append(codes, np.uint8(0))[at], 0)
    return pa.record_batch(
        [
            pa.array(ids[word]), pa.array(np.full(len(word), side, np.int32)), pa.array(depth.astype(np.int32)),
            binary_rows(node.ravel(), np.full(len(word), 2)), pa.array(following.astype(np.int32)), pa.array(depth == sizes[word] // 2), pa.array(bits),
        ],
        ["id", "side", "depth", "node", "next", "start", "bit"],
    )


def prefixes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            yield _prefixes(ids, texts, 0)
            yield _prefixes(ids, [w[::-1] for w in texts], 1)

    return words.select("id", "word").mapInArrow(run, NODE_SCHEMA)


def _keys(words_below: Column) -> Column:
    return (F.lit(1) + words_below / NODE_WORDS).cast("int")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, states)``: the edges below the halves, and a state per word and side."""
    steps = pin_table(prefixes(words))
    nodes = steps.groupBy("node").agg(
        F.min("next").alias("first_next"), F.max("next").alias("last_next"), F.max("start").alias("any_start"),
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("below"),
        *[F.bit_or(F.expr(f"if(bit div 64 = {k}, shiftleft(1L, bit % 64), 0L)")).alias(f"mask{k}") for k in range(MASKS)],
    )
    # a node stays if the path branches, a word ends, or a search starts there; from here on it is a number
    nodes = nodes.filter("first_next <> last_next OR first_next = 0 OR any_start")
    nodes = pin_table(nodes.withColumn("number", F.monotonically_increasing_id()))
    on_path = steps.select("node", "id", "side", "depth", "start").join(nodes.drop("any_start"), "node")
    own = F.col("rep") == F.col("id")
    stop = F.struct(
        "depth", "number", "start", own.alias("own"), (F.col("first_next") == 0).alias("end"),
        (F.col("last_next") != 0).alias("more"), _keys(F.col("below")).alias("keys"),
        F.when(own, F.array(*[f"mask{k}" for k in range(MASKS)])).alias("ends"),
    )
    paths = on_path.groupBy("id", "side").agg(F.sort_array(F.collect_list(stop)).alias("path"))
    text = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    paths = pin_table(paths.join(words.select("id", "word", "n"), "id").withColumn("text", text))
    # the shortest word through a node knows the deepest node above it, and is the word that ends there
    pairs = F.arrays_zip(
        F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b")
    )
    edges = paths.select("word", "n", "text", F.explode(F.filter(pairs, lambda p: p["b"]["own"])).alias("p"))
    label = F.substring("text", F.col("p.a.depth") + 1, F.col("p.b.depth") - F.col("p.a.depth"))
    edges = edges.select(
        F.col("p.a.number").alias("parent"),
        F.explode(F.sequence(F.lit(0), F.col("p.a.keys") - 1)).alias("part"),
        label.alias("label"), F.left(label, F.lit(1)).alias("first"),
        F.col("p.b.number").alias("child"), F.col("p.b.keys").alias("child_keys"), F.col("p.b.more").alias("more"), F.col("p.b.ends").alias("ends"),
        F.when(F.col("p.b.end"), F.col("word")).alias("target"), F.when(F.col("p.b.end"), F.col("n")).alias("target_n"),
    )
    begin = F.get(F.filter("path", lambda s: s["start"]), F.lit(0))
    states = paths.select("id", "text", begin.alias("s")).select(
        "id", F.expr("substring(text, s.depth + 1)").alias("rest"), F.lit(0).alias("edits"),
        F.col("s.number").alias("node"), F.col("s.keys").alias("keys"),
    )
    return edges, states


def _end_bit(rest: Column) -> Column:
    return (F.xxhash64(F.left(rest, F.lit(END_LETTERS))) + F.length(rest) * END_STEP).bitwiseAND(MASK_BITS - 1).cast("int")


def _among_ends(rest: Column) -> Column:
    """Whether ``rest`` can be an end of a word below the child: its bit is set."""
    bit = _end_bit(rest)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))
    return F.get(F.col("ends"), F.shiftright(bit, 6)).bitwiseAND(one) != 0


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one more edge, with ``onward``; those at the end of a word have its name. Pinned."""
    carried = ["child", "child_keys", "more", "target", "target_n"]
    spread = F.pmod(F.xxhash64("id"), F.col("keys")).cast("int")
    # after the edit only the edge of the next letter can match
    fits = (F.col("edits") == 0) | F.startswith("rest", F.col("first"))
    met = states.withColumn("key", spread).join(edges, (F.col("node") == F.col("parent")) & (F.col("key") == F.col("part")) & fits)
    # an edge is matched (0), or one letter of it is another (1), was deleted (2) or added (3)
    ways = F.when(F.col("edits") == 0, F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0)))
    each = met.select("id", "rest", "edits", "label", "ends", *carried, F.explode(ways).alias("way"))
    letters = F.length("label") + F.expr("if(way = 2, 1, if(way = 3, -1, 0))")
    rest = F.substring("rest", letters + 1, F.length("rest"))
    edits = F.expr("if(way = 0, edits, 1)")
    one = (F.levenshtein(F.left("rest", letters), F.col("label"), 1) == 1) & (F.length("rest") >= letters)
    taken = F.when(F.col("way") == 0, F.startswith("rest", F.col("label"))).otherwise(one)
    moved = each.filter(((edits == 0) | _among_ends(rest)) & taken).select("id", rest.alias("rest"), edits.alias("edits"), *carried)
    ended = F.col("target").isNotNull() & (F.length("rest") == 1 - F.col("edits"))
    onward = F.col("more") & ((F.col("edits") == 0) | (F.col("rest") != ""))
    flagged = moved.withColumns({"ended": ended, "onward": onward}).filter("ended OR onward")
    return pin_table(flagged.select(
        "id", F.when(F.col("onward"), F.col("rest")).alias("rest"), "edits", "child", "child_keys", "onward",
        F.when(F.col("ended"), F.col("target")).alias("near"), F.when(F.col("ended"), F.col("target_n")).alias("near_n"),
    ))


def neighbours(words: DataFrame) -> DataFrame:
    """``id``, ``near``, ``near_n``: the words one edit apart from each word, once."""
    edges, states = trie(words)
    pairs = []
    with bucketed(edges, "parent", "part") as table:
        while True:
            level = _step(states, table)
            pairs.append(level.filter("near IS NOT NULL").select("id", "near", "near_n"))
            states = level.filter("onward").select("id", "rest", "edits", F.col("child").alias("node"), F.col("child_keys").alias("keys"))
            if states.isEmpty():
                break
    # different edits can lead to one word
    return reduce(DataFrame.unionAll, pairs).distinct()


@contextmanager
def bucketed(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """``df`` written in buckets of its keys, so that joins on these need not move it."""
    spark = df.sparkSession
    name = f"cartloom_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{pin_folder(spark)}/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last of the forms that follow from it, for words that have one.

    Counts double with each form, so the length of a chain is the logarithm of a count at
    most; jumps double in each round. Words that have arrived take no further part.
    """
    jumps = pin_table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not (moving := jumps.filter("open")).isEmpty():
        ahead = jumps.select(F.col("word").alias("__word"), F.col("root").alias("__root"), F.col("open").alias("__open"))
        moved = moving.join(ahead, F.col("root") == F.col("__word"), "left").select(
            "word", F.coalesce("__root", "root").alias("root"), F.coalesce("__open", F.lit(False)).alias("open")
        )
        jumps = pin_table(jumps.filter("NOT open").unionByName(moved))
    return jumps.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word."""
    words = counted_words(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = neighbours(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.less") >= 2 * F.col("n")
    judged = pin_table(
        words.select("id", "word", "n").join(near, "id", "left").select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(judged.filter("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
