"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and a
word of failure bits; policies are masks over these bits, with a version, and are
applied afterwards without touching texts again. What each rule of a policy costs
(ablation) follows from the counts of equal bit words.

All of it is columns of built-in functions over one row, so nothing is shuffled for
the ledger, and a very long text is one row of arrays sorted in n log n.

Definitions: a missing text has no words and fails ``few_words``; so does an empty
one. ``doc_id`` may be missing or repeated, rows are judged one by one. An empty
table gives an empty ledger. Only ``doc_id`` and ``text`` are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import let, text_or_empty

#: As a Java pattern.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Name and failure condition of each rule; a rule's bit is its place in this list, and
#: places are never reused.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_share", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("no_letters", "n_words > 0 and not has_letter"),
]


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("prose-1", ("few_words", "repeated_windows", "symbol_share", "no_letters")),
        Policy("strict-1", tuple(name for name, _ in RULES)),
    )
}
DEFAULT_POLICY = POLICIES["prose-1"]


def _covered(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array of words."""

    def of_hashes(h: Column) -> Column:
        last = F.size(h) - WINDOW
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_repeats(w)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _repeats(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["w"].eqNullSafe(F.get(s, b)["w"])
        kept = F.filter(s, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < F.size(s) - 1) & same(i, i + 1)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def union(starts: Column) -> Column:
        new = F.transform(
            starts,
            lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1))),
        )
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    return let(let(placed, twice), union)


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_pieces(pieces: Column) -> Column:
        """Cut at each white-space character: one piece more than there are of them."""
        return F.struct(
            (F.length(text) - F.size(pieces) + 1).cast("long").alias("word_chars"),
            let(F.array_remove(pieces, ""), lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), _covered(w).cast("long").alias("n_repeat_words"))).alias("w"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        )

    return F.struct(
        let(F.split(text, r"[\x20\x09-\x0D]"), of_pieces).alias("p"),
        let(lines, of_lines).alias("l"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        text.rlike(r"\p{L}").alias("has_letter"),
    )


def _flat(m: Column) -> list[Column]:
    return [
        m["p"]["w"]["n_words"].alias("n_words"), m["p"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"), m["p"]["w"]["n_repeat_words"].alias("n_repeat_words"),
        m["l"]["n_lines"].alias("n_lines"), m["has_letter"].alias("has_letter"),
    ]


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "has_letter")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed``: one bit per rule."""
    m = F.col("__m")
    rows = docs.select(F.col("doc_id"), F.explode(F.array(measurements(text_or_empty()))).alias("__m"))
    flat = rows.select("doc_id", *_flat(m))
    return flat.withColumn("failed", failure_bits())


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for place, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return bits


def passes(policy: Policy, failed: Column) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: how many it rejects, and how many only this rule rejects.

    The ledger is first counted by its bit word, so the rest handles one row per
    distinct word, whatever the size of the corpus.
    """
    words = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    wanted = [
        F.struct(F.lit(p.version).alias("version"), F.lit(rule).alias("rule"), F.lit(p.mask).cast("long").alias("mask"),
                 F.lit(Policy("", (rule,)).mask).cast("long").alias("bit"))
        for p in policies for rule in p.rules
    ]
    pairs = words.select("failed", "n", F.inline(F.array(*wanted)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return pairs.groupBy("version", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
    )


def keep_passing(docs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    exploded = docs.select(F.struct(*docs.columns).alias("__row"), F.explode(F.array(measurements(text_or_empty()))).alias("__m"))
    m = F.col("__m")
    flat = exploded.select("__row", *_flat(m))
    return flat.filter(passes(policy, failure_bits())).select("__row.*")
