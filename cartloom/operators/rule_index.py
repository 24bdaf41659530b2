"""Items meet only the rules that can match them.

Every rule that is not a pattern is a hash look-up: an item equals its text, or begins or ends
with it, exactly if the item's own first or last letters, cut to the length of the rule's text,
are that text. So items are joined on their affixes, one for each length that a rule has.

A pattern is looked up by a literal that every match must hold. Its rarest three letters
(counted over the items) are the key, the literal is tested next, the pattern last. Patterns without
such a literal, and only these, are tested against every item; they are gathered in batches
that items meet by number.

Items are distinct texts without missing values; a rule may occur more than once and then hits
as often. Rules of an unknown kind, and with a missing text, match nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.plans.pinning import pin_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES_PER_BATCH = 200
GRAM = 3
#: Escapes that stand for a class or a place and have no parameter.
PLAIN_ESCAPES = set("dDsSwWbBAZzGRhHvVtnrfae")


def required_literal(pattern: str) -> str:
    """The longest text that every match of a pattern must hold, or an empty one.

    Only letters outside groups and classes count, and none that a quantifier may drop. Whatever
    could change the meaning of letters (flags, quoting, escapes with parameters, alternatives)
    gives an empty text, which is always right.
    """
    runs, run, depth, at = [], "", 0, 0
    if "(?" in pattern or "\\Q" in pattern:
        return ""
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "|" and depth == 0:
            return ""
        if c == "[":
            end = _class_end(pattern, at)
            if end is None:
                return ""
            runs.append(run)
            run, at = "", end
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return ""
            runs.append(run)
            run = ""
        elif c in "*?+{":
            # the letter before may be missing, except before a plus
            runs.append(run if c == "+" else run[:-1])
            run = ""
            if c == "{":
                end = pattern.find("}", at)
                if end < 0:
                    return ""
                at = end + 1
        elif c in ".^$":
            runs.append(run)
            run = ""
        elif c == "\\":
            if at == len(pattern):
                return ""
            letter = pattern[at]
            at += 1
            if letter.isalnum():
                if letter not in PLAIN_ESCAPES:
                    return ""
                runs.append(run)
                run = ""
            elif depth == 0:
                run += letter
        elif depth == 0:
            run += c
    return max([*runs, run], key=len) if depth == 0 else ""


def _class_end(pattern: str, at: int) -> int | None:
    """The place behind a class that begins before ``at``, or none if its end is not plain."""
    if pattern[at : at + 1] == "]" or pattern[at : at + 2] == "^]":
        return None
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 2
        elif pattern[at] == "[":
            return None
        elif pattern[at] == "]":
            return at + 1
        else:
            at += 1
    return None


def _with_literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, texts = (batch.column(c).to_pylist() for c in ("match_name", "text_name"))
        found = [required_literal(t) if k == "contains" else "" for k, t in zip(kinds, texts)]
        yield batch.append_column("literal", pa.array(found, pa.string()))


def _affix_hits(items: DataFrame, rules: DataFrame, lengths: list[int], affix: Callable[[str, Column], Column]) -> DataFrame:
    """Items joined with rules on their first or last letters, cut to each length that a rule has."""
    fitting = F.filter(F.lit(sorted(lengths)).cast("array<int>"), lambda n: n <= F.length("item"))
    each = items.select("item", F.explode(F.transform(fitting, lambda n: affix("item", n))).alias("__text"))
    return each.join(rules, F.col("__text") == F.col("text_name"))


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    some = F.when(F.length(text) >= GRAM, F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.array_distinct(F.coalesce(some, F.array().cast("array<string>")))


def _pattern_hits(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """Items joined with patterns on the rarest three letters of what a match must hold."""
    held = items.select("item", F.explode(grams(F.col("item"))).alias("__gram"))
    counts = held.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    asked = patterns.select("__rule", F.explode(grams(F.col("literal"))).alias("__gram"))
    rarest = asked.join(counts, "__gram", "left").groupBy("__rule").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("__rarest")
    )
    # a rule whose letters no item has matches nothing
    wanted = rarest.filter("__rarest.n > 0").select("__rule", F.col("__rarest.__gram").alias("__key"))
    met = held.join(patterns.join(wanted, "__rule"), F.col("__gram") == F.col("__key"))
    return met.filter(F.contains("item", F.col("literal"))).filter(F.rlike("item", F.col("text_name")))


def _batch_hits(items: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """Items tested with every pattern: each item meets each batch of patterns by its number."""
    n_batches = -(-n // RULES_PER_BATCH)
    number = (F.pmod(F.xxhash64("__rule"), F.lit(n_batches))).cast("int")
    batches = patterns.groupBy(number.alias("__batch")).agg(F.collect_list(F.struct(*patterns.columns)).alias("__rules"))
    spread = items.select("item", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))).alias("__batch"))
    hits = F.filter("__rules", lambda r: F.rlike(F.col("item"), r["text_name"]))
    return spread.join(batches, "__batch").select("item", F.explode(hits).alias("__hit")).select("item", "__hit.*")


def rule_hits(items: DataFrame, rules: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(item, payload...) for every rule an item matches.

    ``items`` has the column ``item``; ``rules`` has ``match_name``, ``text_name`` and the payload.
    """
    named = rules.select("match_name", "text_name", *payload).filter(F.col("text_name").isNotNull())
    listed = named.mapInArrow(_with_literals, T.StructType([*named.schema.fields, T.StructField("literal", T.StringType())]))
    listed = pin_table(listed.withColumn("__rule", F.monotonically_increasing_id()))
    kind, size, indexed = F.col("match_name"), F.length("text_name"), F.length("literal") >= GRAM
    # lengths are few, whatever the number of rules
    found = listed.agg(
        F.count_if(kind == "equal").alias("equal"), F.collect_set(F.when(kind == "starts with", size)).alias("starts"),
        F.collect_set(F.when(kind == "ends with", size)).alias("ends"),
        F.count_if((kind == "contains") & indexed).alias("indexed"), F.count_if((kind == "contains") & ~indexed).alias("free"),
    ).first()
    of = {k: listed.filter(kind == k) for k in ("equal", "starts with", "ends with", "contains")}
    items, hits = items.select("item"), []
    if found.equal:
        hits.append(items.join(of["equal"], F.col("item") == F.col("text_name")))
    if found.starts:
        hits.append(_affix_hits(items, of["starts with"], found.starts, F.left))
    if found.ends:
        hits.append(_affix_hits(items, of["ends with"], found.ends, F.right))
    if found.indexed:
        hits.append(_pattern_hits(items, of["contains"].filter(indexed)))
    if found.free:
        hits.append(_batch_hits(items, of["contains"].filter(~indexed), found.free))
    if not hits:
        return items.join(listed, F.col("item") == F.col("text_name")).limit(0).select("item", *payload)
    return reduce(DataFrame.unionByName, [h.select("item", *payload) for h in hits])
