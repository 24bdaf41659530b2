"""Secrets in texts, with weak parts linked across a text.

Base kinds are found by pattern alone: assignments, access ids and long hex runs.
Other parts are too common to report alone: account names (``identifier``), endpoints
(``endpoint``) and strings of key-like letters (``candidate``). They are reported only
where parts complete each other within a scope: an interval of ``SCOPE`` characters
around a part. An identifier or endpoint counts when a base secret or a candidate
overlaps its scope; a candidate when an access id, or an identifier and an endpoint,
do. The interval join is an equi-join on (document, cell of the text), so the pairs of
a part are bounded by the characters of its scope, whatever the length of the text.

Only columns of built-in functions: positions come from the lengths of what lies
between the matches.

Definitions: a missing text counts as empty and has no spans. Spans are
``kind:start:end`` in code points, end exclusive, by start and then by kind in the order
of ``KINDS``. Rows with equal ``doc_id`` are judged one by one: parts are linked within
(doc_id, text), and repeated rows each get the same result. A missing ``doc_id`` is an id
like others. A text may be of any length and hold any number of spans. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import let, pin_table, text_or_empty

SCOPE = 200
#: Spans are gathered in runs of so many.
RUN = 256
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "candidate")
BASE = KINDS[:3]

ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
)
#: Kind, pattern, condition on the match.
PATTERNS: dict[str, str] = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "identifier": r"(?i:user|username|login|client_?id|account)[\x22']?\x20*[:=]\x20*[\x22']?[A-Za-z0-9_.@-]{3,64}",
    "endpoint": r"(?:https?|ftp|postgres|mysql|redis|amqp)://[A-Za-z0-9_.:@/-]{4,}",
    "candidate": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{20,}+={0,2}+(?![A-Za-z0-9+/=])",
}
#: What a text must hold for the pattern to be worth trying; quicker, and implied by the pattern.
NEEDS: dict[str, str] = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]",
    "hex": r"[0-9a-f]{32}",
    "identifier": r"(?i)(?:user|username|login|client_?id|account)[\x22']?\x20*[:=]",
    "endpoint": r"://",
    "candidate": r"[A-Za-z0-9+/]{20}",
}


def _holds(kind: str, match: Column) -> Column:
    """The condition on a match; only here can a pattern look at a whole run, however long."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, f"^{ASSIGN}", 1)) >= 8
    if kind == "access":
        return F.length(match) >= 16
    if kind == "candidate":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind as an array of (start, rank, end)."""
    pattern = PATTERNS[kind]

    def placed(found: Column) -> Column:
        return let(F.split(text, pattern), lambda between: _placed(found, between, kind))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(NEEDS[kind]), let(matches, placed)).otherwise(none)


def _placed(found: Column, between: Column, kind: str) -> Column:
    """Positions from the lengths of the matches and of what lies between them."""
    # running sums over pairs of (between, match): the end of the last match, and the spans so far, which
    # are kept in runs of RUN, as appending copies a list
    spans_type = "array<struct<start:int,rank:int,end:int>>"
    none = F.array().cast(spans_type)
    seed = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans_type}>").alias("runs"), none.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        full = F.size(state["spans"]) >= RUN
        runs = F.when(full, F.array_append(state["runs"], state["spans"])).otherwise(state["runs"])
        left = F.when(full, none).otherwise(state["spans"])
        spans = F.when(_holds(kind, pair["m"]), F.array_append(left, span)).otherwise(left)
        return F.struct(end.alias("at"), runs.alias("runs"), spans.alias("spans"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.aggregate(pairs, seed, step, lambda s: F.flatten(F.array_append(s["runs"], s["spans"])))


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and an array of spans for each kind."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
        F.explode(F.array(F.struct(*[spans_of(text, k).alias(k) for k in KINDS]))).alias("s"),
    ).select("doc_id", "text_key", "s.*")


def linked(rows: DataFrame) -> DataFrame:
    """Links of weak parts: ``doc_id``, ``text_key``, ``start``, ``rank``, ``end``, and what they met (``with``).

    A part is spread over the cells its scope touches and meets the parts that touch one
    of them.
    """
    weak_rank = len(BASE)
    has_weak = reduce(or_, [F.size(k) > 0 for k in KINDS[weak_rank:]])
    parts = rows.filter(has_weak).select("doc_id", "text_key", F.inline(F.concat(*KINDS))).distinct()
    cells = F.sequence(
        F.floor((F.col("start") - SCOPE) / SCOPE).cast("int"), F.floor((F.col("end") + SCOPE) / SCOPE).cast("int")
    )
    weak = parts.filter(F.col("rank") >= weak_rank).select("*", F.explode(cells).alias("cell"))
    touched = F.sequence(F.floor(F.col("start") / SCOPE).cast("int"), F.floor((F.col("end") - 1) / SCOPE).cast("int"))
    other = parts.select(
        F.col("doc_id").alias("o_doc"), F.col("text_key").alias("o_key"), F.col("start").alias("o_start"),
        F.col("end").alias("o_end"), F.col("rank").alias("o_rank"), F.explode(touched).alias("o_cell"),
    )
    near = (
        F.col("doc_id").eqNullSafe(F.col("o_doc"))
        & (F.col("text_key") == F.col("o_key"))
        & (F.col("cell") == F.col("o_cell"))
        & (F.col("rank") != F.col("o_rank"))
        & (F.col("o_start") < F.col("end") + SCOPE)
        & (F.col("o_end") > F.col("start") - SCOPE)
        # parts of one string do not complete each other
        & ((F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end")))
    )
    met = weak.join(other, near).groupBy("doc_id", "text_key", "start", "rank", "end")
    return met.agg(F.bit_or(F.expr("shiftleft(1, o_rank)")).alias("with"))


def _bit(*kinds: str) -> int:
    return sum(1 << KINDS.index(k) for k in kinds)


def completed(links: DataFrame) -> DataFrame:
    """The links whose parts complete each other."""
    has = lambda *kinds: F.col("with").bitwiseAND(F.lit(_bit(*kinds))) != 0
    supporting = F.col("rank").isin(KINDS.index("identifier"), KINDS.index("endpoint"))
    secret = has("assign", "hex", "candidate")
    candidate = (F.col("rank") == KINDS.index("candidate")) & (has("access") | (has("identifier") & has("endpoint")))
    return links.filter((supporting & secret) | candidate)


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, an array of base spans (``base``) and of all spans (``spans``), as (start, rank, end)."""
    # the patterns are the work here; what they find is a small part of the texts, and is read three times
    rows = pin_table(found_spans(docs))
    more = completed(linked(rows)).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "rank", "end")).alias("added")
    )
    named = more.withColumnsRenamed({"doc_id": "o_doc", "text_key": "o_key"})
    same = F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("text_key") == F.col("o_key"))
    base = rows.select("doc_id", "text_key", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.concat(*BASE).alias("base"))
    joined = base.join(named, same, "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return joined.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sort_array("base").alias("base"),
        F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"),
    )


def as_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kind = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")
