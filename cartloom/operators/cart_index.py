"""An inverted index over the texts of carts, for many searches.

``cart_search`` tests every line of every cart with every term. Carts hold the same tokens again
and again, so an index keeps each distinct text once: a search tests its terms on the
dictionary, and only the postings of texts that match are joined. A term is a bit; the bits of a
member's texts are united, and a member is found if all are there.

The index is three tables in the shared folder, written once: ``dictionary`` (text),
``postings`` (text, id), sorted by text, and ``members`` with their printed rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.cart import printed_lines
from cartloom.functions.text import name_text
from cartloom.operators.lines import each_line
from cartloom.operators.search import food_group_scope
from cartloom.plans.pinning import pin_table

#: Terms whose bits share a number.
BITS = 62


@dataclass(frozen=True)
class CartIndex:
    dictionary: DataFrame
    postings: DataFrame
    members: DataFrame


def index_carts(carts: DataFrame) -> CartIndex:
    """Index the tokens and the name of every member, in lower case."""
    rows = printed_lines(F.col("cart"), F.col("lastname"), F.col("firstname"))
    tokens = F.transform("cart", lambda x: F.lower(x["item_original"]))
    texts = F.array_compact(F.array_distinct(F.array_append(tokens, F.lower(name_text(F.col("lastname"), F.col("firstname"))))))
    # one pass over the carts gives both the rows to show and the texts to find
    members = pin_table(carts.select("id", "group_name", "name_long", rows.alias("rows"), texts.alias("texts")))
    each = members.select("id", F.explode("texts").alias("text"))
    postings = pin_table(each.repartitionByRange("text", F.xxhash64("id")).sortWithinPartitions("text", "id"))
    return CartIndex(pin_table(postings.select("text").distinct()), postings, members.drop("texts"))


def _bits(patterns: Sequence[str], text: Column) -> Column:
    """A bit for each pattern that the text matches."""
    return sum((F.when(text.rlike(p), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, p in enumerate(patterns)), F.lit(0).cast("long"))


def matching_texts(index: CartIndex, terms: Sequence[str]) -> DataFrame:
    """The texts of the dictionary that match a term, with the bits of the terms; pinned.

    The only place where patterns are tested: once per distinct text.
    """
    patterns = [t.lower() for t in terms if t]
    masks = [f"mask{k}" for k in range(0, len(patterns), BITS)]
    found = index.dictionary.withColumns(
        {m: _bits(patterns[k * BITS : (k + 1) * BITS], F.col("text")) for k, m in enumerate(masks)}
    )
    return pin_table(found.filter(" OR ".join(f"{m} <> 0" for m in masks)))


def search_index(
    index: CartIndex, shares: DataFrame, food_groups: Sequence[str], terms: Sequence[str]
) -> DataFrame:
    """The rows of ``cart_search``: all rows of members who have a match for every non-empty term."""
    scoped = food_group_scope(index.members, shares, food_groups)
    n = sum(1 for t in terms if t)
    if n:
        matched = matching_texts(index, terms)
        masks = [c for c in matched.columns if c != "text"]
        met = index.postings.join(matched, "text").groupBy("id").agg(*[F.bit_or(m).alias(m) for m in masks])
        full = [(1 << min(BITS, n - k * BITS)) - 1 for k in range(len(masks))]
        scoped = scoped.join(met.filter(" AND ".join(f"{m} = {v}" for m, v in zip(masks, full))), "id", "left_semi")
    return each_line(scoped, F.col("rows"), "group_name", "name_long").select("group_name", "name_long", "line.item_original")
