"""Interaction audit of a chain of filters by inclusion and exclusion.

What every order of five filters would remove follows from 32 numbers a part: how many documents fail all filters
of a set together, for each of the sets. One aggregation makes them, as sums of products of failure flags, combined
before the shuffle; so the audit of all 120 orders costs one pass, however many orders there are.

Writing f(S) for the joint failures of S, the Möbius sum over U within P of (-1)^|U| f(U + i) counts documents
that fail i and none of P: with P the filters before i in an order these are the removed, with P all others the
unique failures; without i, they are the survivors of P. The documents that at least one filter of a set
removes make a game whose Harsanyi dividend of S is (-1)^(|S| + 1) f(S). A filter's Shapley value is the sum of
dividends shared evenly among their members; times 120, the number of orders, it is an integer.

The filters (``FILTERS``): A under 50 words, B few distinct words, C many capitals, D signs of markup, E text of a
smaller id. Identical texts are found by their SHA-256; what is known of texts with many copies is broadcast (at
most ``HUBS`` texts), other rows are joined by it.

Defined results: null text is empty, a null source is the part of the empty string. An id with several labels has the
highest of each; one without labels loses nothing. Rows with a null id fail no E and make no other row fail
it; of rows that repeat the smallest id of a text none fails E. Repeated rows count each. A table without rows has
no parts. Very long texts are split into words whole, with memory of about 60 bytes a word. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import HUB, HUBS, discard, hubs, materialise, spread_join

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, same): 1 where a text fails the filter, and its SHA-256."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"), F.split(text, r"[\x20\x09-\x0D]+").alias("w"))
    # White space at either end of a text leaves an empty string there.
    before, after = (F.get("w", at) == "" for at in (F.lit(0), F.size("w") - 1))
    counted = rows.select(
        "doc_id", "part",
        (F.size("w") - before.cast("int") - (after & (F.size("w") > 1)).cast("int")).alias("words"), (F.size(F.array_distinct("w")) - (before | after).cast("int")).alias("distinct"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]+", ""))).alias("capitals"), F.length("t").alias("chars"),
        F.col("t").rlike("[#$%&*|]").alias("signs"), F.unhex(F.sha2("t", 256)).alias("same"),
    )
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    few = 100 * F.col("distinct").cast("long") < 65 * F.col("words").cast("long")
    loud = 100 * F.col("capitals").cast("long") > 5 * F.col("chars").cast("long")
    return counted.select("doc_id", "part", one(F.col("words") < 50).alias("A"), one(few).alias("B"), one(loud).alias("C"), one(F.col("signs")).alias("D"), "same")


def joint_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failing, failing_good, failing_toxic): for each set of filters, as a number of bits with A
    lowest, how many documents fail them all; of all, of the good and of the toxic."""
    seen = materialise(flags(docs), "flags")
    total = seen.count()
    lowest = seen.filter("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n")).filter("n > 1")
    lowest = materialise(lowest, "lowest")
    limit = max(HUB, total // HUBS)
    many = materialise(lowest.filter(F.col("n") > limit).select("same"), "many")
    told = spread_join(seen, lowest.drop("n"), "same", None if many.isEmpty() else many, "left")
    rows = told.select("doc_id", "part", *"ABCD", F.when(F.col("doc_id") > F.col("lowest"), 1).otherwise(0).cast("long").alias("E"))

    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = seen.filter("doc_id IS NOT NULL")
    repeated = hubs(ids, "doc_id", total)
    rows = spread_join(rows, marks, "doc_id", repeated, "left")
    rows = rows.withColumn("good", F.when(F.col("quality") == 1, 1).otherwise(0).cast("long")).withColumn("bad", F.when(F.col("toxic") == 1, 1).otherwise(0).cast("long"))

    def product(s: int, weight: str | None) -> Column:
        out = F.col(weight) if weight else F.lit(1).cast("long")
        for i, name in enumerate(FILTERS):
            out = out * F.col(name) if s >> i & 1 else out
        return out

    sums = [F.sum(product(s, w)).alias(f"{w or 'all'}{s}") for w in (None, "good", "bad") for s in range(SETS)]
    counts = rows.groupBy("part").agg(*sums)
    packed = lambda w, name: F.array(*(f"{w}{s}" for s in range(SETS))).alias(name)
    out = materialise(counts.select("part", packed("all", "failing"), packed("good", "failing_good"), packed("bad", "failing_toxic")), "joint")
    discard(seen, lowest, many)
    return out


def failing_none_of(joint: Column, others: Column, own: Column | int = 0) -> Column:
    """Documents that fail all of ``own`` and none of ``others`` (sets as numbers): the Möbius sum over the
    subsets of ``others`` of their joint failures with ``own``."""
    own = F.lit(own) if isinstance(own, int) else own
    subsets = F.array(*map(F.lit, range(SETS)))
    term = lambda u: F.when(F.bit_count(u) % 2 == 0, F.get(joint, u.bitwiseOR(own))).otherwise(-F.get(joint, u.bitwiseOR(own)))
    return F.aggregate(subsets, F.lit(0).cast("long"), lambda a, u: a + F.when(u.bitwiseAND(others) == u, term(u)).otherwise(F.lit(0).cast("long")))


def shapley_of_orders(joint: Column, own: Column, orders: int = 120) -> Column:
    """``orders`` times the Shapley value of the filter ``own``: every set that holds it shares its dividend."""
    share = lambda s: F.get(joint, s) * F.floor(orders / F.bit_count(s)) * F.when(F.bit_count(s) % 2 == 1, 1).otherwise(-1)
    return F.aggregate(F.array(*map(F.lit, range(1, SETS))), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(own) == own, share(s)).otherwise(F.lit(0).cast("long")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (summed over all orders)."""
    steps = [(order, step + 1, 1 << FILTERS.index(order[step]), sum(1 << FILTERS.index(x) for x in order[:step])) for order in map("".join, permutations(FILTERS)) for step in range(len(FILTERS))]
    plan = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, s, own, before in steps))
    own, before = F.col("own"), F.col("before")
    removed = failing_none_of(F.col("failing"), before, own)
    return joint_failures(docs, labels).select("*", F.inline(plan)).select(
        "part", "filter_order", "step",
        failing_none_of(F.col("failing"), before.bitwiseOR(own)).alias("kept"),
        removed.alias("removed"),
        (F.get("failing", own) - removed).alias("redundant"),
        failing_none_of(F.col("failing"), F.lit(SETS - 1) - own, own).alias("unique_fails"),
        failing_none_of(F.col("failing_good"), before, own).alias("good_lost"),
        failing_none_of(F.col("failing_toxic"), before, own).alias("toxic_lost"),
        shapley_of_orders(F.col("failing"), own).alias("shapley"),
    )
