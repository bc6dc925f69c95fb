"""Audit of how filters interact: inclusion-exclusion over the joint failures of every set of filters.

A set of filters is a mask, bit k for the k-th of ``FILTERS``. One aggregation sums, for each part and each of
the 2**5 masks, the product of the flags in it: the number of documents that fail all of the mask's filters.
Everything else follows from these sums without touching a document again:

* documents that fail none of a mask: the sum over its submasks, with the sign of their size;
* documents that fail exactly a mask: the same over its supermasks (Moebius inversion);
* what a filter removes in an order: the difference of two survivor counts;
* Shapley values: removal is a game whose Harsanyi dividend of a mask is its joint count with the sign of its
  size, and a filter gets an equal share of the dividend of each mask that it is in.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import durable

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SIGNS = r"[#$%&*|]"
COUNTS = ("all", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """1 where a text fails, for the four filters that look at one text alone; a null text is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    short = F.size(words) < MIN_WORDS
    dull = 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.length(text)
    return {"A": short.cast("long"), "B": dull.cast("long"), "C": loud.cast("long"), "D": text.rlike(SIGNS).cast("long")}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): 0 or 1 for every row of ``docs``.

    ``E`` is 1 for rows whose text is also that of a smaller doc_id: all rows of a text but those of its smallest
    doc_id, which a join on text and id finds, so that no task meets all copies of a text. A row without a doc_id
    has none that is smaller and no labels. Several labels of one document make it good, or toxic, if any of them
    says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("th"), *[f.alias(k) for k, f in text_flags(F.col("text")).items()]))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("th").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    known = rows.where("doc_id IS NOT NULL").join(firsts, ["doc_id", "th"], "left").join(marks, "doc_id", "left")
    known = known.withColumn("E", F.col("first").isNull().cast("long"))
    nameless = rows.where("doc_id IS NULL").select("*", *[F.lit(0).cast("long").alias(c) for c in ("E", "good", "toxic")])
    columns = ["part", *FILTERS, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]]
    return known.select(*columns).unionByName(nameless.select(*columns))


def joint_failures(flags: DataFrame) -> DataFrame:
    """(part, all, good, toxic): arrays that hold, at each mask, how many documents fail all of its filters."""

    def product(mask: int, kind: str) -> Column:
        out = F.lit(1).cast("long") if kind == "all" else F.col(kind)
        for k, name in enumerate(FILTERS):
            out = out * F.col(name) if mask >> k & 1 else out
        return F.sum(out)

    sums = flags.groupBy("part").agg(*[product(m, kind).alias(f"{kind}_{m}") for kind in COUNTS for m in MASKS])
    return sums.select("part", *[F.array(*[F.col(f"{kind}_{m}") for m in MASKS]).alias(kind) for kind in COUNTS])


def _sign(mask: int) -> int:
    return -1 if mask.bit_count() % 2 else 1


def _signed(joint: Column, masks: list[int], weight) -> Column:
    """Sum of weight(mask) * joint[mask]."""
    out = F.lit(0).cast("long")
    for m in masks:
        out = out + joint[m] * F.lit(weight(m)).cast("long")
    return out


def survivors(joint: Column) -> Column:
    """At each mask, how many documents fail none of its filters."""
    return F.array(*[_signed(joint, [u for u in MASKS if u & m == u], _sign) for m in MASKS])


def unique_failures(joint: Column) -> Column:
    """For each filter, how many documents fail it and no other."""
    return F.array(*[_signed(joint, [u for u in MASKS if u >> k & 1], lambda u: -_sign(u)) for k in range(len(FILTERS))])


def shapley(joint: Column) -> Column:
    """For each filter, its removals summed over all orders: dividends shared equally, times the number of orders."""
    share = lambda u: -_sign(u) * len(ORDERS) // u.bit_count()  # noqa: E731  120 is divisible by 1 to 5
    return F.array(*[_signed(joint, [u for u in MASKS if u >> k & 1], share) for k in range(len(FILTERS))])


def _own(place: Column) -> Column:
    """The filter at a place, from 1, of an order: 0 for A, 1 for B and so on."""
    return F.ascii(F.substr(F.col("filter_order"), place, F.lit(1))) - ord(FILTERS[0])


def _first(places: Column) -> Column:
    """The mask of an order's first places."""
    bits = F.transform(F.sequence(F.lit(1), places), lambda k: F.call_function("shiftleft", F.lit(1), _own(k)))
    return F.when(places > 0, F.aggregate(bits, F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of every order of the filters keeps and removes: one row for each part, order and step.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns are not read. Parts
    are the values of ``source``, null as the empty string. Repeated rows count each; an empty table has no parts
    and gives no rows. Only sums by part are shuffled with the parts as keys, so a part of any size is no burden.
    """
    joint = joint_failures(flagged(docs, labels))
    kept = [survivors(F.col(kind)).alias(f"kept_{kind}") for kind in COUNTS]
    totals = durable(joint.select("part", F.col("all").alias("joint"), *kept, unique_failures(F.col("all")).alias("unique"), shapley(F.col("all")).alias("shares")))
    orders = totals.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    placed = steps.select("*", _own(F.col("step")).alias("own"), _first(F.col("step") - 1).alias("before"), _first(F.col("step")).alias("after"))
    lost = lambda kind: F.col(f"kept_{kind}")[F.col("before")] - F.col(f"kept_{kind}")[F.col("after")]
    alone = F.col("joint")[F.call_function("shiftleft", F.lit(1), F.col("own"))]
    return placed.select(
        "part", "filter_order", "step", F.col("kept_all")[F.col("after")].alias("kept"), lost("all").alias("removed"),
        (alone - lost("all")).alias("redundant"), F.col("unique")[F.col("own")].alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shares")[F.col("own")].alias("shapley"),
    )
