"""Line dedup by a suffix array over line ids, built with DataFrame operations only.

Every line is a symbol (two 64-bit hashes name its text). The distinct texts are laid end to end, by their
smallest doc_id, with one free place between them, so a line has one global place: a suffix. Prefix doubling
ranks the suffixes: the rank at depth 2h is the rank of the pair of ranks at depth h of a suffix and of the
one h lines on. Sorted by rank, suffixes that agree in their first d lines lie side by side: an interval of
the suffix array whose longest common prefix is at least d. An interval of one holds no repeat and is left
behind; doubling goes on until no interval holds two suffixes.

A suffix repeats its elders at the deepest interval in which it is not the first. Its longest common prefix
with that first is found exactly by walking the depths back down, comparing the ranks of the two places
reached so far. Suffixes that only continue the run of the line above are folded into it, which leaves the
maximal repeated runs; the later copy of each is deleted.

A suffix that agrees with one at most d lines above it, in its first d lines, lies inside a run of a period. It is
doubled no further: what it repeats is known, and a junk text of one line does not make all others go through more
depths. A suffix repeats a first that overlaps its own first lines only from the next copy on.

Ranks come from range partitioning and sorting the pairs that repeat. Joins send the few keys that hold a
thousandth of all rows or more by broadcast (``common.attach``), so neither a line nor a document that makes up
a third of all rows ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import attach, durable, frequent, shuffle_partitions

MIN_LINES = 3
_LAST = (1 << 63) - 1


def _laid_out(texts: DataFrame) -> DataFrame:
    """``texts`` with ``doc``, the place of a text's first line among all."""
    order = [F.coalesce("owner", F.lit(_LAST)), F.col("h1"), F.col("h2")]
    placed = texts.withColumn("taken", F.size("symbols").cast("long") + 1)
    placed = durable(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    total = placed.groupBy("part").agg(F.sum("taken").alias("total"))
    # a row for each range partition, so this window is small
    starts = total.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("start"))
    inside = F.sum("taken").over(Window.partitionBy("part").orderBy(*order)) - F.col("taken")
    numbered = placed.withColumn("inside", inside).join(F.broadcast(starts), "part")
    return numbered.select("h1", "h2", "owner", "n", "symbols", (F.col("start") + F.col("inside")).alias("doc"))


def _named(pairs: DataFrame) -> DataFrame | None:
    """(doc, line, rank, first) of the suffixes in intervals of two or more; None if there are none.

    rank grows with the pair (a, b): range partitions follow each other and each is sorted. first is the place
    of the first suffix that has the pair.
    """
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc") + F.col("line")).alias("first")).where(F.col("n") > 1)
    ranked = durable(counted.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()))
    if ranked.isEmpty():
        return None
    return durable(attach(pairs, ranked, ["a", "b"], frequent(ranked)).select("doc", "line", "rank", "first"))


def _deeper(now: DataFrame, ahead: int) -> DataFrame | None:
    """Suffixes ranked by their own rank and that of the suffix ``ahead`` lines on in the same text."""
    by_line = Window.partitionBy("doc").orderBy(F.col("line").cast("long")).rangeBetween(ahead, ahead)
    pairs = now.select("doc", "line", F.col("rank").alias("a"), F.first("rank").over(by_line).alias("b"))
    return _named(durable(pairs.where(F.col("b").isNotNull())))


def _periods(level: DataFrame, depth: int) -> DataFrame:
    """``level`` with ``period``: how many lines above the next suffix of its interval is, if no more than ``depth``."""
    apart = F.col("line") - F.lag("line").over(Window.partitionBy("doc", "rank").orderBy("line"))
    return durable(level.withColumn("period", F.when(apart <= depth, apart)))


def _levels(lines: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """Ranks at every depth, up to the last at which an interval holds two suffixes, with periods from ``min_lines`` on."""
    depth, level, levels = 1, _named(lines), []
    while level is not None:
        if depth >= min_lines:
            level = _periods(level, depth)
        levels.append((depth, level))
        ahead = min(depth, min_lines - depth) if depth < min_lines else depth
        depth, level = depth + ahead, _deeper(level.where("period IS NULL") if depth >= min_lines else level, ahead)
    return levels


def _runs(levels: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame | None:
    """(doc, line, first, length): maximal runs that repeat what starts at the place ``first``; None if there is none.

    Not counted are suffixes whose first begins less than ``min_lines`` lines above in the same text: it overlaps them.
    """
    new = (F.col("first") < F.col("doc")) | (F.col("doc") + F.col("line") - F.col("first") >= min_lines)
    deep = [level.where(new).select("doc", "line", "first", F.lit(d).alias("depth")) for d, level in levels if d >= min_lines]
    if not deep:
        return None
    later = deep[0]
    for level in deep[1:]:
        later = later.unionByName(level)
    later = later.groupBy("doc", "line").agg(F.max_by("first", "depth").alias("first"), F.max("depth").alias("depth"))
    above = Window.partitionBy("doc").orderBy(F.col("line").cast("long")).rangeBetween(-1, -1)
    later = later.withColumn("above", F.first("first").over(above))
    heads = F.col("above").isNull() | (F.col("above") + 1 != F.col("first"))
    run = F.sum(heads.cast("int")).over(Window.partitionBy("doc").orderBy("line"))
    head = F.min_by(F.struct("line", "first", "depth"), "line").alias("head")
    folded = later.withColumn("run", run).groupBy("doc", "run").agg(head, F.max(F.col("line") + F.col("depth")).alias("end"))
    runs = durable(folded.select("doc", "head.*", F.col("head.depth").alias("length"), "end"))
    # the places that are compared with: one for each run that starts alike, or fewer
    limit = frequent(runs.groupBy("first").agg(F.count(F.lit(1)).alias("n")))
    for d, level in reversed(levels[:-1]):
        own = level.select("doc", F.col("line").alias("at"), F.col("rank").alias("own"))
        asked = runs.withColumns({"at": F.col("line") + F.col("length"), "place": F.col("first") + F.col("length")}).join(own, ["doc", "at"], "left")
        there = level.select((F.col("doc") + F.col("line")).alias("place"), F.col("rank").alias("there"))
        wanted = runs.groupBy((F.col("first") + F.col("length")).alias("place")).agg(F.count(F.lit(1)).alias("n")).join(there, "place", "left")
        more = F.when((F.col("depth") > d) & (F.col("own") == F.col("there")), d).otherwise(0)
        longer = attach(asked, wanted, ["place"], limit).select("doc", "line", "first", "depth", (F.col("length") + more).alias("length"), "end")
        runs = durable(longer.coalesce(shuffle_partitions(longer)))  # the two ways of a join add up their partitions
    # beyond a suffix that was left behind inside a period the walk sees no ranks; what was folded reaches further
    return runs.select("doc", "line", "first", F.greatest("length", (F.col("end") - F.col("line")).cast("int")).alias("length"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> tuple[DataFrame, DataFrame]:
    """(owners, gone) for the texts of ``docs`` (doc_id, text).

    ``owners`` has a row per distinct text: its hashes h1 and h2, the smallest doc_id that has it (``owner``),
    the number of its rows (n) and its place (doc). ``gone`` has (doc, gone): lines, from 0, that a later copy
    of a run covers, for the texts that have any.
    """
    if min_lines < 1:
        raise ValueError("a run has at least one line")
    text = F.col("text").cast("string")
    symbols = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    given = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(text), symbols.alias("symbols"))
    texts = given.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.first("symbols").alias("symbols"))
    placed = _laid_out(texts)
    lines = durable(placed.select("doc", F.posexplode("symbols").alias("line", "s")).select("doc", "line", F.col("s.a").alias("a"), F.col("s.b").alias("b")))
    owners = placed.select("h1", "h2", "owner", "n", "doc")
    runs = _runs(_levels(lines, min_lines), min_lines)
    if runs is None:
        return owners, lines.where("false").select("doc", F.array("line").alias("gone"))
    spans = runs.select("doc", F.col("line").alias("from"), (F.col("line") + F.col("length") - 1).alias("to"))
    return owners, spans.select("doc", F.explode(F.sequence("from", "to")).alias("gone")).groupBy("doc").agg(F.collect_set("gone").alias("gone"))


def _hashes(text):
    """Two 64-bit hashes that name a text."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with two more columns, n_lines and n_removed, and without later copies in its text.

    Lines end at U+000A. A run of ``min_lines`` lines or more that already occurred in a document with a
    smaller doc_id (null last), or further up in the same one and ended before the run begins, is deleted; runs are
    judged on the input. Of a text of one line a hundred times ``min_lines`` stay, of a longer period the first
    copies that make so many lines. A text that is the whole of an earlier document is a run whatever its length.
    Different texts with one doc_id are ordered by a hash of the text; rows that repeat doc_id and text are
    one document and come back alike. A null text stays null, with 0 lines; an empty one is a single empty
    line, which goes where an earlier document is empty too. Texts of any length are taken whole; a text is one
    row throughout. Nothing is dropped but lines: a document may end up empty. Columns named n_lines or
    n_removed are replaced; all others, whatever their names, come back. An empty table gives an empty one.
    """
    owners, gone = repeated_runs(docs, min_lines)
    known = durable(owners.join(gone, "doc", "left").select("h1", "h2", "owner", "n", "gone"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("own"), *_hashes(text))
    # a column of its own: inside a lambda the split would be done again for every line
    told = attach(rows.where(F.col("own").isNotNull()), known, ["h1", "h2"], frequent(known)).select("row", "own", F.split("own", "\n", -1).alias("lines"), "gone", F.col("id").eqNullSafe(F.col("owner")).alias("first"))
    lines = F.col("lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.when(~F.col("first"), "").when(F.col("gone").isNull(), F.col("own")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    removed = F.when(~F.col("first"), F.size(lines)).otherwise(F.coalesce(F.size("gone"), F.lit(0)))
    cut = told.select("row", left.alias("own"), F.size(lines).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
    empty = rows.where(F.col("own").isNull()).select("row", "own", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.unionByName(empty).select(*[F.col("own").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns], "n_lines", "n_removed")
