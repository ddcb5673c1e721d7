"""Mixing sources to target weights by capped water-filling.

Sources share a total by weight, but none may be repeated more than `max_epochs` times. In each
round the sources that their share puts above that cap are clamped to it, and what they give up
goes to the others in proportion to their weights, until none is above its cap. A round is one
aggregation over the sources; only its sums come to the driver, however many sources there are.

A source at target / size = 2.3 takes each document twice, and three tenths of its words once
more: in a seeded random order of its documents, whole ones until the words are used up, and of
the last document its first words. The running sums of that order are taken in hash ranges, and
over the ranges' sums, so a source with a third of all rows is not one task. Rows that repeat id,
source and text are one entry of that order with a count, so their number doesn't matter either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """sources: (source, source_size, weight), one row per source. Adds target.

    A size or weight of zero gives a target of zero. If all caps together are below the total,
    every source is at its cap.
    """
    s = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    total, level, before = None, 0.0, None
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        total, clamped, open_, n = s.agg(
            F.sum("source_size").cast("double"), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))).cast("double"), F.count(F.when(above, 1))
        ).first()
        # the clamped sources only become more, so a round that clamps no other is the last
        if n == before or not open_:
            level = level if open_ else math.inf
            break
        level, before = (total - (clamped or 0.0)) / open_, n
    target = F.when(F.col("weight") > 0, F.least("cap", F.lit(level) * F.col("weight"))).otherwise(F.lit(0.0))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def ranked(sources: DataFrame, column: str = "source") -> DataFrame:
    """Adds place: 0, 1, ... by code point, null last, without all rows in one task. There are no
    more ranges than shuffle partitions, and only their counts are summed in one."""
    null = F.col(column).isNull().cast("int")
    s = materialise(sources.repartitionByRange(null, F.col(column)).withColumn("_range", F.spark_partition_id()))
    counts = s.groupBy("_range").agg(F.count("*").alias("_mix_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(null, column)) - 1
    return s.withColumn("_inside", inside).join(starts, "_range").withColumn("place", F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def _key(id_: Column, text: Column, seed: int) -> Column:
    """Where a row stands in the order of its source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_epochs: float, seed: int, range_rows: int) -> DataFrame:
    """A row for each id, source and text: id, source, key, size, n (rows), source_size, target,
    whole (repetitions of each row), more (words that the rows take once more, all together)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(F.col(id_col), F.col(text_col), seed).alias("key"), size_of(F.col(text_col)).alias("size"))
    rows = materialise(rows.groupBy("id", "source", "key", "size").agg(F.count("*").alias("n")))
    words = F.col("size") * F.col("n")
    sources = ranked(rows.groupBy("source").agg(F.sum(words).alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    goals = targets(materialise(sources.withColumn("weight", weight)), max_epochs)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = goals.withColumn("whole", F.floor("epochs")).withColumn("left", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    digits = max(1, math.ceil(math.log(max(2, rows.count() / range_rows), 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "range").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = rows.alias("r").join(sums.alias("s"), F.expr("r.source <=> s.source and r.range = s.range")).select("r.*", "s.base")
    done = placed.alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source")).select("p.*", "g.source_size", "g.target", "g.whole", "g.left")
    more = F.least(words, F.greatest(F.lit(0), F.col("left") - F.col("base") - F.col("inner"))).cast("long")
    return done.withColumn("more", more).drop("range", "inner", "base", "left")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: float = 3.0, seed: int = 17, range_rows: int = 100_000) -> DataFrame:
    """One row per input row: id, size (words), source, source_size, target, taken (words the
    mix takes, repeats counted), whole (whole repetitions) and part (words of one more).

    weights repeat over the sources in code-point order, null last. A null text has no words;
    a null source is a source. Rows that repeat an id are told apart by text, else they are
    alike and follow one another; the same input gives the same rows. An empty table
    gives no rows. Other columns are ignored.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, max_epochs, seed, range_rows)
    rows = plan.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("more") - F.col("_k") * F.col("size"))).cast("long")
    rows = rows.withColumn("part", part).withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
    return rows.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "taken", F.col("whole").cast("int").alias("whole"), "part")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(1, 2, 3),
    max_epochs: float = 3.0,
    seed: int = 17,
    range_rows: int = 100_000,
) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole repetition of a text, and
    one for a part of it (its first words, joined by one space). Rows that repeat id, source and
    text share what they take once more, which comes with the other columns of any one of them."""
    plan = materialise(_plan(docs, id_col, text_col, source_col, weights, max_epochs, seed, range_rows).filter("size > 0 and (whole > 0 or more > 0)"))
    plan = plan.select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("key").alias("_mix_at"), F.col("size").alias("_mix_size"), F.col("n").alias("_mix_n"), F.col("whole").alias("_mix_whole"), F.col("more").alias("_mix_more"))
    keyed = docs.withColumn("_mix_key", _key(F.col(id_col), F.col(text_col), seed))

    def meet(part: DataFrame) -> DataFrame:
        same = keyed[id_col].eqNullSafe(part["_mix_id"]) & keyed[source_col].eqNullSafe(part["_mix_source"]) & (keyed["_mix_key"] == part["_mix_at"])
        return keyed.join(part, same)

    def copies(rows: DataFrame, whole: Column, words: Column) -> DataFrame:
        times = whole.cast("int") + F.floor(words / F.col("_mix_size")).cast("int")
        rest = words % F.col("_mix_size")
        return rows.withColumn("_mix_take", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))

    out = copies(meet(plan), F.col("_mix_whole"), F.when(F.col("_mix_n") == 1, F.col("_mix_more")).otherwise(F.lit(0)))
    shared = plan.filter("_mix_n > 1 and _mix_more > 0")
    if not shared.isEmpty():
        out = out.unionByName(copies(meet(shared).dropDuplicates(["_mix_id", "_mix_source", "_mix_at"]), F.lit(0), F.col("_mix_more")))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_mix_take").cast("int")), " ")
    text = F.when(F.col("_mix_take") > 0, cut).otherwise(F.col(text_col))
    fresh = {text_col: text}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])
