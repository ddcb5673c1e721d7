"""Evaluations that the move text carries: by line, by prefix, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import games as g
from ..functions import moves as m

RESULTS = ["white_wins", "draws", "black_wins"]


def with_evals(games: DataFrame) -> DataFrame:
    """Adds moves, evals (texts) and values (numbers), one for each move as far as the text goes."""
    out = games.withColumn("moves", m.san_moves(F.col("movetext"), "inline"))
    out = out.withColumn("evals", m.game_evals(F.col("movetext"), F.col("moves")))
    return out.withColumn("values", F.transform("evals", m.eval_value))


def aligned(games: DataFrame) -> DataFrame:
    """Games with exactly one evaluation for each move."""
    return with_evals(games).filter((F.size("moves") == F.size("evals")) & (F.size("moves") > 0))


def exact_mean(value: Column, weight: Column | None = None) -> Column:
    """The weighted mean of the values that are not null, rounded to 6 digits, half away from zero.
    It is summed and divided in whole millionths, so it doesn't depend on the order of rows."""
    weight = F.lit(1) if weight is None else weight
    s = F.sum(F.round(value * 1e6).cast("decimal(18,0)") * weight)
    n = F.sum(F.when(value.isNotNull(), weight)).cast("decimal(18,0)")
    size = F.call_function("div", F.abs(s) * 2 + n, F.nullif(n * 2, F.lit(0)))
    return F.when(s < 0, -size).otherwise(size).cast("double") / 1e6


def line_evals(games: DataFrame, n_moves: int = 20, merge: bool = False) -> DataFrame:
    """Per line: results, games and the mean of each ply's evaluation, nulls ignored. Results of a
    line whose means differ stay on rows of their own; merge=True gives one row per line, with
    means over all its games. Means are rounded to 6 digits."""
    n = 2 * n_moves
    rows = with_evals(games).withColumn("outcome", g.result_label(F.col("result"))).filter("outcome is not null")
    rows = rows.select(F.slice("moves", 1, n).alias("line"), "outcome", *m.wide_evals(F.col("values"), n_moves))
    evals = m.eval_columns(n_moves)
    means = [exact_mean(F.col(c)).alias(c) for c in evals]
    if merge:
        out = rows.groupBy("line").agg(*[F.count_if(F.col("outcome") == r).alias(r) for r in RESULTS], F.count("*").alias("total_games"), *means)
    else:
        own = rows.groupBy("line", "outcome").agg(F.count("*").alias("n"), *means)
        out = own.groupBy("line", *evals).agg(*[F.sum(F.when(F.col("outcome") == r, F.col("n")).otherwise(0)).alias(r) for r in RESULTS], F.sum("n").alias("total_games"))
    return out.select(m.line_key(F.col("line"), F.size("line")).alias("line_text"), "line", *RESULTS, "total_games", *evals)


def rollup_line_evals(lines: DataFrame, n_moves: int = 20, weighting: str = "leaf") -> DataFrame:
    """Per prefix: summed counts and the mean of its last ply's evaluation. `leaf`: each row of
    `lines` weighs the same; `game`: each game does."""
    ends = F.when(F.size("line") > 0, F.sequence(F.lit(1), F.size("line"))).otherwise(F.array().cast("array<int>"))
    rows = lines.select("line", *RESULTS, "total_games", F.array(*m.eval_columns(n_moves)).alias("e"), F.explode(ends).alias("ply"))
    rows = rows.withColumn("prefix", m.line_key(F.col("line"), F.col("ply"))).withColumn("value", F.get("e", F.col("ply") - 1))
    if weighting == "leaf":
        mean = exact_mean(F.col("value"))
    elif weighting == "game":
        mean = exact_mean(F.col("value"), F.col("total_games"))
    else:
        raise ValueError(weighting)
    return rows.groupBy("ply", "prefix").agg(*[F.sum(c).alias(c) for c in [*RESULTS, "total_games"]], mean.alias("mean_eval"))


def prefix_evals(games: DataFrame, max_ply: int = 40) -> DataFrame:
    """The mean evaluation after each prefix, over aligned games."""
    rows = aligned(games).select(F.posexplode(F.arrays_zip(F.slice(m.running_prefix(F.col("moves")), 1, max_ply).alias("prefix"), F.slice("values", 1, max_ply).alias("value"))))
    rows = rows.select(F.col("col.prefix").alias("prefix"), F.col("col.value").alias("value"))
    return rows.groupBy("prefix").agg(exact_mean(F.col("value")).alias("numeric_eval"), F.count("*").alias("games"))


def prefix_evals_wide(prefixes: DataFrame, n_moves: int = 20) -> DataFrame:
    return prefixes.select("prefix", "numeric_eval", *m.wide_moves(F.split("prefix", " "), n_moves))
