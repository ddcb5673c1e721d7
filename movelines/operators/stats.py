"""Position-and-move statistics of edges, by event and rating band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moves as m
from ..sources.tables import write_partitioned
from .edges import START

SLICE = ["event", "elo_band"]


def _counts(edges: DataFrame) -> list[Column]:
    """The least child and ply, and counts of games: a row of edges is one game, or as many as its column games says."""
    score = F.col("white_score")
    count = (lambda c: F.sum(F.when(c, F.col("games")).otherwise(0))) if "games" in edges.columns else F.count_if
    return [
        F.min("child_key").alias("child_key"),
        F.min("ply").alias("ply"),
        count(score == 1.0).alias("white_wins"),
        count(score == 0.5).alias("draws"),
        count(score == 0.0).alias("black_wins"),
        count(F.lit(True)).alias("total"),
    ]


def position_stats(edges: DataFrame, min_games: int = 10, max_ply: int | None = None) -> DataFrame:
    """Counts by (event, elo_band, parent_key, move_san) with at least min_games games. Games
    without a score count in total only; null bands are a group of their own. edges: from position_edges or,
    where many games share a line, line_edges."""
    if max_ply is not None:
        edges = edges.filter(F.col("ply") <= max_ply)
    # the state goes with its key: as a grouping column it leaves the rest to be aggregated by hash
    out = edges.groupBy(*SLICE, "parent_key", "move_san", "parent_state").agg(*_counts(edges))
    out = out.filter(F.col("total") >= min_games)
    return out.withColumn("white_score_avg", (F.col("white_wins") + 0.5 * F.col("draws")) / F.col("total"))


MONTH = ("year", "month")


def partial_stats(edges: DataFrame) -> DataFrame:
    """What a month of edges adds to the statistics, by (year, month, event, elo_band, parent_key,
    move_san): sums and minima, which merge."""
    return edges.groupBy(*MONTH, *SLICE, "parent_key", "move_san", "parent_state").agg(*_counts(edges))


def merge_stats(partials: DataFrame, min_games: int = 10) -> DataFrame:
    """position_stats of all the months that the partials hold."""
    out = partials.groupBy(*SLICE, "parent_key", "move_san", "parent_state").agg(*[F.min(c).alias(c) for c in ("child_key", "ply")], *[F.sum(c).alias(c) for c in ("white_wins", "draws", "black_wins", "total")])
    out = out.filter(F.col("total") >= min_games)
    return out.withColumn("white_score_avg", (F.col("white_wins") + 0.5 * F.col("draws")) / F.col("total"))


def add_months(edges: DataFrame, path: str, min_games: int = 10) -> DataFrame:
    """Adds the months of `edges` to the partial statistics stored at `path`, in place of what was
    there of these months, and returns the statistics of all months (read them before the next call,
    which may replace files). Older edges aren't read."""
    write_partitioned(partial_stats(edges), path, MONTH)
    return merge_stats(edges.sparkSession.read.parquet(path), min_games)


def stats_coverage(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("rows"), F.count_distinct("parent_key").alias("positions"))


def rows_per_event(stats: DataFrame) -> DataFrame:
    return stats.groupBy("event").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "event")


def top_first_moves(stats: DataFrame, k: int = 3, start: str = START) -> DataFrame:
    """The k first moves with the best score of each slice; ties by move."""
    own = stats.filter(F.col("parent_key") == m.key64(F.lit(start)))
    w = Window.partitionBy(*SLICE).orderBy(F.desc("white_score_avg"), "move_san")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*SLICE, "rank", "move_san", "white_score_avg", "total")
