"""Cleaned games, and subsets and counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import games as g
from ..functions import moves as m

# Source columns and their names in the cleaned table.
RENAMED = {
    "Site": "site",
    "White": "white",
    "Black": "black",
    "Result": "result",
    "WhiteTitle": "white_title",
    "BlackTitle": "black_title",
    "WhiteElo": "white_elo",
    "BlackElo": "black_elo",
    "WhiteRatingDiff": "white_rating_diff",
    "BlackRatingDiff": "black_rating_diff",
    "UTCDate": "utc_date",
    "UTCTime": "utc_time",
    "ECO": "eco",
    "Opening": "opening",
    "Termination": "termination",
    "TimeControl": "time_control",
    "movetext": "movetext",
}
DERIVED = ["game_id", "mean_elo", "elo_band", "white_score", "move_count", "opening_family", "eco_class", "has_eval", "base_time", "increment"]


def clean_games(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rated games of the six kept kinds: 17 renamed columns, the partition keys, 10 derived ones, and
    the columns of `keep` as they are."""
    kept = raw.filter(F.col("Event").isin(*g.EVENTS))
    ratings = {"white_elo", "black_elo"}
    names = [(F.col(old).try_cast("int") if new in ratings else F.col(old)).alias(new) for old, new in RENAMED.items()]
    base = kept.select(*names, g.event_label(F.col("Event")).alias("event"), F.col("year").cast("int"), F.col("month").cast("int"), *keep)
    mean = g.mean_elo(F.col("white_elo"), F.col("black_elo"))
    return base.select(
        "*",
        F.replace(F.col("site"), F.lit(g.SITE_PREFIX), F.lit("")).alias("game_id"),
        mean.alias("mean_elo"),
        g.elo_band(mean).alias("elo_band"),
        g.white_score(F.col("result")).alias("white_score"),
        F.regexp_count("movetext", F.lit(r"\d+\.\s")).alias("move_count"),
        F.substring_index("opening", ":", 1).alias("opening_family"),
        F.substring("eco", 1, 1).alias("eco_class"),
        F.contains("movetext", F.lit("[%eval")).alias("has_eval"),
        g.time_control(F.col("time_control"), 1).alias("base_time"),
        g.time_control(F.col("time_control"), 2).alias("increment"),
    )


def count_by(games: DataFrame, **keys: Column) -> DataFrame:
    return games.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("games"))


def analysis_subset(games: DataFrame, month: int, events=g.SLOW_EVENTS, min_elo: int = 1500) -> DataFrame:
    """Games of one month with evaluations, of the slow kinds, between players rated min_elo or more."""
    return games.filter((F.col("month") == month) & F.col("has_eval") & F.col("event").isin(*events) & (F.col("white_elo") >= min_elo) & (F.col("black_elo") >= min_elo))


def book_lengths(book: DataFrame) -> DataFrame:
    return book.select(m.line_key(F.col("line"), F.size("line")).alias("head"), F.size("line").alias("plies"))


def in_opening_set(games: DataFrame, book: DataFrame, flag: str = "in_set", moves: str = "moves") -> DataFrame:
    """Adds `flag`: whether the game starts with a line of the book (array column `line`), of any
    length. Each game looks up its own first plies, in the lengths that the book has, in the set of
    lines: a list in the plan if it is short (its size is checked), else a join."""
    lines = book_lengths(book).filter("plies > 0").distinct()
    lengths = sorted(r["plies"] for r in lines.select("plies").distinct().collect())  # at most the longest line
    if not lengths:
        return games.withColumn(flag, F.lit(False))
    heads = F.array(*[F.when(F.size(moves) >= n, m.line_key(F.col(moves), F.lit(n))) for n in lengths])
    known = [r["head"] for r in lines.select("head").orderBy("head").limit(MAX_BOOK + 1).collect()]
    if len(known) <= MAX_BOOK:
        return games.withColumn(flag, F.exists(heads, lambda h: F.coalesce(h.isin(*known), F.lit(False))))
    keyed = games.withColumn("_game", F.xxhash64("game_id", moves))
    hits = keyed.select("game_id", "_game", F.explode(F.array_distinct(heads)).alias("head")).join(lines.select("head"), "head").select("game_id", "_game").distinct()
    return keyed.join(hits.withColumn("_hit", F.lit(True)), ["game_id", "_game"], "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_game", "_hit")


#: A longer book is joined instead of written into the plan.
MAX_BOOK = 1_000


def truncate_by_opening(games: DataFrame, book: DataFrame, other_book: DataFrame | None = None, in_set: int = 21, outside: int = 11, other: int = 6) -> DataFrame:
    """`moves` cut before move 21 if the game is in the book, else before move 11; before move 6
    if it is in the other book."""
    out = in_opening_set(games, book, "in_set")
    n = F.when(F.col("in_set"), in_set).otherwise(outside)
    if other_book is not None:
        out = in_opening_set(out, other_book, "in_other")
        n = F.when(F.col("in_other"), other).otherwise(n)
    return out.withColumn("cut_moves", F.slice("moves", F.lit(1), 2 * (n - 1)))
