"""Reachable positions, the evaluation cache, and the annotated repertoire."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moves as m
from ..sources.scratch import materialise
from .edges import START
from .evals import with_evals
from .induction import NODE
from .stats import SLICE


def reachable(repertoire: DataFrame, edges: DataFrame, perspective: str, opp_min_games: int = 10, max_depth: int = 16, start: str = START) -> DataFrame:
    """(event, elo_band, parent_key, parent_state, depth): positions of the repertoire within
    max_depth plies of the start, where we follow our best move and the other side any move with at
    least opp_min_games games. depth is the shortest way.

    Where every step leads one ply deeper, which is read from the data, a round reads the steps of its
    own ply only and can find nothing twice. Otherwise it leaves out what earlier rounds found."""
    plies = edges.groupBy(*NODE).agg(F.min("ply").alias("from"), F.max("ply").alias("to"))
    nodes = materialise(repertoire.select(*NODE, "parent_state", "best_move", "side").join(plies, NODE))
    ours = F.col("to_move") == perspective[0]
    moves = nodes.select(*NODE, "best_move", F.col("side").alias("to_move")).join(edges.select(*NODE, "move_san", "child_key", "total", "ply"), NODE)
    steps = moves.filter((ours & (F.col("move_san") == F.col("best_move"))) | (~ours & (F.col("total") >= opp_min_games))).select(*NODE, "child_key", "ply").distinct()
    # only steps within the repertoire, looked up once and not in every round
    children = nodes.select(*SLICE, F.col("parent_key").alias("child_key"), "from", "to")
    steps = materialise(steps.join(children, [*SLICE, "child_key"]).sortWithinPartitions("ply"))
    off = steps.agg(F.max((F.col("from") != F.col("ply") + 1) | (F.col("to") != F.col("from")))).first()[0]
    frontier = materialise(nodes.filter(F.col("parent_key") == m.key64(F.lit(start))).select(*NODE, F.lit(0).alias("depth")))
    first = nodes.join(frontier, NODE, "left_semi").agg(F.min("from").alias("a"), F.max("to").alias("b")).first()
    levelled = not off and first["a"] == first["b"]
    found = [frontier]
    for depth in range(1, max_depth + 1):
        own = steps.filter(F.col("ply") == first["a"] + depth - 1) if levelled else steps
        new = frontier.join(own, NODE).select(*SLICE, F.col("child_key").alias("parent_key")).distinct()
        if not levelled:
            new = new.join(reduce(DataFrame.union, found), NODE, "left_anti")
        frontier = materialise(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found.append(frontier)
    # the texts of the states come in once, at the end
    return reduce(DataFrame.union, found).join(nodes.select(*NODE, "parent_state"), NODE).select(*NODE, "parent_state", "depth")


def reachable_states(found: DataFrame) -> DataFrame:
    return found.select(F.col("parent_state").alias("state")).distinct()


def pending_evals(states: DataFrame, cache: DataFrame, depth: int) -> DataFrame:
    """States that the cache lacks or has at a smaller depth."""
    known = cache.groupBy("state").agg(F.max("depth").alias("known"))
    return states.join(known, "state", "left").filter(F.coalesce("known", F.lit(0)) < depth).select("state")


CACHE = ["depth", "cp", "engine_best_uci", "evaluated_at"]


def _rank() -> Column:
    """An evaluation as a struct, the better one smaller: the deepest, then the latest, then the
    smallest other values; nulls last."""
    last = lambda c, x: [F.col(c).isNull(), x]
    keys = [*last("depth", -F.col("depth")), *last("evaluated_at", -F.unix_micros("evaluated_at")), *last("cp", F.col("cp")), *last("engine_best_uci", F.col("engine_best_uci"))]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *CACHE)


def best_evals(evals: DataFrame) -> DataFrame:
    """One row per state, the best one. Combined before the shuffle: no state's rows are gathered."""
    return evals.groupBy("state").agg(F.min(_rank()).alias("b")).select("state", *[F.col(f"b.{c}") for c in CACHE])


def merge_evals(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One row per state: the deepest, then the latest, then the smallest other values."""
    return best_evals(cache.unionByName(new))


def store_cache(cache: DataFrame, table: str, buckets: int) -> DataFrame:
    """The cache as a table clustered and sorted by state, one row each, for merge_stored and annotate:
    neither moves it any more. An older table of this name is replaced."""
    spark = cache.sparkSession
    best_evals(cache).repartition(buckets, "state").write.mode("overwrite").bucketBy(buckets, "state").sortBy("state").saveAsTable(table)
    return spark.table(table)


def merged_with_stored(stored: DataFrame, new: DataFrame) -> DataFrame:
    """merge_evals, with a stored cache: only the new rows, one a state, move to its clusters."""
    fresh = best_evals(new).select("state", _rank().alias("_new"))
    old = stored.select("state", F.when(F.lit(True), _rank()).alias("_old"))
    best = F.least("_old", "_new")  # the other one where one is null
    return old.join(fresh, "state", "full_outer").select("state", best.alias("b")).select("state", *[F.col(f"b.{c}") for c in CACHE])


def merge_stored(stored: str, new: DataFrame, table: str, buckets: int) -> DataFrame:
    """Merges new evaluations into the table `stored`; the result is the clustered table `table`,
    another one, so readers of the old one are not disturbed and a failed merge changes nothing."""
    if table == stored:
        raise ValueError("the merged cache needs a name of its own")
    spark = new.sparkSession
    merged_with_stored(spark.table(stored), new).write.mode("overwrite").bucketBy(buckets, "state").sortBy("state").saveAsTable(table)
    return spark.table(table)


def evals_from_games(games: DataFrame, max_ply: int = 30, key: str = "moveset") -> DataFrame:
    """The cache's columns from the evaluations in the games' own text: the mean centipawns after
    each move, mates as 10,000, by the state that the move leads to. depth is 10 plus the last digit
    of the number of evaluations seen."""
    # only a comment or a mating move gives an evaluation: other texts need not be read
    some = games.filter(F.contains("movetext", F.lit("[%eval")) | F.contains("movetext", F.lit("#")))
    rows = with_evals(some).select("evals", "moves").withColumn("valid", m.valid_length(F.col("moves")))
    n = F.least(F.col("valid"), F.size("evals"), F.lit(max_ply))
    text = F.get("evals", F.col("ply") - 1)
    cp = F.when(F.substring(text, 1, 1) == "#", F.when(F.substring(text, 2, 1) == "-", -10000.0).otherwise(10000.0)).otherwise(text.try_cast("double") * 100)
    rows = rows.select("evals", "moves", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("ply"))
    # summed by path first: a state is written once for each path to it, not once for each game
    paths = rows.select(F.slice("moves", F.lit(1), F.col("ply")).alias("path"), cp.alias("cp")).filter("cp is not null").groupBy("path").agg(F.sum("cp").alias("sum"), F.count("*").alias("n"))
    states = paths.select(m.state_text(F.col("path"), F.size("path") + 1, key).alias("state"), "sum", "n")
    out = states.groupBy("state").agg(F.round(F.sum("sum") / F.sum("n")).cast("bigint").alias("cp"), F.sum("n").alias("n"))
    return out.select("state", (10 + F.col("n") % 10).alias("depth"), "cp", F.lit(None).cast("string").alias("engine_best_uci"), F.lit(None).cast("timestamp").alias("evaluated_at"))


def annotate(repertoire: DataFrame, cache: DataFrame, perspective: str, threshold_cp: int = 100) -> DataFrame:
    """Adds eval_cp, eval_depth, engine_best_uci and is_safe (null where there is no evaluation).
    One row per state is expected in the cache; an empty one is fine."""
    known = cache.select(F.col("state").alias("parent_state"), F.col("cp").alias("eval_cp"), F.col("depth").alias("eval_depth"), "engine_best_uci")
    safe = F.col("eval_cp") >= -threshold_cp if perspective == "white" else F.col("eval_cp") <= threshold_cp
    return repertoire.join(known, "parent_state", "left").withColumn("is_safe", safe)


def safety_summary(annotated: DataFrame) -> DataFrame:
    out = annotated.agg(
        F.count("*").alias("positions"),
        F.count("eval_cp").alias("evaluated"),
        F.count_if(F.col("is_safe")).alias("safe"),
        F.count_if(~F.col("is_safe")).alias("unsafe"),
    )
    pct = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)), 2)
    return out.select("*", pct("evaluated", "positions").alias("evaluated_pct"), pct("safe", "evaluated").alias("safe_pct"), pct("unsafe", "evaluated").alias("unsafe_pct"), pct("safe", "positions").alias("safe_of_all_pct"), pct("unsafe", "positions").alias("unsafe_of_all_pct"))


def unsafe_first_moves(annotated: DataFrame, start: str = START) -> DataFrame:
    """Slices whose start position, where the first move is recommended, is flagged unsafe."""
    own = annotated.filter((F.col("parent_key") == m.key64(F.lit(start))) & ~F.col("is_safe"))
    return own.select(*SLICE, "best_move", F.round("value", 6).alias("value"), "eval_cp", "engine_best_uci").orderBy(*SLICE)


def worst_positions(annotated: DataFrame, perspective: str, k: int = 15) -> DataFrame:
    order = F.asc("eval_cp") if perspective == "white" else F.desc("eval_cp")
    own = annotated.filter("eval_cp is not null").orderBy(order, *SLICE, "parent_key").limit(k)
    return own.select(*SLICE, "parent_key", "parent_state", "eval_cp", "best_move")
