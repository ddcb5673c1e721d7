"""Repertoire by backwards induction over the position graph, all slices in one job.

Input edges: (event, elo_band, parent_key, child_key, move_san, side, total, white_score_avg and
parent_state), as made by graph_edges. Our side takes the best child, the other side plays as its
games did. Values are White's expected score.

A position is valued when all its children in the data are. Each position has a counter of such
edges that are still open, and what its valued children have given so far: the best child, the
weighted sum. A round sends the values just found over the edges that lead to them, once an edge,
adds them up for the positions that they reach, and values those whose counter is full. So a round
follows its frontier and nothing that is left is written again. What is left in the end (cycles) is
valued in one round from the values found so far, so that nothing depends on the order of rows.

Where every child lies exactly one ply deeper, which is read from the data, a round needs only the
values of the next ply: one join and one aggregation a ply, without counters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moves as m
from ..sources.scratch import materialise
from .edges import START
from .stats import SLICE

NODE = [*SLICE, "parent_key"]


def graph_edges(stats: DataFrame, side: Column | None = None) -> DataFrame:
    """Statistics with a band and a child, and the side to move (w or b): the last letter of the
    state, where no other column is given."""
    side = F.substring("parent_state", -1, 1) if side is None else side
    return stats.filter("elo_band is not null and child_key is not null").select(*SLICE, "parent_key", "child_key", "move_san", side.alias("side"), "ply", "total", "white_score_avg", "parent_state")


def slice_priors(stats: DataFrame, min_games: int = 100, start: str = START) -> DataFrame:
    """Each slice's mean score over its start position's moves, weighted by games; 0.5 if they have
    fewer than min_games games."""
    at_start = F.col("parent_key") == m.key64(F.lit(start))
    out = stats.filter("elo_band is not null").groupBy(*SLICE).agg(
        F.sum(F.when(at_start, F.col("white_score_avg") * F.col("total")).otherwise(0.0)).alias("s"),
        F.sum(F.when(at_start, F.col("total")).otherwise(0)).alias("start_games"),
    )
    return out.select(*SLICE, "start_games", F.when(F.col("start_games") < max(min_games, 1), 0.5).otherwise(F.col("s") / F.col("start_games")).alias("prior"))


def smoothed_score(average: Column, n: Column, prior: Column, strength: float = 30.0) -> Column:
    """The mean of a Beta prior of the given strength and the games seen."""
    return (strength * prior + average * n) / (strength + n)


def leaf_values(edges: DataFrame, priors: DataFrame, strength: float = 30.0) -> DataFrame:
    out = edges.join(priors.select(*SLICE, "prior"), SLICE)
    return out.withColumn("leaf_value", smoothed_score(F.col("white_score_avg"), F.col("total"), F.col("prior"), strength))


def forcingness(edges: DataFrame) -> DataFrame:
    """Simpson's index of each position's moves: 1 if only one is played."""
    n = F.col("total").cast("double")
    return edges.groupBy(*NODE).agg((F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("forcingness"))


def _best(v: Column, perspective: str, weight: float) -> Column:
    """What orders the children of a position from our side, and what the best one gives it."""
    score = F.round((1.0 if perspective == "white" else -1.0) * v + weight * F.col("child_forcingness"), 9)
    return F.struct((-score).alias("s"), F.col("move_san").alias("move"), v.alias("v"), F.col("child_forcingness").alias("f"))


def _chosen(side: Column, best: Column, mean: Column, perspective: str) -> list[Column]:
    ours = side == perspective[0]
    return [F.when(ours, best["v"]).otherwise(mean).alias("value"), F.when(ours, best["move"]).alias("best_move"), F.when(ours, best["f"]).alias("forcingness")]


def _valued(ready: DataFrame, values: DataFrame | None, perspective: str, weight: float) -> DataFrame:
    """Values of the parents of `ready`, all of whose edges it has."""
    if values is not None:
        known = values.select(*SLICE, F.col("parent_key").alias("child_key"), F.col("value").alias("child_value"))
        ready = ready.join(known, [*SLICE, "child_key"], "left")
    else:
        ready = ready.withColumn("child_value", F.lit(None).cast("double"))
    v = F.coalesce("child_value", "leaf_value")
    mean = (F.sum(v * F.col("total")) / F.sum("total")).alias("mean")
    out = ready.groupBy(*NODE).agg(F.min("side").alias("side"), F.min("parent_state").alias("parent_state"), F.min(_best(v, perspective, weight)).alias("best"), mean)
    return out.select(*NODE, "parent_state", "side", *_chosen(F.col("side"), F.col("best"), F.col("mean"), perspective))


def _by_counters(full: DataFrame, perspective: str, weight: float) -> DataFrame:
    """The general form: values of all positions of any graph."""
    known, leaf = F.col("child_known"), F.col("leaf_value")
    nodes = materialise(
        full.groupBy(*NODE).agg(
            F.min("side").alias("side"),
            F.min("parent_state").alias("parent_state"),
            F.count_if(known).alias("open"),
            F.min(F.when(~known, _best(leaf, perspective, weight))).alias("best"),
            F.coalesce(F.sum(F.when(~known, leaf * F.col("total"))), F.lit(0.0)).alias("sum"),
            F.sum("total").alias("games"),
        )
    )
    inner = materialise(full.filter(known).select(*NODE, "child_key", "move_san", "total", "child_forcingness"))
    value = lambda df: df.select(*NODE, *_chosen(F.col("side"), F.col("best"), F.col("sum") / F.col("games"), perspective))
    now = materialise(value(nodes.filter("open = 0")))
    waiting, sent, done = nodes.filter("open > 0"), [], []
    while not now.isEmpty():
        done.append(now)
        frontier = now.select(*SLICE, F.col("parent_key").alias("child_key"), F.col("value").alias("v"))
        given = inner.join(frontier, [*SLICE, "child_key"]).groupBy(*NODE).agg(F.count("*").alias("got"), F.min(_best(F.col("v"), perspective, weight)).alias("new_best"), F.sum(F.col("v") * F.col("total")).alias("new_sum"))
        sent.append(materialise(given))
        # all that the positions reached now were ever sent
        all_sent = reduce(DataFrame.union, sent).join(sent[-1].select(*NODE), NODE, "left_semi")
        sums = all_sent.groupBy(*NODE).agg(F.sum("got").alias("got"), F.min("new_best").alias("new_best"), F.sum("new_sum").alias("new_sum"))
        full_now = waiting.join(sums, NODE).filter("got = open")
        now = materialise(value(full_now.withColumn("best", F.least("best", "new_best")).withColumn("sum", F.col("sum") + F.col("new_sum"))))
        if len(done) > 8:  # many small tables become one
            done = [materialise(reduce(DataFrame.union, done))]
        if len(sent) > 8:
            sent = [materialise(reduce(DataFrame.union, sent))]
    named = nodes.select(*NODE, "parent_state", "side")
    if not done:
        return _valued(full, None, perspective, weight)
    values = reduce(DataFrame.union, done)
    rest = full.join(values.select(*NODE), NODE, "left_anti")
    columns = [*NODE, "parent_state", "side", "value", "best_move", "forcingness"]
    return values.join(named, NODE).select(*columns).union(_valued(rest, values, perspective, weight).select(*columns))


def backward_induction(edges: DataFrame, priors: DataFrame, perspective: str, prior_strength: float = 30.0, forcing_weight: float = 0.0, levels: bool | None = None) -> DataFrame:
    """(event, elo_band, parent_key, parent_state, side, value, best_move, forcingness): one row per
    position. Our turn: the child with the largest sign * value + weight * forcingness, ties by move;
    the row's value is that child's value without the bonus. The other's turn: the mean of the
    children's values weighted by games. A child that isn't in the data has its edge's smoothed
    score.

    Any graph is right: whether all children lie one ply deeper is read from the data. levels=False
    takes the general form anyway; levels=True raises where it is needed."""
    if perspective not in ("white", "black"):
        raise ValueError(perspective)
    n = F.col("total").cast("double")
    child = edges.groupBy(*SLICE, F.col("parent_key").alias("child_key")).agg((F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("child_forcingness"), F.min("ply").alias("_from"), F.max("ply").alias("_to"))
    full = leaf_values(edges, priors, prior_strength).join(child, [*SLICE, "child_key"], "left").withColumn("child_known", F.col("_from").isNotNull())
    full = materialise(full.fillna(0.0, ["child_forcingness"]).sortWithinPartitions("ply"))  # files in order of ply, so that a ply reads its own pages
    # one ply deeper, and no position at two depths: those without parents are looked at by themselves
    off = F.coalesce(F.max((F.col("_from") != F.col("ply") + 1) | (F.col("_to") != F.col("_from"))), F.lit(False))
    seen = full.agg(off.alias("off"), F.min("ply").alias("first"), F.max("ply").alias("last")).first()
    levelled = levels is not False and not seen["off"] and full.groupBy(*NODE).agg((F.min("ply") < F.max("ply")).alias("two")).filter("two").isEmpty()
    if levels and not levelled:
        raise ValueError("positions lie at several depths: leave levels out")
    if not levelled:
        return _by_counters(full, perspective, forcing_weight)
    done: list[DataFrame] = []
    for ply in range(seen["last"], seen["first"] - 1, -1) if seen["last"] is not None else ():
        done.append(materialise(_valued(full.filter(F.col("ply") == ply), done[-1] if done else None, perspective, forcing_weight)))
    return reduce(DataFrame.union, done) if done else _valued(full, None, perspective, forcing_weight)


def recommended_first_moves(repertoire: DataFrame, start: str = START) -> DataFrame:
    own = repertoire.filter((F.col("parent_key") == m.key64(F.lit(start))) & F.col("best_move").isNotNull())
    return own.select(*SLICE, "best_move", F.round("value", 6).alias("value")).orderBy(*SLICE)


def largest_slice(repertoire: DataFrame) -> DataFrame:
    return repertoire.groupBy(*SLICE).agg(F.count("*").alias("positions")).orderBy(F.desc("positions"), *SLICE).limit(1)


def next_moves(repertoire: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per position of the repertoire: our best move, or the other side's most played."""
    popular = edges.groupBy(*NODE).agg(F.min(F.struct((-F.col("total")).alias("n"), "move_san", "child_key")).alias("p"))
    ours = edges.select(*NODE, F.col("move_san").alias("best_move"), F.col("child_key").alias("best_child"))
    out = repertoire.select(*NODE, "best_move", "side").join(popular, NODE).join(ours, [*NODE, "best_move"], "left")
    return out.select(*NODE, "side", F.coalesce("best_move", "p.move_san").alias("move"), F.when(F.col("best_move").isNotNull(), F.col("best_child")).otherwise(F.col("p.child_key")).alias("child_key"))


def _further(at: DataFrame, jumps: DataFrame) -> DataFrame:
    """Each row's way, carried on by the jump from where it has come to."""
    on = jumps.select(*SLICE, F.col("parent_key").alias("to"), F.col("to").alias("_to"), F.col("way").alias("_way"))
    out = at.join(on, [*SLICE, "to"], "left").withColumn("way", F.concat("way", F.coalesce("_way", F.array().cast("array<struct<side:string,move:string>>"))))
    return out.withColumn("to", F.col("_to")).drop("_to", "_way")


def best_lines(repertoire: DataFrame, edges: DataFrame, max_depth: int = 12, start: str = START) -> DataFrame:
    """The main line of each slice from the start, with move numbers before White's moves. Jumps of
    1, 2, 4 ... plies are made from one another, so max_depth plies take a join for each binary digit
    and one for each digit that is 1."""
    jumps = materialise(next_moves(repertoire, edges).select(*NODE, F.col("child_key").alias("to"), F.array(F.struct("side", "move")).alias("way")))
    at = jumps.select(*SLICE).distinct().select(*SLICE, m.key64(F.lit(start)).alias("to"), F.array().cast("array<struct<side:string,move:string>>").alias("way"))
    depth = max_depth
    while depth:
        if depth & 1:
            at = _further(at, jumps)
        depth >>= 1
        if depth:
            jumps = materialise(_further(jumps, jumps))
    words = F.transform("way", lambda s, k: F.concat(F.when(s["side"] == "w", F.concat((F.floor(k / 2) + 1).cast("string"), F.lit(". "))).otherwise(""), s["move"]))
    return at.select(*SLICE, F.array_join(words, " ").alias("line"), F.size("way").alias("plies"))
