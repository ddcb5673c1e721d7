"""The whole chain from raw games to a repertoire, in one application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean, edges, induction, stats
from ..sources import tables
from ..sources.scratch import materialise


def build_repertoire(
    raw: DataFrame,
    perspective: str,
    year_range=None,
    games_per_partition: int | None = None,
    min_games: int = 10,
    max_ply: int = 30,
    prior_strength: float = 30.0,
    prior_games: int = 100,
    forcing_weight: float = 0.0,
    out: str | None = None,
    key: str = "moveset",
    states: str = "states",
    start: str | None = None,
    side: Column | None = None,
) -> DataFrame:
    """Clean, extract edges, aggregate, induce. A stage that fails stops the rest by its exception.
    With `out`, every stage's table is also kept there. games_per_partition, if given, takes only
    that many games of each partition. The result is in order of slice and position.

    key: how states are told apart, as in position_edges. Supplied states come from the raw games'
    array column `states`; `start` is then the text of the first one, and `side` the side to move
    (w or b) as a column over parent_state, its last letter by default."""
    if key == "supplied" and start is None:
        raise ValueError("supplied states need the text of the start")
    start = start if start is not None else edges.STARTS[key]
    if key == "path" and side is None:
        side = F.when(F.col("ply") % 2 == 1, "w").otherwise("b")
    games = clean.clean_games(raw, (states,) if key == "supplied" else ())
    if year_range:
        games = tables.select_partitions(games, year_range=year_range)
    if games_per_partition:
        games = tables.limit_per_partition(games, games_per_partition)
    found = stats.position_stats(edges.line_edges(games, (), max_ply, key, states), min_games)
    if out:
        tables.write_table(found, f"{out}/stats")
        found = tables.read_stats(raw.sparkSession, f"{out}/stats")
    else:
        found = materialise(found)
    priors = induction.slice_priors(found, prior_games, start)
    result = induction.backward_induction(induction.graph_edges(found, side), priors, perspective, prior_strength, forcing_weight)
    if out:
        tables.write_table(result, f"{out}/repertoire_{perspective}")
        result = tables.read_stats(raw.sparkSession, f"{out}/repertoire_{perspective}")
    return result.orderBy(*induction.NODE)
