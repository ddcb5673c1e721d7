"""Cases of the findings of round 3."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from movelines.llm import quality
from movelines.plans import fixtures, queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_convergence_by_year_is_exact(spark, monkeypatch):
    """more positions than a sketch counts exactly, most of them in several months."""
    k = F.col("id")
    many = spark.range(60_000).select((F.lit(1995) + k % 2).cast("int").alias("year"), (k % 12).cast("int").alias("month"), (k % 3 + 1).cast("int").alias("ply"), F.xxhash64(k % 30_001).alias("parent_key"))
    monkeypatch.setattr(queries, "_edges", lambda *_: many)
    got = {(r["year"], r["ply"]): (r["edges"], r["positions"]) for r in queries.ply_convergence_months(spark, SF).collect()}
    want = many.groupBy("year", "ply").agg(F.count("*").alias("e"), F.count_distinct("parent_key").alias("p")).collect()
    assert got == {(r["year"], r["ply"]): (r["e"], r["p"]) for r in want}


def test_first_moves_write_states_once(spark):
    """the comparison with the start brings no second copy of the states into a filter."""
    text = plan(queries.first_moves(spark, SF))
    assert text.count("md5") == 1 and text.count("Filter isnotnull(transform") == 0


def test_game_texts_come_from_one_sort(spark):
    """F3 and those that share the step: plies are gathered in the order of the window, not sorted again."""
    text = plan(fixtures.raw_games(spark, SF))
    items = text[text.index("Window") :]
    assert "ObjectHashAggregate" not in text and items.count("Sort ") == 1 and items.count("Exchange") == 1


def test_game_texts_are_not_broadcast(spark):
    """at 6 times sf0.1 Spark's estimate took the texts for small: orders were read by two tasks."""
    assert "BroadcastHashJoin" not in plan(fixtures.raw_games(spark, SF))


def test_the_training_sample_is_held_once():
    """Pipeline on check_h: the driver held the sample three times; the values are views of the column now."""
    column = pa.chunked_array([pa.array([b"skip", np.arange(3, dtype="<i4").tobytes(), b""], pa.binary()).slice(1), pa.array([np.arange(5, dtype="<i4").tobytes()], pa.binary())])
    views = quality._views(column, "<i4")
    assert [v.tolist() for v in views] == [[0, 1, 2], [], [0, 1, 2, 3, 4]]
    assert not any(v.flags.owndata for v in (views[0], views[2]))


def test_annotation_reads_the_games_once(spark, monkeypatch):
    """F7 to F10 and F12: statistics and evaluations come from one stored copy of the games."""
    made, raw = [], fixtures.raw_games
    monkeypatch.setattr(fixtures, "raw_games", lambda *a: made.append(1) or raw(*a))
    queries._annotated(spark, SF, "white")
    assert len(made) == 1
