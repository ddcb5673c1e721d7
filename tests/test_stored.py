"""Tables that are kept and added to: manifests, monthly statistics and sketches, the stored cache."""

import uuid

import pytest
from pyspark.sql import functions as F

from movelines.operators import edges, safety, stats
from movelines.plans import queries
from movelines.sources import tables
from movelines.sources.scratch import materialise, scratch_dir

SF = "/root/testdata/sf0.001"
EVALS = "state string, depth long, cp long, engine_best_uci string, evaluated_at timestamp"


@pytest.fixture(scope="module")
def own(spark):
    return materialise(queries._edges(spark, SF))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest(spark):
    path = scratch_dir(spark)
    rows = spark.range(900).select(F.lit(1).alias("year"), (F.col("id") % 3).cast("int").alias("month"), F.when(F.col("id") % 2 == 0, "a").alias("event"), F.col("id").alias("x"))
    tables.write_logged(rows, path, max_rows=40)
    tables.write_logged(rows.filter("month = 1 and x < 100"), path)
    tables.write_logged(rows.filter("false"), path)
    manifest = tables.read_manifest(spark, path)
    got = {(r["month"], r["event"]): r["rows"] for r in manifest.collect()}
    table = tables.read_games(spark, path).groupBy("month", "event").count().collect()
    assert got == {(r["month"], r["event"]): r["count"] for r in table} and sum(got.values()) == 600 + 33
    assert manifest.filter("month = 0").agg(F.sum("files")).first()[0] == 2 * 4
    assert all("_manifest/" in f for f in manifest.inputFiles())


def test_a_write_without_its_manifest_is_caught_up(spark):
    path = scratch_dir(spark)
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "a", 2)], "year int, month int, event string, x int")
    tables.write_partitioned(rows, path)  # as if the manifest had failed
    tables.write_logged(rows.filter("month = 2"), path)
    assert sorted((r["month"], r["rows"]) for r in tables.read_manifest(spark, path).collect()) == [(1, 1), (2, 1)]


def test_months_add_up_to_the_full_run(spark, own):
    path = scratch_dir(spark)
    years = sorted(r[0] for r in own.select("year").distinct().collect())
    stats.add_months(own.filter(F.col("year") <= years[2]), path)
    lazy = stats.add_months(own.filter(F.col("year") > years[2]), path, 2)
    got = materialise(lazy)
    again = stats.add_months(own.filter(F.col("year") == years[0]), path, 2)
    want = stats.position_stats(own, 2)
    columns = want.columns
    assert want.exceptAll(got.select(columns)).count() == 0 == got.select(columns).exceptAll(want).count()
    assert again.count() == want.count()
    assert all(f"{path}/" in f.replace("file:///", "file:/") or path in f for f in lazy.inputFiles())  # the stored rows, no edges


def test_sketches_stay_within_their_error(spark):
    many = spark.range(60_000).select(F.lit(2000).alias("year"), (F.col("id") % 12).cast("int").alias("month"), F.lit(1).alias("ply"), F.xxhash64(F.col("id") % 20_000).alias("parent_key"))
    sketches = edges.ply_sketches(many)
    assert sketches.count() == 12
    r = edges.convergence_of_sketches(sketches).first()
    assert r["edges"] == 60_000 and abs(r["positions"] - 20_000) < 4 * 0.0063 * 20_000
    exact = edges.ply_convergence(many).first()
    assert abs(r["games_per_position"] - exact["games_per_position"]) <= 0.2


def test_sketches_of_few_positions_are_exact(spark, own):
    pick = lambda df: sorted((r["ply"], r["edges"], r["positions"]) for r in df.collect())
    assert pick(edges.convergence_of_sketches(edges.ply_sketches(own))) == pick(edges.ply_convergence(own))


def test_best_evaluations(spark):
    t = lambda s: f"2024-01-0{s} 00:00:00"
    rows = [("a", 5, 1, "x", None), ("a", 7, 9, "y", t(1)), ("a", 7, 8, "z", t(2)), ("b", 7, None, "y", t(1)), ("b", 7, 3, "z", t(1)), ("c", 1, 4, "n", None), ("c", 1, 4, "m", None), ("d", None, 2, None, None), ("d", 0, 1, None, None), ("e", None, None, None, None)]
    d = spark.createDataFrame([], EVALS).union(spark.createDataFrame(rows, "state string, depth long, cp long, engine_best_uci string, evaluated_at string").withColumn("evaluated_at", F.col("evaluated_at").cast("timestamp")))
    got = {r["state"]: (r["depth"], r["cp"], r["engine_best_uci"]) for r in safety.best_evals(d).collect()}
    assert got == {"a": (7, 8, "z"), "b": (7, 3, "z"), "c": (1, 4, "m"), "d": (0, 1, None), "e": (None, None, None)}


def test_a_stored_cache_does_not_move(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = spark.createDataFrame([(f"s{k}", k % 9, k, None, None) for k in range(300)], EVALS)
        new = spark.createDataFrame([(f"s{k}", k % 5 + 4, -k, "m", None) for k in range(200, 500)] * 2, EVALS)
        name = f"c_{uuid.uuid4().hex}"
        stored = safety.store_cache(old, f"{name}_1", 4)
        merged = safety.merged_with_stored(stored, new)
        text = plan(merged)
        before_scan = text[: text.index(f"{name}_1")]
        assert text.count("Exchange hashpartitioning(state") == 1  # the new rows, one a state
        assert "Exchange" not in before_scan.splitlines()[-1]
        out = safety.merge_stored(f"{name}_1", new, f"{name}_2", 4)
        want = safety.merge_evals(old, new)
        assert out.exceptAll(want).count() == 0 == want.exceptAll(out).count()
        rep = spark.createDataFrame([("s3", 1)], "parent_state string, x int")
        text = plan(safety.annotate(rep, out, "white"))
        assert text.count("Exchange hashpartitioning") == 1 and "state#" in text
        with pytest.raises(ValueError):
            safety.merge_stored(f"{name}_1", new, f"{name}_1", 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
