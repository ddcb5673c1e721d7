"""Invariants of the game operators, and the plans that they must have."""

import pytest
from pyspark.sql import functions as F

from movelines.operators import clean, edges, evals, explorer, induction, safety, stats
from movelines.plans import fixtures, queries
from movelines.sources import tables
from movelines.sources.scratch import materialise, scratch_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def games(spark):
    return materialise(queries.games(spark, SF))


@pytest.fixture(scope="module")
def tree(spark, games):
    return materialise(explorer.prefix_tree(explorer.line_counts(games)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_need_no_shuffle(spark, games):
    assert "Exchange" not in plan(edges.position_edges(games)) and "Python" not in plan(edges.position_edges(games))


def test_partition_and_column_pruning(spark, games):
    path = scratch_dir(spark)
    tables.write_partitioned(games.select("year", "month", "event", "game_id", "movetext"), path, keys=("year", "event"))
    own = tables.select_partitions(tables.read_games(spark, path), year_range=(1995, 1995), events=["Rapid"]).filter("month = 3").select("game_id")
    text = plan(own)
    assert "PartitionFilters: [isnotnull(year" in text and "EqualTo(month,3)" in text and "movetext" not in text


def test_overwriting_replaces_only_the_partitions_written(spark):
    path = scratch_dir(spark)
    first = spark.createDataFrame([(1, 1, "a", 10), (2, 1, "a", 20)], "year int, month int, event string, x int")
    tables.write_partitioned(first, path)
    tables.write_partitioned(first.filter("year = 2").withColumn("x", F.lit(21)), path)
    assert sorted((r["year"], r["x"]) for r in tables.read_games(spark, path).collect()) == [(1, 10), (2, 21)]


def test_large_partitions_get_several_files(spark):
    path = scratch_dir(spark)
    many = spark.range(1000).select(F.lit(1).alias("year"), F.lit(1).alias("month"), F.when(F.col("id") < 990, "a").alias("event"), F.col("id").alias("x"))
    tables.write_partitioned(many, path, max_rows=100)
    files = tables.read_games(spark, path).groupBy("event", F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in files) == 1000 and max(r["n"] for r in files) <= 100


def test_resume(spark, games):
    catalog = tables.partition_catalog(games)
    assert tables.pending_partitions(catalog, catalog).count() == 0
    assert tables.pending_partitions(catalog, catalog, overwrite=True).count() == catalog.count()


def test_a_prefix_is_the_sum_of_what_follows_and_what_ends_there(tree):
    keys = explorer.SLICE
    after = tree.groupBy(*keys, F.col("parent_prefix").alias("prefix")).agg(F.sum("total_games").alias("after"))
    both = tree.join(after, [*keys, "prefix"])
    assert both.filter("after > total_games").count() == 0 and both.count() > 0
    assert tree.filter("white_wins + draws + black_wins <> total_games").count() == 0
    shares = tree.filter("ply = 1").groupBy(*keys).agg(F.sum("move_share").alias("s")).filter("s > 1.0001")
    assert shares.count() == 0


def test_wide_and_long_roll_up_agree(games, tree):
    rolled = explorer.rollup_lines(explorer.cut_lines(explorer.explorer_lines(games), 10), 10)
    wide = {tuple(r) for r in rolled.filter("W2 is not null").select(*explorer.SLICE, F.concat_ws(" ", "W1", "B1", "W2"), "w2_total_games").collect()}
    long = {tuple(r) for r in tree.filter("ply = 3").select(*explorer.SLICE, "prefix", "total_games").collect()}
    assert wide == long and wide


def test_merging_states_never_adds_positions(games):
    count = lambda key: {r["ply"]: r["positions"] for r in edges.ply_convergence(edges.position_edges(games, key=key)).collect()}
    moveset, path = count("moveset"), count("path")
    assert all(moveset[p] <= path[p] for p in path) and any(moveset[p] < path[p] for p in path)


def test_approximate_convergence(games):
    assert edges.ply_convergence(edges.position_edges(games), exact=False).filter("positions <= 0").count() == 0


def test_null_scores_count_in_total_only(spark):
    rows = [("g", 1, 7, "||w", 8, "e4", s, 1500, 1500.0, 2000, 1, "Rapid") for s in (1.0, 0.5, None)]
    e = spark.createDataFrame(rows, "game_id string, ply int, parent_key long, parent_state string, child_key long, move_san string, white_score double, elo_band int, mean_elo double, year int, month int, event string")
    r = stats.position_stats(e, 1).first()
    assert (r["white_wins"], r["draws"], r["black_wins"], r["total"], r["white_score_avg"]) == (1, 1, 0, 3, 0.5)


def graph(spark, rows):
    return spark.createDataFrame([("E", 1, *r) for r in rows], "event string, elo_band int, parent_key long, child_key long, move_san string, side string, ply int, total long, white_score_avg double, parent_state string")


def test_induction_by_hand(spark):
    # 1 (White) -> 2 (Black) -> leaves 4, 5; 1 -> 3, a leaf
    g = graph(spark, [(1, 2, "a", "w", 1, 10, 0.5, "s1"), (1, 3, "b", "w", 1, 10, 0.4, "s1"), (2, 4, "x", "b", 2, 6, 0.9, "s2"), (2, 5, "y", "b", 2, 2, 0.1, "s2")])
    priors = spark.createDataFrame([("E", 1, 0.5)], "event string, elo_band int, prior double")
    for levels in (True, False):
        white = {r["parent_key"]: r for r in induction.backward_induction(g, priors, "white", prior_strength=0, levels=levels).collect()}
        assert white[2]["value"] == pytest.approx((0.9 * 6 + 0.1 * 2) / 8) and white[2]["best_move"] is None
        assert (white[1]["best_move"], white[1]["value"]) == ("a", white[2]["value"])
        assert white[1]["forcingness"] == pytest.approx((6 / 8) ** 2 + (2 / 8) ** 2)
        black = {r["parent_key"]: r for r in induction.backward_induction(g, priors, "black", prior_strength=0, levels=levels).collect()}
        assert (black[2]["best_move"], black[2]["value"]) == ("y", 0.1)
    with pytest.raises(ValueError):
        induction.backward_induction(g, priors, "both")


def test_chain_returns_its_leaf_and_ties_go_by_move(spark):
    g = graph(spark, [(1, 2, "m", "w", 1, 5, 0.2, "s1"), (2, 3, "n", "b", 2, 5, 0.7, "s2"), (2, 4, "k", "b", 2, 5, 0.7, "s2")])
    priors = spark.createDataFrame([("E", 1, 0.5)], "event string, elo_band int, prior double")
    black = {r["parent_key"]: r for r in induction.backward_induction(g, priors, "black", prior_strength=0).collect()}
    assert black[1]["value"] == pytest.approx(0.7) and black[2]["best_move"] == "k"


def test_long_chains_are_followed_to_their_end(spark):
    n = 14
    g = graph(spark, [(k, k + 1, "m", "w", k, 5, 0.9 if k == n else 0.1, f"s{k}") for k in range(1, n + 1)])
    priors = spark.createDataFrame([("E", 1, 0.5)], "event string, elo_band int, prior double")
    for levels in (True, False):
        rows = induction.backward_induction(g, priors, "white", prior_strength=0, levels=levels).collect()
        assert {r["parent_key"]: r["value"] for r in rows} == {k: pytest.approx(0.9) for k in range(1, n + 1)}


def test_values_and_best_moves_belong_to_the_graph(spark):
    rep, own = queries._repertoire(spark, SF)
    assert rep.filter("value < 0 or value > 1").count() == 0
    best = rep.filter("best_move is not null")
    assert best.join(own, (best.parent_key == own.parent_key) & (best.event == own.event) & (best.elo_band == own.elo_band) & (best.best_move == own.move_san), "left_anti").count() == 0


def test_priors_fall_back(spark):
    rows = queries._stats(spark, SF)
    assert {r["prior"] for r in induction.slice_priors(rows, min_games=10**9).collect()} == {0.5}


def test_cache_upsert_and_pending(spark):
    schema = "state string, depth long, cp long, engine_best_uci string, evaluated_at timestamp"
    old = spark.createDataFrame([("a", 10, 5, None, None), ("b", 20, 6, None, None)], schema)
    new = spark.createDataFrame([("a", 12, 7, "x", None), ("b", 15, 8, "y", None), ("c", 1, 1, None, None)], schema)
    merged = {r["state"]: r["cp"] for r in safety.merge_evals(old, new).collect()}
    assert merged == {"a": 7, "b": 6, "c": 1}
    states = spark.createDataFrame([("a",), ("b",), ("z",)], "state string")
    assert {r[0] for r in safety.pending_evals(states, old, 18).collect()} == {"a", "z"}


def test_annotation_has_three_values_and_works_with_an_empty_cache(spark):
    rep = queries._repertoire(spark, SF)[0]
    empty = spark.createDataFrame([], "state string, depth long, cp long, engine_best_uci string, evaluated_at timestamp")
    out = safety.annotate(rep, empty, "white")
    assert out.count() == rep.count() and out.filter("is_safe is not null").count() == 0
    assert safety.safety_summary(out).first()["safe_pct"] is None


def test_long_books_are_joined(spark, games, monkeypatch):
    own = explorer.with_moves(games)
    count = lambda: sorted(map(tuple, clean.in_opening_set(own, fixtures.book(spark)).groupBy("in_set").count().collect()))
    short = count()
    monkeypatch.setattr(clean, "MAX_BOOK", 2)
    assert count() == short


@pytest.mark.parametrize("limit", [1_000, 0])
def test_books_have_lines_of_any_length(spark, monkeypatch, limit):
    monkeypatch.setattr(clean, "MAX_BOOK", limit)
    line = "e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7 Re1".split()
    own = spark.createDataFrame([("long", line + ["b5"]), ("short", line[:9]), ("other", ["d4"]), ("none", [])], "game_id string, moves array<string>")
    for n, want in ((9, {"long", "short"}), (11, {"long"})):
        book = spark.createDataFrame([(line[:n],), ([],)], "line array<string>")
        assert {r["game_id"] for r in clean.in_opening_set(own, book).filter("in_set").collect()} == want
    assert clean.in_opening_set(own, book.limit(0)).filter("in_set").count() == 0


def test_means_do_not_depend_on_order(spark):
    rows = [(k, v) for k, v in enumerate([0.1, 1e-6, 599.999999, -600.0, None, 0.000001, 3.25] * 40)]
    d = spark.createDataFrame(rows, "k long, v double")
    one = d.repartition(1).agg(evals.exact_mean(F.col("v")).alias("m")).first()["m"]
    for n in (2, 7, 13):
        assert d.repartition(n, "k").agg(evals.exact_mean(F.col("v")).alias("m")).first()["m"] == one
    halves = spark.createDataFrame([(0.000001,), (0.0,), (None,)], "v double")
    assert halves.agg(evals.exact_mean(F.col("v")), evals.exact_mean(-F.col("v"))).first() == (0.000001, -0.000001)
    assert halves.filter("v is null").agg(evals.exact_mean(F.col("v"))).first()[0] is None


def test_merged_line_evals_have_one_row_for_each_line(games):
    merged = evals.line_evals(games, 3, merge=True)
    assert merged.count() == merged.select("line_text").distinct().count()
    assert evals.line_evals(games, 3).agg(F.sum("total_games")).first()[0] == merged.agg(F.sum("total_games")).first()[0]


def test_pipeline_takes_all_games(spark):
    import inspect

    from movelines.plans.pipeline import build_repertoire

    assert inspect.signature(build_repertoire).parameters["games_per_partition"].default is None


def test_pipeline_writes_and_reads_its_stages(spark):
    from movelines.plans.pipeline import build_repertoire

    out = scratch_dir(spark)
    rep = build_repertoire(fixtures.raw_games(spark, SF), "white", year_range=(1994, 1996), min_games=1, max_ply=4, out=out)
    keys = [(r["event"], r["elo_band"], r["parent_key"]) for r in rep.collect()]
    assert keys == sorted(keys) and len(keys) == len(set(keys))
    assert rep.count() > 0 and tables.read_stats(spark, f"{out}/stats").filter("total < 1").count() == 0
