"""Induction over any graph, lines by jumps, states written move by move, totals of prefixes."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from movelines.functions import moves as m
from movelines.operators import edges, explorer, induction
from movelines.plans import fixtures
from movelines.plans.pipeline import build_repertoire
from movelines.sources import scratch, tables

SCHEMA = "event string, elo_band int, parent_key long, child_key long, move_san string, side string, ply int, total long, white_score_avg double, parent_state string"


def graph(spark, rows):
    return spark.createDataFrame([("E", 1, *r) for r in rows], SCHEMA)


def priors(spark):
    return spark.createDataFrame([("E", 1, 0.5)], "event string, elo_band int, prior double")


def induce(spark, rows, perspective="white", **options):
    return {r["parent_key"]: r for r in induction.backward_induction(graph(spark, rows), priors(spark), perspective, prior_strength=0, **options).collect()}


def test_positions_at_several_depths(spark):
    # s -> X -> Z -> W and s -> Z, whose edges count from their smallest ply
    s, x, z, w = 1, 2, 3, 4
    rows = [(s, x, "x", "w", 1, 10, 0.1, "s"), (s, z, "z", "w", 1, 10, 0.2, "s"), (x, z, "y", "b", 2, 10, 0.1, "x"), (z, w, "v", "w", 2, 10, 0.9, "z")]
    got = induce(spark, rows)
    assert {k: r["value"] for k, r in got.items()} == {s: 0.9, x: 0.9, z: 0.9} and got[s]["best_move"] == "x"
    with pytest.raises(ValueError):
        induce(spark, rows, levels=True)
    # one position with edges at two plies, itself nobody's child
    two = [(1, 2, "a", "w", 1, 5, 0.3, "s"), (1, 3, "b", "w", 3, 5, 0.8, "s"), (2, 9, "c", "b", 2, 5, 0.4, "t")]
    assert induce(spark, two)[1]["value"] == 0.8
    with pytest.raises(ValueError):
        induce(spark, two, levels=True)


def by_hand(rows, perspective, weight=0.0):
    """Positions in the order of their children, what is left from the values so far."""
    out, side, children = defaultdict(list), {}, defaultdict(set)
    for p, c, move, s, _, n, avg, _ in rows:
        out[p].append((c, move, n, avg))
        side[p] = s
    for p in out:
        children[p] = {c for c, *_ in out[p] if c in out}
    force = lambda k: sum(n * n for *_, n, _ in out[k]) / sum(n for *_, n, _ in out[k]) ** 2 if k in out else 0.0
    values = {}

    def value(p, known):
        of = lambda c, avg: known.get(c, avg)
        if side[p] == perspective[0]:
            sign = 1 if perspective == "white" else -1
            return min((-round(sign * of(c, avg) + weight * force(c), 9), move, of(c, avg)) for c, move, n, avg in out[p])[1:]
        return None, sum(of(c, avg) * n for c, _, n, avg in out[p]) / sum(n for *_, n, _ in out[p])

    while ready := [p for p in out if p not in values and children[p] <= values.keys()]:
        values |= {p: value(p, {k: v[1] for k, v in values.items()}) for p in ready}
    known = {k: v[1] for k, v in values.items()}
    return values | {p: value(p, known) for p in out if p not in values}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    rows, names = [], "abcd"
    for p in range(1, 26):
        for k in range(rnd.randint(1, 3)):
            # mostly forwards, some backwards: cycles
            c = p + rnd.randint(1, 6) if rnd.random() < 0.9 - 0.1 * seed else max(1, p - rnd.randint(0, 5))
            rows.append((p, c, names[k], "wb"[p % 2], rnd.randint(1, 9), rnd.randint(1, 20), rnd.randint(0, 10) / 10, f"s{p}"))
    for perspective in ("white", "black"):
        want = by_hand(rows, perspective, 0.1)
        got = induce(spark, rows, perspective, forcing_weight=0.1)
        assert got.keys() == want.keys()
        for p, (move, v) in want.items():
            assert got[p]["best_move"] == move and got[p]["value"] == pytest.approx(v)


def test_an_empty_graph_has_no_values(spark):
    assert induce(spark, []) == {} and induce(spark, [], levels=False) == {}


@pytest.mark.parametrize("depth", [0, 1, 5, 12])
def test_lines_by_jumps(spark, monkeypatch, depth):
    n = 9
    rows = [(k, k + 1, f"m{k}", "wb"[(k + 1) % 2], k, 5, 0.5, f"s{k}") for k in range(1, n + 1)]
    own = graph(spark, rows).withColumn("parent_key", F.when(F.col("parent_key") == 1, m.key64(F.lit("go"))).otherwise(F.col("parent_key")))
    rep = own.select(*induction.NODE, "side", F.when(F.col("side") == "w", F.col("move_san")).alias("best_move"))
    joins = []
    real = induction._further
    monkeypatch.setattr(induction, "_further", lambda a, b: joins.append(1) or real(a, b))
    r = induction.best_lines(rep, own, depth, "go").first()
    plies = min(depth, n)
    words = [f"{k // 2 + 1}. m{k + 1}" if k % 2 == 0 else f"m{k + 1}" for k in range(plies)]
    assert (r["line"], r["plies"]) == (" ".join(words), plies)
    assert len(joins) <= 5


def test_states_written_move_by_move(spark):
    rnd = random.Random(4)
    games = [[rnd.choice(["e4", "d4", "Nf3", "a3", "O-O"]) for _ in range(n)] for n in (0, 1, 2, 3, 8, 31)]
    d = spark.createDataFrame([(g,) for g in games], "moves array<string>").withColumn("n", F.size("moves"))
    for key in ("moveset", "path"):
        one = F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda p: m.state_text(F.col("moves"), p, key))
        assert d.filter(m.state_texts(F.col("moves"), F.col("n"), key) != one).count() == 0
        cut = m.state_texts(F.col("moves"), F.least(F.col("n"), F.lit(2)), key)
        assert d.filter(cut != F.slice(one, 1, 3)).count() == 0
    with pytest.raises(ValueError):
        m.state_texts(F.col("moves"), F.col("n"), "board")


def test_prefix_totals_over_many_ranges(spark, monkeypatch):
    rnd = random.Random(5)
    # one slice and one opening hold most rows; nulls end lines; rows repeat
    lines = [(rnd.choice([1, 1, 1, 2]), *[rnd.choice(["a", "a", "a", "b", None]) for _ in range(4)], rnd.randint(0, 3), 1) for _ in range(600)]
    d = spark.createDataFrame(lines, "s int, c1 string, c2 string, c3 string, c4 string, wins long, games long")
    plans = []
    real = explorer.materialise
    monkeypatch.setattr(explorer, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    for size in (40, 10_000):
        plans.clear()
        got = explorer.prefix_totals(d, ["s"], ["c1", "c2", "c3", "c4"], ["wins", "games"], range_rows=size).collect()
        assert sum(p.count("Sort [") for p in plans) == 1
        wins, games, first = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in lines:
            for k in range(5):
                wins[r[: k + 1]] += r[5]
                games[r[: k + 1]] += 1
        assert len(got) == len(lines)
        for r in got:
            for k in range(5):
                key = tuple(r)[: k + 1]
                assert (r["_totals"][k]["wins"], r["_totals"][k]["games"]) == (wins[key], games[key])
                first[key] += r["_new"] <= k
        assert set(first.values()) == {1} and first.keys() == games.keys()
    assert explorer.prefix_totals(d.limit(0), ["s"], ["c1"], ["wins"]).count() == 0


def test_supplied_states_go_through_the_chain(spark):
    raw = fixtures.raw_games(spark, "/root/testdata/sf0.001").withColumn("states", fixtures.weighed_states(m.san_moves(F.col("movetext"))))
    with pytest.raises(ValueError):
        build_repertoire(raw, "white", key="supplied")
    rep = build_repertoire(raw, "white", min_games=2, key="supplied", start=fixtures.WEIGHED_START)
    assert rep.filter("parent_state = '0|0|w' and best_move is not null").count() > 0
    assert rep.filter("side <> right(parent_state, 1)").count() == 0


def test_the_sink_reads_its_input_once(spark):
    path = scratch.scratch_dir(spark)
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(2_000, numPartitions=4).select(F.lit(1).alias("year"), F.lit(1).alias("month"), F.when(F.col("id") < 1_900, "a").otherwise("b").alias("event"), F.col("id").alias("x"))

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tables.write_partitioned(rows.mapInArrow(count, rows.schema), path, max_rows=500)
    assert seen.value == 2_000
    files = tables.read_games(spark, path).groupBy("event", F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in files) <= 500 and sum(r["count"] for r in files) == 2_000


def test_slices(spark):
    d = spark.createDataFrame([(2000, 6, "Rapid", 1500, "1400_1600"), (2000, 7, "Rapid", 1500, "1400_1600"), (2001, 6, "Blitz", 2300, "2200_2500")], "year int, month int, event string, elo_band int, rating_class string")
    pick = lambda **k: tables.select_partitions(d, **k).count()
    assert (pick(month=6), pick(elo_band=1500), pick(rating_class="2200_2500"), pick(month=6, elo_band=1500), pick(month=7, rating_class="2200_2500")) == (2, 2, 1, 1, 0)


def walk_by_hand(rows, best, perspective, least, depth):
    side = {r[0]: r[3] for r in rows}
    found, frontier = {0 + 1: 0}, [1]
    for d in range(1, depth + 1):
        after = set()
        for p in frontier:
            for q, c, move, s, _, n, *_ in rows:
                if q == p and c in side and (move == best.get(p) if s == perspective[0] else n >= least):
                    after.add(c)
        frontier = [c for c in after if c not in found]
        found |= {c: d for c in frontier}
    return found


@pytest.mark.parametrize("levelled", [True, False])
def test_the_walk(spark, levelled):
    from movelines.operators import safety

    rnd = random.Random(8)
    rows = []
    for level in range(1, 7):
        for p in range(1 if level == 1 else level * 10, 2 if level == 1 else level * 10 + 4):
            for k in range(3):
                c = (level + 1) * 10 + rnd.randint(0, 4)
                if not levelled and rnd.random() < 0.3:  # further down, or back
                    c = rnd.choice([(level + 2) * 10 + rnd.randint(0, 3), 20 + rnd.randint(0, 3)])
                rows.append((p, c, "abc"[k], "wb"[(level + 1) % 2], level, rnd.randint(1, 9), 0.5, f"s{p}"))
    keys = {1: m.key64(F.lit("go"))}
    own = graph(spark, rows)
    for c in ("parent_key", "child_key"):
        own = own.withColumn(c, F.when(F.col(c) == 1, keys[1]).otherwise(F.col(c)))
    rep = own.groupBy(*induction.NODE, "parent_state", "side").agg(F.min("move_san").alias("best_move"))
    best = {r[0]: "a" for r in rows}
    got = {int(r["parent_state"][1:]): r["depth"] for r in safety.reachable(rep, own, "white", 2, 5, "go").collect()}
    assert got == walk_by_hand(rows, best, "white", 2, 5) and max(got.values()) >= 2


def test_scratch_can_be_cleared(spark):
    path = scratch.scratch_dir(spark)
    spark.range(3).write.parquet(path)
    assert scratch.clear_scratch(spark) >= 1 and scratch.clear_scratch(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path)
