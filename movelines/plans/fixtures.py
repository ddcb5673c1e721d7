"""Game records derived from the order tables, and the other inputs of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
EVENT_NAMES = ["Rated UltraBullet game", "Rated Correspondence game", "Rated Classical game", "Rated Rapid game", "Rated Bullet game", "Rated Blitz game", "Casual Rapid game"]
WHITE_MOVES = ["e4", "d4", "Nf3", "c4"]
BLACK_MOVES = ["e5", "d5", "Nf6", "c5"]
OPENINGS = ["Sicilian Defense: Najdorf Variation", "Italian Game", "Queen's Gambit: Declined: Exchange"]
TIME_CONTROLS = ["180+2", "600+0", "-", "60+0", "900+10"]
BOOK = ["e4 e5", "e4 c5 Nf3", "d4 d5", "d4 Nf6 c4", "Nf3"]
OTHER_BOOK = ["e4 d5", "c4 c5"]
PLY_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per order, one ply per line item. Numbers and texts of an order's plies come from one
    exchange and one sort by order, which the join with the orders uses too: the texts grow with the tables, so an
    estimate of their size must not broadcast them."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *PLY_ORDER)
    w = Window.partitionBy("l_orderkey").orderBy(*PLY_ORDER)
    items = items.withColumn("ply", F.row_number().over(w))
    k, p, q = F.col("l_orderkey"), F.col("ply"), F.floor("l_quantity").cast("int")
    white = p % 2 == 1
    number = F.when(white, F.concat(F.floor((p + 1) / 2).cast("string"), F.lit(". "))).otherwise(F.concat(F.floor(p / 2).cast("string"), F.lit("... ")))
    move = F.when((k % 97 == 0) & (p == 3), "Zz9").when(white, _pick(WHITE_MOVES, F.col("l_partkey") % 4)).otherwise(_pick(BLACK_MOVES, F.col("l_partkey") % 4))
    suffix = F.when(F.col("l_linenumber") == 7, "?!").otherwise("")
    extra = F.when((p == 1) & (k % 31 == 0), " $1 (1. b3)").otherwise("")
    score = F.when(q > 40, F.concat(F.lit("#"), (q - 45).cast("string"))).otherwise(F.concat((q - 24).cast("string"), F.lit(".25")))
    comment = F.when(k % 3 == 0, F.concat(F.lit(" { [%eval "), score, F.lit("] }"))).otherwise(" { [%clk 0:03:00] }")
    text = F.concat(number, move, suffix, extra, comment)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = items.withColumn("t", text).withColumn("texts", F.collect_list("t").over(whole)).filter("ply = 1")
    lines = lines.select("l_orderkey", F.array_join("texts", " ").alias("body"))

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    result = F.when(k % 50 == 49, "*").when(status == "O", "1-0").when(status == "F", "0-1").when(status == "P", "1/2-1/2")
    return o.select(
        F.concat(F.lit("https://lichess.org/"), k.cast("string")).alias("Site"),
        _pick(EVENT_NAMES, k % 7).alias("Event"),
        F.concat(F.lit("c"), c.cast("string")).alias("White"),
        F.concat(F.lit("c"), (c * 7 % 1500).cast("string")).alias("Black"),
        result.alias("Result"),
        F.when(c % 40 == 0, "GM").alias("WhiteTitle"),
        F.lit(None).cast("string").alias("BlackTitle"),
        F.when(k % 23 != 0, (800 + c * 37 % 1900).cast("string")).alias("WhiteElo"),
        (800 + (c * 37 + k) % 1900).cast("string").alias("BlackElo"),
        (k % 17 - 8).cast("int").alias("WhiteRatingDiff"),
        (8 - k % 17).cast("int").alias("BlackRatingDiff"),
        F.to_date("o_orderdate").alias("UTCDate"),
        F.lit("12:00:00").alias("UTCTime"),
        F.concat(_pick(list("ABCDE"), k % 5), F.lpad((c % 100).cast("string"), 2, "0")).alias("ECO"),
        _pick(OPENINGS, k % 3).alias("Opening"),
        F.when(k % 4 == 0, "Time forfeit").otherwise("Normal").alias("Termination"),
        _pick(TIME_CONTROLS, k % 5).alias("TimeControl"),
        F.when(F.col("body").isNotNull(), F.concat_ws(" ", "body", result)).alias("movetext"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    )


def weighed_states(moves: Column) -> Column:
    """States as a user may supply them: what White's and Black's moves so far weigh (c4 and c5 two,
    others one), and the side to move. One state is reached after different numbers of plies, and no
    game comes back to one."""
    own = lambda p, odd: F.aggregate(F.filter(F.slice(moves, F.lit(1), p), lambda _, i: i % 2 == odd), F.lit(0), lambda s, x: s + F.when(x.isin("c4", "c5"), 2).otherwise(1))
    return F.transform(F.sequence(F.lit(0), F.size(moves)), lambda p: F.concat_ws("|", own(p, 0).cast("string"), own(p, 1).cast("string"), F.when(p % 2 == 0, "w").otherwise("b")))


#: The first of them.
WEIGHED_START = "0|0|w"


def book(spark: SparkSession, lines=BOOK) -> DataFrame:
    return spark.createDataFrame([(x.split(" "),) for x in lines], "line array<string>")


def event_graph(spark: SparkSession, sf_dir: str, ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """A cyclic graph: one user's consecutive events of a day are edges between event types. The
    slice is the day of the week. With `ends`, a day also leads from `start` to its first event and
    from its last one to `end` and `close`: a tail before the cycles and one after them. Returns
    (edges, priors)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    types = events.select("event_type").distinct()
    # a handful of event types; alternating sides in their order
    place = types.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("event_type")))
    steps = events.select("event_type", "value", F.date_format("ts", "E").alias("day"), F.lead("event_type").over(w).alias("child"))
    middle = events.agg(F.avg("value")).first()[0]
    if ends:
        first = events.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.lit("start").alias("event_type"), "value", F.date_format("ts", "E").alias("day"), F.col("event_type").alias("child"))
        last = steps.filter("child is null")
        close = last.select(F.lit("end").alias("event_type"), "value", "day", F.lit("close").alias("child"))
        steps = steps.fillna("end", ["child"]).unionByName(first).unionByName(close)
        place = place.unionByName(spark.createDataFrame([("start", 1), ("end", 2)], "event_type string, n int"))
    steps = steps.filter("child is not null").withColumn("score", F.when(F.col("value") > middle, 1.0).otherwise(0.0))
    own = steps.groupBy(F.col("day").alias("event"), F.lit(0).alias("elo_band"), "event_type", "child").agg(F.count("*").alias("total"), F.sum("score").alias("s"))
    own = own.join(place, "event_type").withColumn("side", F.when(F.col("n") % 2 == 1, "w").otherwise("b"))
    edges = own.select(
        "event", "elo_band", F.col("event_type").alias("parent_key"), F.col("child").alias("child_key"), F.col("child").alias("move_san"), "side", F.lit(1).alias("ply"), "total", (F.col("s") / F.col("total")).alias("white_score_avg"), F.col("event_type").alias("parent_state")
    )
    return edges, edges.select("event", "elo_band").distinct().withColumn("prior", F.lit(0.5))


def second_batch(cache: DataFrame) -> DataFrame:
    """Deeper evaluations of about a third of the states, and of the start position."""
    deeper = cache.filter(F.length("state") % 3 == 0).select("state", (F.col("depth") + 7).alias("depth"), (F.col("cp") - 120).alias("cp"), F.lit("e2e4").alias("engine_best_uci"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("evaluated_at"))
    start = cache.agg(F.lit("||w").alias("state"), F.lit(20).cast("bigint").alias("depth"), F.lit(-150).cast("bigint").alias("cp"), F.lit("d2d4").alias("engine_best_uci"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("evaluated_at"))
    return deeper.union(start)
