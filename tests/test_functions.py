"""Column functions on literal frames, with the edge cases of their inputs."""

import pytest
from pyspark.sql import functions as F

from movelines.functions import games as g
from movelines.functions import moves as m


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("text,base,inc", [("180+2", 180, 2), ("-", None, None), ("180", None, None), (None, None, None), ("+2", None, None), ("99999999999+1", None, 1)])
def test_time_control(spark, text, base, inc):
    assert one(spark, g.time_control(F.col("t"), 1), t=text) == base
    assert one(spark, g.time_control(F.col("t"), 2), t=text) == inc


@pytest.mark.parametrize("w,b,mean", [(1500, 1501, 1500), (1501, 1502, 1502), (1500, 1500, 1500)])
def test_half_way_means_go_to_the_even_neighbour(spark, w, b, mean):
    assert one(spark, g.mean_elo(F.col("w"), F.col("b")), w=w, b=b) == mean


def test_missing_rating(spark):
    assert one(spark, g.mean_elo(F.col("w").cast("int"), F.lit(1500)), w=None) is None


@pytest.mark.parametrize("band,label", [(0, "under_1000"), (999, "under_1000"), (1000, "1000_1200"), (2499, "2200_2500"), (2500, "over_2500")])
def test_rating_class(spark, band, label):
    assert one(spark, g.rating_class(F.col("b")), b=band) == label


def test_rating_class_of_null(spark):
    assert one(spark, g.rating_class(F.col("b").cast("int")), b=None) is None


@pytest.mark.parametrize("result,score,label", [("1-0", 1.0, "white_wins"), ("0-1", 0.0, "black_wins"), ("1/2-1/2", 0.5, "draws"), ("*", None, None), (None, None, None)])
def test_results(spark, result, score, label):
    assert one(spark, g.white_score(F.col("r")), r=result) == score
    assert one(spark, g.result_label(F.col("r")), r=result) == label


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []),
        ("", []),
        ("1-0", []),
        ("1. e4 { [%eval 0.1] } 1... e5 2. Nf3 1-0", ["e4", "e5", "Nf3"]),
        ("1. e4?! $1 (1. b3 e5) e5!! 2. Nh5??  *", ["e4", "e5", "Nh5"]),
        ("1. e4 { a (b) } e5 1/2-1/2", ["e4", "e5"]),
    ],
)
def test_san_moves(spark, text, want):
    assert one(spark, m.san_moves(F.col("t")), t=text) == want
    assert one(spark, m.san_moves(F.col("t"), "inline"), t=text) == want


def test_numbers_glued_to_moves(spark):
    assert one(spark, m.san_moves(F.col("t"), "inline"), t="1.e4 1...e5") == ["e4", "e5"]
    assert one(spark, m.san_moves(F.col("t"), "inline", False), t="1. e4 1-0") == ["e4", "1-0"]


def test_valid_length(spark):
    assert one(spark, m.valid_length(F.col("x")), x=["e4", "e5", "Zz9", "Nf3"]) == 2
    assert one(spark, m.valid_length(F.col("x")), x=["O-O", "exd8=Q+", "Nbd7", "R1xa3#"]) == 4


@pytest.mark.parametrize("text,want", [("0.36", 0.36), ("-152.65", -152.65), ("#0", 600.0), ("#-0", -600.0), ("#1", 500.0), ("#3", 300.0), ("#4", 200.0), ("#9", 200.0), ("#-2", -400.0), ("x", None), (None, None), ("#", None)])
def test_eval_value(spark, text, want):
    assert one(spark, m.eval_value(F.col("e")), e=text) == want


def test_mates_carry_no_evaluation(spark):
    white = "1. e4 { [%eval 0.1] } 1... e5 { [%eval 0.2] } 2. Qxf7# 1-0"
    black = "1. e4 { [%eval 0.1] } 1... Qxf2# 0-1"
    for text, last in ((white, "#0"), (black, "#-0")):
        assert one(spark, m.game_evals(F.col("t"), m.san_moves(F.col("t"))), t=text)[-1] == last
    assert one(spark, m.game_evals(F.col("t"), m.san_moves(F.col("t"))), t="1. e4 {} 1... e5 { [%eval 0.2] }") == [None, "0.2"]


def test_state_keys(spark):
    a, b = ["e4", "e5", "d4"], ["d4", "e5", "e4"]
    state = lambda key: m.state_text(F.col("x"), F.lit(4), key)
    assert one(spark, state("moveset"), x=a) == one(spark, state("moveset"), x=b) == "d4 e4|e5|b"
    assert one(spark, state("path"), x=a) == "e4 e5 d4"
    assert one(spark, m.state_text(F.col("x"), F.lit(1)), x=a) == "||w"
    assert one(spark, m.key64(F.lit("||w")), x=a) > 0
    with pytest.raises(ValueError):
        m.state_text(F.col("x"), F.lit(1), "other")


def test_prefixes_and_cuts(spark):
    assert one(spark, m.running_prefix(F.col("x")), x=["e4", "e5"]) == ["e4", "e4 e5"]
    assert one(spark, m.running_prefix(F.col("x")), x=[]) == []
    assert one(spark, m.truncate_moves(F.col("x"), 2), x=["e4", "e5", "d4"]) == ["e4", "e5"]
    assert one(spark, m.strip_clocks(F.col("t")), t="e4 [%clk 0:03:00] e5") == "e4e5"
    assert [one(spark, c, x=["e4"]) for c in m.wide_moves(F.col("x"), 1)] == ["e4", None]
