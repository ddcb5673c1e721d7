"""Column functions over game records: labels, ratings, time controls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rated event kinds that are kept, and their labels.
EVENTS = {
    "Rated UltraBullet game": "UltraBullet",
    "Rated Correspondence game": "Correspondence",
    "Rated Classical game": "Classical",
    "Rated Rapid game": "Rapid",
    "Rated Bullet game": "Bullet",
    "Rated Blitz game": "Blitz",
}
SLOW_EVENTS = ("Blitz", "Rapid", "Classical", "Correspondence")
SITE_PREFIX = "https://lichess.org/"

# Left-closed rating classes, as (upper bound, label); the last is open.
RATING_CLASSES = [
    (1000, "under_1000"),
    (1200, "1000_1200"),
    (1400, "1200_1400"),
    (1600, "1400_1600"),
    (1800, "1600_1800"),
    (2000, "1800_2000"),
    (2200, "2000_2200"),
    (2500, "2200_2500"),
]
TOP_CLASS = "over_2500"


def event_label(event: Column) -> Column:
    """The kept event's label; null for any other."""
    return F.coalesce(*[F.when(event == name, F.lit(label)) for name, label in EVENTS.items()])


def white_score(result: Column) -> Column:
    return F.when(result == "1-0", F.lit(1.0)).when(result == "0-1", F.lit(0.0)).when(result == "1/2-1/2", F.lit(0.5))


def result_label(result: Column) -> Column:
    return F.when(result == "1-0", "white_wins").when(result == "0-1", "black_wins").when(result == "1/2-1/2", "draws")


def mean_elo(white: Column, black: Column) -> Column:
    """Half-way means go to the even neighbour."""
    return F.bround((white.cast("double") + black.cast("double")) / 2, 0).cast("int")


def elo_band(mean: Column) -> Column:
    return (F.floor(mean / 100) * 100).cast("int")


def rating_class(band: Column) -> Column:
    out = F.when(band.isNull(), F.lit(None).cast("string"))
    for bound, label in RATING_CLASSES:
        out = out.when(band < bound, label)
    return out.otherwise(TOP_CLASS)


def time_control(text: Column, part: int) -> Column:
    """Part 1 is the base time, 2 the increment, of `base+increment`; null for any other text."""
    return F.regexp_extract(text, r"^(\d+)\+(\d+)$", part).try_cast("int")
