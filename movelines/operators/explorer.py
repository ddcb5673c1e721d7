"""Counts of games by exact line and by every prefix of a line.

Prefix totals come from one sort by slice and line: rows that share a prefix then stand together.
The rows are dealt by ranges of that order, so a range holds a bounded number of rows whatever the
slice or opening, each range is sorted once, and one pass over it gives the totals of every prefix
within the range. A prefix that runs on into the next range
is made whole from the first and last row of each range. The wide form keeps the totals on each
line's row; the long form takes each prefix from the first row that has it, so no row is sent once
for each of its prefixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import games as g
from ..functions import moves as m
from ..sources.scratch import materialise, workers_ready

SLICE = ["year", "month", "event", "rating_class"]
COUNTS = ["white_wins", "draws", "black_wins", "total_games"]


def with_moves(games: DataFrame, drop_results: bool = True) -> DataFrame:
    return games.withColumn("moves", m.san_moves(F.col("movetext"), "inline", drop_results))


def _labelled(games: DataFrame, n_moves: int, drop_results: bool) -> DataFrame:
    rows = games.filter(F.col("elo_band").isNotNull() & g.result_label(F.col("result")).isNotNull())
    line = F.slice(m.san_moves(F.col("movetext"), "inline", drop_results), 1, 2 * n_moves)
    return rows.select("year", "month", "event", g.rating_class(F.col("elo_band")).alias("rating_class"), line.alias("line"), g.result_label(F.col("result")).alias("outcome"))


def line_counts(games: DataFrame, n_moves: int = 20, drop_results: bool = True) -> DataFrame:
    """(slice, line array, counts): games with a rating band and a decided or drawn result."""
    n = lambda label: F.count_if(F.col("outcome") == label).alias(label)
    rows = _labelled(games, n_moves, drop_results)
    return rows.groupBy(*SLICE, "line").agg(n("white_wins"), n("draws"), n("black_wins"), F.count("*").alias("total_games"))


def explorer_lines(games: DataFrame, n_moves: int = 20, drop_results: bool = True) -> DataFrame:
    """line_counts with the line as 2 * n_moves columns. Grouped by one array, widened after."""
    counts = line_counts(games, n_moves, drop_results)
    return counts.select(*SLICE, *m.wide_moves(F.col("line"), n_moves), *COUNTS)


def explorer_pivot(games: DataFrame, n_moves: int = 20) -> DataFrame:
    """The same counts by pivot with fixed values, so the columns don't depend on the data."""
    rows = _labelled(games, n_moves, True)
    labels = ["white_wins", "draws", "black_wins"]
    out = rows.groupBy(*SLICE, m.line_key(F.col("line"), F.size("line")).alias("line")).pivot("outcome", labels).count().fillna(0, labels)
    return out.withColumn("total_games", F.col("white_wins") + F.col("draws") + F.col("black_wins"))


def cut_lines(lines: DataFrame, n_moves: int = 10) -> DataFrame:
    """Lines cut to n_moves per side, counts summed; for wide lines."""
    return lines.groupBy(*SLICE, *m.move_columns(n_moves)).agg(*[F.sum(c).alias(c) for c in COUNTS])


def _shared(same_keys: Column, line: Column, other: Column) -> Column:
    """How many leading plies two lines share; -1 where their keys differ."""
    differ = F.array_position(F.zip_with(line, other, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(same_keys, F.when(differ > 0, differ - 1).otherwise(F.size(line))).otherwise(-1).cast("int")


def _one_pass(keys: list[str], columns: list[str], measures: list[str], length: str | None):
    """Over the rows of one range, in order: where each prefix begins, and its sums; _end is 1 on the range's first
    row, 2 on its last, 3 where they are one."""

    def run(batches):
        from pyspark import TaskContext

        batches = list(batches)  # a range: bounded
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        n, width = rows.num_rows, len(columns) + 1
        new = np.full(n, width + 1, np.int32)  # from which length on a row differs from the one before
        for k, names in list(enumerate([keys, *([c] for c in columns)]))[::-1]:
            for name in names:
                codes = rows.column(name).combine_chunks().dictionary_encode("encode").indices.to_numpy()
                new[1:][codes[1:] != codes[:-1]] = k
        new[:1] = 0
        sums = np.empty((len(measures), n, width), np.int64)
        values = [rows.column(c).to_numpy() for c in measures]
        for k in range(width):
            starts = np.flatnonzero(new <= k)
            size = np.diff(np.append(starts, n))
            for i, v in enumerate(values):
                sums[i, :, k] = np.repeat(np.add.reduceat(v, starts), size)
        known = pa.array(new, pa.int32(), mask=np.arange(n) == 0)  # the first row's is known with the range before
        held = np.full(n, width) if length is None else rows.column(length).to_numpy() + 1
        inside = np.arange(width) < held[:, None]
        totals = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.StructArray.from_arrays([pa.array(x[inside]) for x in sums], measures))
        end = np.zeros(n, np.int32)
        end[0] += 1
        end[-1] += 2
        out = rows.append_column("_range", pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32())).append_column("_totals", totals).append_column("_new", known).append_column("_end", pa.array(end))
        yield from out.combine_chunks().to_batches(max_chunksize=4096)

    return run


def prefix_totals(rows: DataFrame, keys: list[str], columns: list[str], measures: list[str], range_rows: int = 50_000, max_ranges: int = 20_000, length: str | None = None) -> DataFrame:
    """Adds `_totals`, an array: for k = 0 to len(columns) the struct of each measure's total over all
    rows with the same keys and the same first k columns (nulls are equal), and `_new`: from which
    length on the row's prefixes differ from those of the row before it in the order of keys and
    columns. Each distinct prefix of length k has exactly one row with _new <= k. Measures are longs
    without nulls, columns are strings. length, if given, names an int column that says how many columns
    the row uses: its array then ends there, so that short rows among many columns stay short.

    Ranges hold about range_rows rows, more only where there would be over max_ranges of them, since
    two rows of each come to the driver. A task holds one range. The windows that could say the same
    take one sort of all rows for each length (or buffer each range once for each)."""
    workers_ready(rows.sparkSession)
    rows = materialise(rows)
    n = rows.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(max_ranges, max(-(-n // range_rows), min(spread, -(-n // 2_000)), 1))
    order = [*keys, *columns]
    dealt = (rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)).sortWithinPartitions(*order)
    sums = ",".join(f"{c}:bigint" for c in measures)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = dealt.mapInArrow(_one_pass(keys, columns, measures, length), f"{schema}, _range int, _totals array<struct<{sums}>>, _new int, _end int")
    return _across(materialise(out), keys, columns, measures)


def _across(out: DataFrame, keys: list[str], columns: list[str], measures: list[str]) -> DataFrame:
    """Totals of prefixes that run over several ranges, from the first and last row of each."""
    width, found = len(columns) + 1, {}
    for r in out.filter("_end > 0").select("_range", "_end", F.struct(*keys).alias("keys"), F.array(*columns).alias("line"), "_totals").collect():
        found.setdefault(r["_range"], {"_range": r["_range"]}).update({name: r for name, bit in (("first", 1), ("last", 2)) if r["_end"] & bit})
    if len(found) < 2:
        return out.withColumn("_new", F.coalesce("_new", F.lit(0))).drop("_range", "_end")
    ends = [found[k] for k in sorted(found)]

    def shared(a, b) -> int:
        if a["keys"] != b["keys"]:
            return -1
        return next((k for k, (x, y) in enumerate(zip(a["line"], b["line"])) if x != y), len(columns))

    def total(row, k: int, i: int) -> int:
        return row["_totals"][k][i] if k < len(row["_totals"]) else 0  # beyond the length that the row uses

    def carried(ends, near: str, far: str) -> list:
        """What ranges on one side add to the runs at the near end of each range, and how many
        leading plies the neighbour shares."""
        found, last = [], None
        for r in ends:
            common = shared(last[far], r[near]) if last else -1
            whole = shared(last["first"], last["last"]) if last else -1
            sums = [[total(last[far], k, i) + (found[-1][0][k][i] if k <= whole else 0) if k <= common else 0 for i in range(len(measures))] for k in range(width)]
            found.append((sums, common))
            last = r
        return found

    before, after = carried(ends, "first", "last"), carried(ends[::-1], "last", "first")[::-1]
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    row_type = f"struct<keys:struct<{','.join(f'{k}:{kinds[k]}' for k in keys)}>,line:array<string>>"
    schema = f"_range int, _first {row_type}, _last {row_type}, _head array<array<bigint>>, _tail array<array<bigint>>, _common int"
    pick = lambda r: (tuple(r["keys"]), r["line"])
    local = [(r["_range"], pick(r["first"]), pick(r["last"]), b[0], a[0], b[1]) for r, b, a in zip(ends, before, after)]
    fixes = out.sparkSession.createDataFrame(local, schema)  # at most max_ranges rows
    own = out.join(F.broadcast(fixes), "_range")
    line, key = F.array(*columns), F.struct(*keys)
    own = own.withColumn("_f", _shared(key.eqNullSafe(F.col("_first.keys")), line, F.col("_first.line"))).withColumn("_l", _shared(key.eqNullSafe(F.col("_last.keys")), line, F.col("_last.line")))
    part = lambda reach, sums, k, i: F.when(reach >= k, F.get(F.get(sums, k), F.lit(i))).otherwise(0)
    mended = F.transform("_totals", lambda t, k: F.struct(*[(t[c] + part(F.col("_f"), F.col("_head"), k, i) + part(F.col("_l"), F.col("_tail"), k, i)).alias(c) for i, c in enumerate(measures)]))
    totals = F.when((F.col("_f") < 0) & (F.col("_l") < 0), F.col("_totals")).otherwise(mended)  # most rows: no prefix in common with the ends
    kept = [c for c in out.columns if c not in ("_range", "_totals", "_new", "_end")]
    return own.select(*kept, totals.alias("_totals"), F.coalesce("_new", F.col("_common") + 1).alias("_new"))


def rollup_lines(lines: DataFrame, n_moves: int = 10, slice_total: str | None = None, **options) -> DataFrame:
    """Adds to each line of cut_lines the four totals of each of its prefixes, as columns named
    w1_... to b<n>_...; a null after the end of a line is a move of its own. With slice_total, a
    column of that name holds the slice's games. For the options see prefix_totals."""
    columns = m.move_columns(n_moves)
    out = prefix_totals(lines, SLICE, columns, COUNTS, **options)
    totals = [F.get("_totals", F.lit(k + 1))[c].alias(f"{name.lower()}_{c}") for k, name in enumerate(columns) for c in COUNTS]
    whole = [F.get("_totals", F.lit(0))["total_games"].alias(slice_total)] if slice_total else []
    return out.select(*[c for c in lines.columns if c not in COUNTS], *totals, *whole)


def move_shares(rolled: DataFrame, n_moves: int = 10, slice_total: str = "slice_games") -> DataFrame:
    """Adds <ply>_move_pct: the prefix's games over those of the prefix one ply shorter, and over the
    slice's for a first move. rolled: from rollup_lines with the same slice_total, which goes."""
    columns = [c.lower() for c in m.move_columns(n_moves)]
    totals = [slice_total, *(f"{c}_total_games" for c in columns)]
    return rolled.select("*", *[(F.col(own) / F.col(before)).alias(f"{c}_move_pct") for c, own, before in zip(columns, totals[1:], totals)]).drop(slice_total)


def line_shares(shared: DataFrame, n_moves: int = 10) -> DataFrame:
    """Adds <ply>_line_pct: the product of that side's own move shares up to the ply."""
    out = shared
    for side in "wb":
        product = None
        for k in range(1, n_moves + 1):
            own = F.col(f"{side}{k}_move_pct")
            product = own if product is None else product * own
            out = out.withColumn(f"{side}{k}_line_pct", product)
    return out


def prefix_tree(counts: DataFrame, n_plies: int = 20, **options) -> DataFrame:
    """One row per slice and prefix: ply, prefix, parent_prefix, move, counts, move_share (of the
    parent's games; of the slice's for a first move) and line_share (product of the own side's
    shares). counts: from line_counts. The empty prefix carries the slice's totals and isn't
    returned. For the options see prefix_totals."""
    columns = [f"_m{k}" for k in range(n_plies)]
    rows = counts.select(*SLICE, *[F.get("line", F.lit(k)).alias(c) for k, c in enumerate(columns)], F.least(F.size("line"), F.lit(n_plies)).alias("_n"), *COUNTS)
    rows = prefix_totals(rows, SLICE, columns, COUNTS, length="_n", **options)
    games = lambda k: F.get("_totals", k)["total_games"]
    rows = rows.select(*SLICE, F.array(*columns).alias("line"), "_totals", "_new", "_n").filter(F.greatest("_new", F.lit(1)) <= F.col("_n"))
    rows = rows.withColumn("shares", F.transform(F.sequence(F.lit(1), F.col("_n")), lambda k: games(k) / games(k - 1)))
    # the products of each side's shares, carried along the line
    step = lambda a, s: F.struct(F.concat(a["done"], F.array(a["other"] * s)).alias("done"), (a["other"] * s).alias("own"), a["own"].alias("other"))
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(1.0).alias("own"), F.lit(1.0).alias("other"))
    rows = rows.withColumn("products", F.aggregate("shares", start, step, lambda a: a["done"]))
    tree = rows.withColumn("ply", F.explode(F.sequence(F.greatest("_new", F.lit(1)), F.col("_n"))))
    at = F.get("_totals", F.col("ply"))
    return tree.select(
        *SLICE,
        "ply",
        m.line_key(F.col("line"), F.col("ply")).alias("prefix"),
        m.line_key(F.col("line"), F.col("ply") - 1).alias("parent_prefix"),
        F.get("line", F.col("ply") - 1).alias("move"),
        *[at[c].alias(c) for c in COUNTS],
        F.round(F.get("shares", F.col("ply") - 1), 6).alias("move_share"),
        F.round(F.get("products", F.col("ply") - 1), 6).alias("line_share"),
    )


def top_moves(tree: DataFrame, k: int = 3) -> DataFrame:
    """The k most played continuations of each prefix; ties by move."""
    w = Window.partitionBy(*SLICE, "parent_prefix").orderBy(F.desc("total_games"), "move")
    return tree.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*SLICE, "parent_prefix", "move", "total_games", "move_share", "rank")
