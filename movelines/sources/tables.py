"""Reading and writing partitioned game tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITION = ("year", "month", "event")


def read_games(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """A hive-partitioned games table; partition values come from the directory names."""
    games = spark.read.parquet(root)
    return games.select(*columns) if columns else games


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


read_stats = read_edges


def partition_catalog(games: DataFrame, keys=PARTITION, newest_first: bool = False) -> DataFrame:
    order = [F.col(k).desc() if newest_first and k in ("year", "month") else F.col(k) for k in keys]
    return games.select(*keys).distinct().orderBy(*order)


def select_partitions(games: DataFrame, year_range=None, events=None, month=None, elo_band=None, rating_class=None) -> DataFrame:
    """Inclusive year range, list of events, one month, one band, one class; each is optional."""
    if year_range:
        games = games.filter(F.col("year").between(*year_range))
    if events:
        games = games.filter(F.col("event").isin(*events))
    for name, value in (("month", month), ("elo_band", elo_band), ("rating_class", rating_class)):
        if value is not None:
            games = games.filter(F.col(name) == value)
    return games


def pending_partitions(catalog: DataFrame, done: DataFrame, keys=PARTITION, overwrite: bool = False) -> DataFrame:
    return catalog if overwrite else catalog.join(done.select(*keys).distinct(), list(keys), "left_anti")


def limit_per_partition(games: DataFrame, n: int, keys=PARTITION, order: str = "game_id") -> DataFrame:
    """The first n games of each partition by `order`. Spark cuts each task's rows to n per
    partition before the shuffle, so a huge partition is never gathered whole."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return games.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def write_partitioned(df: DataFrame, path: str, keys=PARTITION, max_rows: int = 2_000_000) -> None:
    """zstd level 3, at most max_rows rows a file; only the partitions in df are replaced. One job over
    df: its rows are dealt by partition, then tasks of spark.sql.adaptive.advisoryPartitionSizeInBytes
    are made of them, from a share of a large partition or from several small ones."""
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .partitionBy(*keys)
        .parquet(path)
    )


def _log(path: str) -> str:
    return path.rstrip("/") + "_manifest"


def _entries(spark: SparkSession, path: str) -> DataFrame | None:
    """All entries of the manifest, also those that later writes replaced; None before the first."""
    try:
        return spark.read.parquet(_log(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_manifest(spark: SparkSession, path: str, keys=PARTITION) -> DataFrame:
    """One row for each partition of a table that write_logged wrote: keys, files, rows. Read from the
    manifest beside the table; no file of the table is opened."""
    log = spark.read.parquet(_log(path))
    newest = log.groupBy(*keys).agg(F.max("version").alias("version"))
    own = log.join(newest.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("version").alias("_version")), [*[log[k].eqNullSafe(F.col(f"_{k}")) for k in keys], log["version"] == F.col("_version")])
    return own.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def write_logged(df: DataFrame, path: str, keys=PARTITION, max_rows: int = 2_000_000) -> None:
    """write_partitioned, and the new files with their rows added to the manifest: a table beside this
    one, to which every write appends under its own version. A partition's files are those of its
    newest version. Rows are counted from the files' footers. If a write fails before its manifest is
    there, the next one adds its files."""
    spark = df.sparkSession
    write_partitioned(df, path, keys, max_rows)
    before = _entries(spark, path)
    files = spark.read.parquet(path)
    names = files.inputFiles()  # as many as Spark's own index of the table holds
    if before is not None:
        known = {r["file"] for r in before.select("file").collect()}
        names = [n for n in names if n not in known]
    if not names:
        return
    version = 1 + (before.agg(F.max("version")).first()[0] if before is not None else 0)
    new = spark.read.schema(files.schema).option("basePath", path).parquet(*names).select(*keys, F.input_file_name().alias("file"))
    new.groupBy(*keys, "file").agg(F.count("*").alias("rows"), F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(_log(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
