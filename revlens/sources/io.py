"""Sources and sinks (SRC1-SRC3, SNK1-SNK3).

* Raw reviews arrive as JSON (an array per file, or JSON lines).  They are
  read with an explicit schema, large arrays by many tasks, and kept as
  Parquet, which prunes.
* Snapshots are one table partitioned by ``snapshot_date``; a same-day
  rerun replaces its partition only (dynamic partition overwrite).
* Reports are one table per result under ``report=<name>/``.
"""

from __future__ import annotations

import datetime as _dt
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.enrich import apply_defaults
from revlens.schema import RAW_REVIEW_SCHEMA, SNAPSHOT_EXTRA_FIELDS
from revlens.session import materialize
from revlens.sources.json_arrays import read_json_arrays


SCAN_PARTITIONS = "spark.revlens.scanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over the partitions that the session asks for.

    A small file is one task, and all per-row text work would run on one
    core.  Sessions that read such
    files set ``spark.revlens.scanPartitions``; without the setting, as for
    large tables, the scan keeps its own splits and nothing is shuffled.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def read_reviews_json(spark: SparkSession, path: str, multiline: bool = True, stored: bool = False) -> DataFrame:
    """Raw review scan with an explicit schema and record defaults (SRC1, P1, P2).

    ``multiline``: files of one JSON array each, split at object boundaries
    (``json_arrays``); otherwise one object per line.  ``stored`` also reads
    the fields of a stored snapshot: its run date and the enrichment it
    already has.
    """
    schema = T.StructType([*RAW_REVIEW_SCHEMA.fields, *SNAPSHOT_EXTRA_FIELDS]) if stored else RAW_REVIEW_SCHEMA
    raw = read_json_arrays(spark, path, schema).drop("file_path") if multiline else spread(spark.read.schema(schema).json(path))
    return apply_defaults(raw)


def write_json_arrays(df: DataFrame, path: str, rows: int = 1_000) -> None:
    """Files of one JSON array of at most ``rows`` rows each.

    The rows are written first and dealt to files by their place in the
    written parts, so no value of any column decides the size of an array.
    """
    at = F.monotonically_increasing_id()
    placed = materialize(df, "json-rows").select(
        F.concat(F.shiftright(at, 33).cast("string"), F.lit("-"), F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / rows).cast("string")).alias("file"),
        F.struct(*df.columns).alias("r"))
    placed.groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("file").text(path)


def write_reviews(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All stores' rows to one dataset, replacing it (SNK1)."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of ``column`` that are present in ``df``; others, and the session's settings, stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write snapshot rows into their ``snapshot_date`` partitions (SNK2).

    Only the partitions present in ``df`` are replaced, so rerunning a date
    is idempotent and other dates are untouched.  A frame without rows names
    no date and changes nothing; the weekly run refuses an empty snapshot.
    """
    write_partitions(df, path, "snapshot_date")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots, keyed by their date (SRC3)."""
    return spark.read.option("basePath", path).parquet(path) \
        .withColumn("snapshot_date", F.col("snapshot_date").cast("date"))


def snapshot_date_from_file(path_col: str = "file_path") -> F.Column:
    """Date of a JSON snapshot named ``reviews_YYYY-MM-DD.json``, a file or a folder of files."""
    return F.to_date(F.regexp_extract(F.col(path_col), r"reviews_(\d{4}-\d{2}-\d{2})", 1))


def read_json_snapshots(spark: SparkSession, path: str, schema) -> DataFrame:
    """Legacy layout: one JSON array per run date, the date in the file name."""
    return read_json_arrays(spark, path, schema).withColumn("snapshot_date", snapshot_date_from_file()).drop("file_path")


def previous_snapshot_date(snapshots: DataFrame, as_of: _dt.date) -> _dt.date | None:
    """Latest snapshot date strictly before ``as_of`` (SRC2), so a future-dated snapshot never wins; None if there is none.

    One scalar, resolved before planning: both snapshots are then read
    through literal partition filters.  Over a stored table it is answered
    from the partition column alone.
    """
    row = snapshots.filter(F.col("snapshot_date") < F.lit(as_of)).agg(F.max("snapshot_date").alias("d")).first()
    return row["d"] if row is not None else None


def latest_snapshot(snapshots: DataFrame, as_of: _dt.date) -> tuple[DataFrame, _dt.date | None]:
    """The latest snapshot strictly before ``as_of`` (SRC2) and its date."""
    d = previous_snapshot_date(snapshots, as_of)
    if d is None:
        return snapshots.limit(0), None
    return snapshots.filter(F.col("snapshot_date") == F.lit(d)), d


def write_report(results: dict[str, DataFrame], path: str, fmt: str = "parquet", at_once: int = 4) -> None:
    """One table per result under ``<path>/report=<name>/`` (SNK3).

    Report tables are small and each is a job of its own: ``at_once`` of
    them are submitted side by side, so that Spark fills its cores.
    """
    def write(item: tuple[str, DataFrame]) -> None:
        item[1].write.mode("overwrite").format(fmt).save(f"{path}/report={item[0]}")

    if results:
        spark = next(iter(results.values())).sparkSession
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(inheritable_thread_target(spark)(write), results.items()))


def read_report(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{path}/report={name}")
