"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import PySparkAttributeError
from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "revlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used by library code)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the test tables are single files: deal their rows over the cores
        .config("spark.revlens.scanPartitions", str(cpus))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be configured (a distributed file system path);
    only a local-mode session without one gets a fresh scratch folder, as in
    tests.  Materialised tables and round-trip sinks live below it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except PySparkAttributeError:  # Spark Connect: only the session conf is visible
        sc = None
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="revlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None:
        sc.setCheckpointDir(d)
    return d


_made: list[str] = []  # paths that this process has handed out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def scratch_mark() -> int:
    """How many scratch paths exist by now, for ``clear_scratch``."""
    return len(_made)


def clear_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that this process has written under the shared folder since a mark; returns how many there were.

    Results are read from them lazily, so only a caller that has stored or
    collected its results may clear them (the jobs and the benchmark do).
    """
    hadoop, conf, n = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), 0
    while len(_made) > since:
        path = hadoop.Path(_made.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


#: Scratch tables carry no marker file: whoever reads one has waited for its write.
NO_MARKER = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def materialize(df, name: str, parts: int | None = None):
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage of a result that several later jobs read (so a lost
    executor re-reads files instead of recomputing the whole upstream) and
    pays the upstream cost once.  Never ``localCheckpoint``: the files live
    in the shared folder, not on one executor's disk.  The schema is known,
    so no job looks it up in the files.  ``parts``: a table known to be
    small is written by at most so many tasks, as so many files.

    (Hadoop's local file system starts processes for every file it makes.
    A process just forked shows its parent's whole memory as its own, so
    needless files and markers also count against a memory limit.)
    """
    path = fresh_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.mode("overwrite").options(**NO_MARKER).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
