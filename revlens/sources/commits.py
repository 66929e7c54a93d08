"""Publication of several tables in one step.

A run writes its tables into folders of its own, which nobody reads yet, and
then publishes them with one small file: the manifest ``commits/<number>.json``
below the history's path.  It lists, for every date, the folders that hold
its tables.  Readers look at the manifest with the highest number only, so
they see all tables of a run or none, and a run that fails between two writes
leaves the committed weeks as they were.

A manifest has one entry per run date, so its size follows the number of
weeks, not the data.  It is written beside its place and renamed; a number
that exists already was published by another run, and the loser raises
``ConflictingRun`` without having changed anything.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


class ConflictingRun(RuntimeError):
    """Another run has published since this one began: run again."""


@dataclass(frozen=True)
class Week:
    """The committed folders of one date; ``prev_date`` is None for the baseline."""
    as_of: _dt.date
    prev_date: _dt.date | None
    snapshot: str
    new_reviews: str | None = None
    sums: str | None = None


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published manifests, ascending."""
    fs, path, _ = _fs(spark, f"{root}/commits")
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[_dt.date, Week]]:
    """(number, week by date) of a manifest, by default the latest; (0, {}) if there is none."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return 0, {}
    text = spark.read.text(f"{root}/commits/{version:08d}.json", wholetext=True).first()[0]
    day = lambda x: x and _dt.date.fromisoformat(x)
    weeks = (Week(**{**w, "as_of": day(w["as_of"]), "prev_date": day(w["prev_date"])}) for w in json.loads(text))
    return version, {w.as_of: w for w in weeks}


def publish(spark: SparkSession, root: str, since: int, weeks: dict[_dt.date, Week]) -> int:
    """Make ``weeks`` the committed ones, if manifest ``since`` is still the latest; returns the new number."""
    fs, folder, hadoop = _fs(spark, f"{root}/commits")
    fs.mkdirs(folder)
    new = hadoop.Path(folder, f"{since + 1:08d}.json")
    staged = hadoop.Path(folder, f".{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps([asdict(weeks[d]) for d in sorted(weeks)], default=str, indent=0).encode()))
    out.close()
    if max(versions(spark, root), default=0) != since or fs.exists(new) or not fs.rename(staged, new):
        fs.delete(staged, False)
        raise ConflictingRun(f"{root}: manifest {since + 1} was published by another run")
    return since + 1


def remove_superseded(spark: SparkSession, roots: list[str], history_path: str) -> list[str]:
    """Delete the run folders below ``roots`` (``<table>/<date>/run=...``) that the latest manifest does not name; returns them.

    For times when no run and no reader of an older manifest is active:
    what a failed run has left goes, too.
    """
    _, weeks = read(spark, history_path)
    kept = {_fs(spark, p)[1].toUri().getPath() for w in weeks.values() for p in (w.snapshot, w.new_reviews, w.sums) if p}
    gone = []
    for root in roots:
        fs, _, hadoop = _fs(spark, root)
        for depth in ("*/run=*", "*/*/run=*"):
            for status in fs.globStatus(hadoop.Path(f"{root}/{depth}")) or []:
                path = status.getPath()
                if path.toUri().getPath() not in kept:
                    fs.delete(path, True)
                    gone.append(path.toString())
    return sorted(gone)
