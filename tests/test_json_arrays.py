"""JSON arrays read by many tasks, against the multi-line reader and the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from revlens.session import fresh_path
from revlens.sources import io, json_arrays
from revlens.sources.json_arrays import read_json_arrays

SCHEMA = "id long, text string, tags array<string>, more struct<a:string,b:struct<c:int>>"
BITS = ["}", "{", '"', "\\", "\\\\", "],[", "é", "中文", "\U0001f600", "\n", "\t", " ", "word", "},{", '\\"', "/", " ", ":", "}}}"]


def make(rnd, n):
    text = lambda: "".join(rnd.choice(BITS) for _ in range(rnd.randrange(12)))
    return [{"id": i, "text": text() if i % 7 else None, "tags": [text() for _ in range(rnd.randrange(3))],
             "more": {"a": text(), "b": {"c": i}} if i % 3 else None} for i in range(n)]


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def shown(df):
    return sorted(str(r) for r in df.select("id", "text", "tags", "more").collect())


@pytest.mark.parametrize("block", [64, 333, 1 << 20])
@pytest.mark.parametrize("style", [{}, {"indent": 2, "ensure_ascii": False}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_many_blocks_equal_the_multi_line_reader(spark, tmp_path, block, style):
    rnd = random.Random(block)
    for k in range(3):
        write(tmp_path, f"f{k}.json", json.dumps(make(rnd, 40), **style))
    keys = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": 1, "spark.sql.files.minPartitionNum": 1}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, str(v))
        got = read_json_arrays(spark, str(tmp_path), SCHEMA)
        tasks = json_arrays._fragments(spark, str(tmp_path)).select("file", "block").distinct().count()
        rows = shown(got)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tasks > 30 if block < 100 else tasks >= 3
    assert rows == shown(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)))
    assert len(rows) == 120


def test_other_layouts(spark, tmp_path):
    a = {"id": 1, "text": "x}", "tags": [], "more": None}
    write(tmp_path, "none.json", "[]")
    write(tmp_path, "blank.json", "")
    write(tmp_path, "space.json", " [ \n ] \n")
    write(tmp_path, "one.json", json.dumps(a))
    write(tmp_path, "lines.json", "\n".join(json.dumps({**a, "id": i}) for i in (2, 3)))
    write(tmp_path, "crlf.json", "[\r\n" + json.dumps({**a, "id": 4}) + "\r\n,\r\n" + json.dumps({"id": 5}) + "\r\n]\r\n")
    got = {r["id"]: r["text"] for r in read_json_arrays(spark, str(tmp_path), SCHEMA).collect()}
    assert got == {1: "x}", 2: "x}", 3: "x}", 4: "x}", 5: None}


def test_files_are_named(spark, tmp_path):
    write(tmp_path, "reviews_2026-01-05.json", json.dumps([{"review_id": "a"}, {"review_id": "b"}]))
    write(tmp_path, "reviews_2026-01-12.json", json.dumps([{"review_id": "c"}]))
    rows = io.read_json_snapshots(spark, str(tmp_path), "review_id string").collect()
    assert sorted((str(r["snapshot_date"]), r["review_id"]) for r in rows) == [("2026-01-05", "a"), ("2026-01-05", "b"), ("2026-01-12", "c")]


def test_written_arrays_are_bounded_whatever_the_key(spark):
    rows = spark.range(2500).select(F.lit(None).cast("string").alias("review_id"), F.lit("s").alias("store"), F.lit("same").alias("text"),
                                    F.lit("2").cast("double").alias("rating"))
    path = fresh_path(spark, "arrays")
    io.write_json_arrays(rows, path, 100)
    sizes = [len(json.loads(r["value"])) for r in spark.read.text(path, wholetext=True).collect()]
    assert sum(sizes) == 2500 and max(sizes) <= 100
    assert io.read_reviews_json(spark, path).count() == 2500
