"""JSON arrays of any size as splittable input (SRC1).

A file that holds one JSON array is a single task for Spark's multi-line
reader.  Here it is read by many:

1. the text source splits the file at every ``}``, by byte ranges like any
   text file.  A fragment knows its file and the range (block) it lies in;
2. whether a fragment begins inside a string follows from the number of
   quotes before it, without escaped ones.  Each block sums up what it does
   to that state and to the depth of braces, for both states that it may
   begin with; a running sum over the blocks of a file, a few numbers each,
   gives every block its true beginning;
3. with it, each block finds the ends of its top-level objects and joins
   their fragments.  Only the first object and the rest of a block may
   belong to an object that spans blocks; these are put together by file.

No step reads a file as a whole, guesses at a boundary, or depends on how
the objects are laid out: strings may hold braces, quotes and any characters.
A file may also be one object, or objects one after the other.

Limits: a file must be well-formed; an unclosed string hides what follows
it, as it does from any reader.  Elements of an array that are no objects
are not read.  One object must fit into memory.
Compressed files cannot be split and remain one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import materialize

END = "}"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (order within the block), t (text before a closing brace)."""
    return spark.read.option("lineSep", END).option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("t"))


def _measures(t: str) -> list[Column]:
    """quotes, and opening braces outside strings if the fragment begins outside (open0) or inside (open1) a string."""
    pieces = F.split(F.regexp_replace(F.col(t), r"\\.", ""), '"')
    opens = lambda odd: F.coalesce(F.aggregate(
        F.transform(pieces, lambda x, i: F.when(i % 2 == odd, F.length(x) - F.length(F.replace(x, F.lit("{")))).otherwise(F.lit(0))),
        F.lit(0), lambda a, x: a + x), F.lit(0))
    return [(F.size(pieces) - 1).alias("quotes"), opens(0).alias("open0"), opens(1).alias("open1")]


def _in_block():
    return Window.partitionBy("file", "block").orderBy("at")


def _states(frags: DataFrame, begins: Column) -> DataFrame:
    """Fragments with ``closes`` (their end is no part of a string) and ``change`` of depth, if their block begins in state ``begins``."""
    before = F.coalesce(F.sum("quotes").over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = (begins + before) % 2
    closes = F.when((begins + before + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    return frags.withColumns({"change": F.when(inside == 0, F.col("open0")).otherwise(F.col("open1")) - closes, "closes": closes})


def _block_starts(frags: DataFrame) -> DataFrame:
    """Per block of a file: the state (in a string or not) and the depth it begins with."""
    both = _states(frags, F.lit(0)).withColumnRenamed("change", "change0")
    both = _states(both.drop("closes"), F.lit(1)).withColumnRenamed("change", "change1")
    sums = both.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("change0").alias("change0"), F.sum("change1").alias("change1"))
    # one row per block of a file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("begins") == 0, F.col("change0")).otherwise(F.col("change1"))
    return sums.withColumn("_c", change).select(
        "file", "block", "begins", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("depth"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, object): the text of every top-level object of the files below ``path``."""
    measured = _fragments(spark, path).select("file", "block", "at", *_measures("t"), "t")
    starts = _block_starts(measured.drop("t"))
    known = _states(measured.join(starts, ["file", "block"]), F.col("begins"))
    depth = F.col("depth") + F.sum("change").over(_in_block())
    # an object ends where the depth comes back to nought; its fragments are those since the last such end
    ended = known.withColumn("ends", ((depth == 0) & (F.col("closes") == 1)).cast("int"))
    number = F.coalesce(F.sum("ends").over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = ended.withColumn("number", number).groupBy("file", "block", "number").agg(
        F.max("ends").alias("ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: F.concat(x["t"], F.lit(END))), "").alias("t"))
    pieces = materialize(pieces, "json-objects")
    within = pieces.filter((F.col("number") > 0) & (F.col("ends") == 1)).select("file", "t")
    # the first piece and the unended rest of every block, in file order; a piece that ends closes a group
    edge = pieces.filter((F.col("number") == 0) | (F.col("ends") == 0))
    order = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    place = edge.select("file", "block", "number", F.coalesce(F.sum("ends").over(order), F.lit(0)).alias("group"))
    across = edge.join(place, ["file", "block", "number"]).groupBy("file", "group").agg(
        F.max("ends").alias("ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "number", "t"))), lambda x: x["t"]), "").alias("t"))
    # what ends no object is the end of the file (the text source's last fragment)
    return within.union(across.filter("ends = 1").select("file", "t")) \
        .select("file", F.regexp_replace("t", r"^[^{]*", "").alias("object"))


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all objects of the JSON array files below ``path``, with ``file_path``: as the multi-line reader gives them."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return objects(spark, path).select(F.from_json("object", kind).alias("r"), F.col("file").alias("file_path")).select("r.*", "file_path")
