"""Keyword tagging from a table of keywords (P8, SRC6).

The literal form in ``functions.categories`` tries every keyword on every
text, and the plan grows with the dictionary.  Here the keywords are a table
(category, keyword, position of the category) of any size:

1. every keyword is filed under one of its q-grams, the one that fewest
   keywords hold;
2. each distinct text is cut into its distinct q-grams, once, however many
   rows share it; the grams meet the filed keywords in a salted join, so a
   text is tried only on keywords whose gram it holds;
3. the candidates are verified by ``contains`` and give the text's
   categories in the order of their positions.

Keywords shorter than q are filed under themselves.  Rows get their tags by
two hashes of the text, so blank, missing and repeated ids do not matter.
Results equal the literal form: no match, a NULL or blank text gives
['General'], an empty keyword matches every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.operators.common import salted_left_join
from revlens.schema import GENERAL_CATEGORY

Q = 3


def to_table(spark: SparkSession, categories) -> DataFrame:
    """A dictionary [(category, [keyword, ...]), ...] as a table (category, keyword, position)."""
    rows = [(name, k, i) for i, (name, kws) in enumerate(categories) for k in kws]
    return spark.createDataFrame(rows, "category string, keyword string, position int")


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; one pass over the text."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def filed_keywords(table: DataFrame, q: int = Q) -> DataFrame:
    """gram -> [(position, category, keyword), ...]: every keyword under its rarest gram (of equally rare ones the smallest)."""
    words = table.select(F.lower("keyword").alias("keyword"), "category", "position").filter("keyword is not null").distinct()
    size = F.least(F.length("keyword"), F.lit(q))
    own = F.when(size < q, F.array("keyword")).otherwise(grams(F.col("keyword"), q))
    pairs = words.select("keyword", "category", "position", F.explode(own).alias("gram"))
    held = pairs.select("gram", "keyword").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rare = Window.partitionBy("keyword", "category", "position").orderBy("held", "gram")
    best = pairs.join(held, "gram").withColumn("_n", F.row_number().over(rare)).filter("_n = 1")
    return best.groupBy("gram").agg(F.collect_list(F.struct("position", "category", "keyword")).alias("filed"))


def with_category_table(df: DataFrame, text: str, table: DataFrame, out: str = "category_list", q: int = Q) -> DataFrame:
    """``df`` with ``out``, the ARRAY<STRING> of matched categories."""
    sizes = sorted(r[0] for r in table.filter("keyword is not null").select(F.least(F.length("keyword"), F.lit(q))).distinct().collect())  # q + 1 at most
    keyed = df.withColumn("_k1", F.xxhash64(text)).withColumn("_k2", F.xxhash64(F.lit(1), text))
    general = F.array(F.lit(GENERAL_CATEGORY))
    if not sizes:
        return df.withColumn(out, general)
    texts = keyed.filter(F.col(text).isNotNull()).select("_k1", "_k2", F.lower(text).alias("_text")).dropDuplicates(["_k1", "_k2"])
    found = texts.select("_k1", "_k2", F.explode_outer(F.concat(*[grams(F.col("_text"), n) for n in sizes])).alias("gram"))
    found = salted_left_join(found, filed_keywords(table, q), ["gram"], F.struct("_k1", "_k2")).filter(F.col("filed").isNotNull())
    tried = found.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("filed")).alias("filed"))  # each keyword of the table at most once
    hits = F.filter("filed", lambda k: F.contains(F.col("_text"), k["keyword"]))
    names = F.array_distinct(F.transform(F.array_sort(hits), lambda k: k["category"]))
    tags = texts.join(tried, ["_k1", "_k2"]).select("_k1", "_k2", names.alias(out)).filter(F.size(out) > 0)
    spread = F.xxhash64(*[F.col(c) for c in df.columns if c != text]) if len(df.columns) > 1 else F.monotonically_increasing_id()
    tagged = salted_left_join(keyed, tags, ["_k1", "_k2"], spread).drop("_k1", "_k2")
    return tagged.withColumn(out, F.coalesce(out, general))
