"""Top words by section.

Sections: each sentiment (Positive, Negative, Neutral) over all stores, then
each store over all its text.  Plan:

1. tokens ``[a-z]{3,}`` of the lower-cased text are exploded, stop words
   removed, and counted per (store, sentiment, word): the map-side partial
   aggregate collapses repeated words before the first shuffle;
2. each (store, sentiment, word) count is fanned out to its two sections and
   summed per (section, word): a second, much smaller shuffle;
3. top k per section by count desc, word asc through ``row_number() <= k``
   (partial WindowGroupLimit before the shuffle: k rows per task and
   section, never a whole section in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.schema import STOPWORDS, WORD_PATTERN

SENTIMENT_SECTIONS = ["Positive", "Negative", "Neutral"]


def word_tokens(text) -> F.Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def word_counts(e: DataFrame, stopwords=STOPWORDS) -> DataFrame:
    """Counts per (store, sentiment, word) over rows with text."""
    # explode_outer + filter: a plain explode makes the optimizer push a
    # size(tokens) > 0 filter to the scan, which tokenises every text twice;
    # stop words go as rows, in generated code, not as elements of arrays
    x = e.filter(F.col("has_text")).select("store", "sentiment", F.explode_outer(word_tokens("text")).alias("word")) \
         .filter(F.col("word").isNotNull() & ~F.col("word").isin(list(stopwords)))
    return x.groupBy("store", "sentiment", "word").agg(F.count(F.lit(1)).alias("cnt"))


def top_words(e: DataFrame, k: int = 25, stopwords=STOPWORDS) -> DataFrame:
    c = word_counts(e, stopwords)
    sections = F.array(
        F.when(F.col("sentiment").isin(SENTIMENT_SECTIONS),
               F.struct(F.lit("sentiment").alias("kind"), F.col("sentiment").alias("name"))),
        F.struct(F.lit("store").alias("kind"), F.col("store").alias("name")),
    )
    fan = c.select(F.explode(F.filter(sections, lambda s: s.isNotNull())).alias("s"), "word", "cnt") \
           .select(F.col("s.kind").alias("section_kind"), F.col("s.name").alias("section"), "word", "cnt")
    per = fan.groupBy("section_kind", "section", "word").agg(F.sum("cnt").cast("long").alias("cnt"))
    w = Window.partitionBy("section_kind", "section").orderBy(F.desc("cnt"), F.asc("word"))
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
              .select("section_kind", "section", "rank", "word", "cnt")
