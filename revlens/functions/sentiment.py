"""Lexicon sentiment.

Tokens are the ``[a-z']+`` runs of the lower-cased text.  A token with a
polarity is a hit.  An intensifier right before a hit multiplies it
(integer ten-thousandths, truncated toward zero, clipped to [-1, 1]); a
negation one or two tokens before multiplies it by -0.5.  The score is the
mean over hits, 0.0 without hits.

Everything is kept in integers so the result does not depend on summation
order: each hit contributes ``2*p`` (or ``-p`` when negated) in
ten-thousandths, so

    score = sum / (hits * 20000)
    Positive  <=>  sum >  2000 * hits
    Negative  <=>  sum < -2000 * hits

Two physical strategies give the same results; the caller chooses:

* ``inline`` (the default for a ``Lexicon``): the dictionary is a literal of
  the plan; tokens are scanned with higher-order functions in the stage of
  the scan.  No join, no shuffle.  The plan grows with the dictionary.
* ``join`` (the only one for a lexicon table): the tokens of each distinct
  text are exploded with their two predecessors, joined to the table, summed
  per text and joined back by two hashes of the text.  The score is a
  function of the text alone, so blank, NULL and repeated review ids do not
  matter, and copies of a text are not exploded.  A table of up to
  ``BROADCAST_WORDS`` rows is broadcast, so that no token is shuffled; a
  larger one is never collected.  Only hashes are joined back: the text
  itself crosses that join only for callers that select it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.schema import (LEXICON_SCHEMA, NEGATIVE_THRESHOLD, NO_TEXT, POSITIVE_THRESHOLD,
                            SENTIMENT_TOKEN_PATTERN, TEST_LEXICON)
from revlens.functions.text import is_nonblank
from revlens.operators.common import salted_left_join

# Label thresholds in the doubled ten-thousandth unit (0.1 -> 2000 per hit).
_POS_UNITS = int(round(POSITIVE_THRESHOLD * 20000))
_NEG_UNITS = int(round(NEGATIVE_THRESHOLD * 20000))

#: Rows of a lexicon table that is sent to every task.
BROADCAST_WORDS = 20_000


class Lexicon:
    """Scored words, negations and intensifiers (bounded dictionary)."""

    def __init__(self, rows):
        self.rows = [tuple(r) for r in rows]
        ordered = sorted(self.rows, key=lambda r: (r[0], r[1], r[2]))  # of a word's rows in one role the largest value counts
        self.polarity = {w: int(p) for w, p, _, role in ordered if role == "scored"}
        self.negations = sorted({w for w, _, _, role in ordered if role == "negation"})
        self.intensity = {w: int(i) for w, _, i, role in sorted(ordered, key=lambda r: r[2]) if role == "intensifier"}

    @classmethod
    def default(cls) -> "Lexicon":
        return cls(TEST_LEXICON)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, LEXICON_SCHEMA)

    def __len__(self) -> int:
        return len(self.rows)


def tokens(text, lowered: bool = False) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text if lowered else F.lower(text), F.lit(SENTIMENT_TOKEN_PATTERN), 0)


def _boost(base: Column, mult: Column) -> Column:
    """Intensified polarity: sign(base) * (|base| * mult div 10000), clipped."""
    mag = F.floor((F.abs(base).cast("long") * mult.cast("long")) / F.lit(10000)).cast("long")
    signed = F.when(base < 0, -mag).otherwise(mag)
    return F.least(F.greatest(signed, F.lit(-10000)), F.lit(10000))


def _contribution(w: Column, p1: Column, p2: Column, lex: Lexicon) -> Column:
    pol_map = F.create_map(*[x for w_, p in lex.polarity.items() for x in (F.lit(w_), F.lit(p))])
    base = F.try_element_at(pol_map, w).cast("long")
    if lex.intensity:
        int_map = F.create_map(*[x for w_, m in lex.intensity.items() for x in (F.lit(w_), F.lit(m))])
        mult = F.try_element_at(int_map, p1)
        boosted = F.when(mult.isNotNull(), _boost(base, mult)).otherwise(base)
    else:
        boosted = base
    if lex.negations:
        neg = F.coalesce(p1.isin(lex.negations), F.lit(False)) | F.coalesce(p2.isin(lex.negations), F.lit(False))
    else:
        neg = F.lit(False)
    return F.when(neg, -boosted).otherwise(boosted * 2)


def inline_parts(text, lex: Lexicon, lowered: bool = False) -> Column:
    """STRUCT<sum BIGINT, hits INT> of the review text, all inside codegen."""
    words = sorted(lex.polarity)

    def per_text(a):
        contrib = F.transform(
            a,
            lambda w, i: F.when(
                w.isin(words),
                _contribution(w, F.get(a, i - 1), F.get(a, i - 2), lex),
            ),
        )
        hits = F.filter(contrib, lambda x: x.isNotNull())
        return F.struct(
            F.aggregate(hits, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("sum"),
            F.size(hits).alias("hits"),
        )

    return F.element_at(F.transform(F.array(tokens(text, lowered)), per_text), 1)


def score_from_parts(s: Column, n: Column) -> Column:
    """Unrounded score in [-1, 1]; 0.0 without hits."""
    return F.when(n > 0, s / (n.cast("double") * F.lit(20000.0))).otherwise(F.lit(0.0))


def score_e4(s: Column, n: Column) -> Column:
    """Score in integer ten-thousandths, rounded half away from zero."""
    n2 = n.cast("long") * 2
    pos = F.floor((s + n.cast("long")) / n2).cast("long")
    neg = -F.floor((-s + n.cast("long")) / n2).cast("long")
    return F.when(n > 0, F.when(s >= 0, pos).otherwise(neg)).otherwise(F.lit(0).cast("long"))


def label_from_parts(text, s: Column, n: Column, blank: Column | None = None) -> Column:
    """Label of a text; ``blank`` tells where the caller knows already that it is."""
    return (
        F.when(~is_nonblank(text) if blank is None else blank, F.lit(NO_TEXT))
        .when((n > 0) & (s > F.lit(_POS_UNITS) * n), F.lit("Positive"))
        .when((n > 0) & (s < F.lit(_NEG_UNITS) * n), F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )


def joined_parts(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """``df`` plus columns ``_sent_sum``, ``_sent_hits`` by the join strategy.

    ``lexicon`` is a table (word, polarity, intensity, role).  Only token
    contexts that hit a scored word leave the first join.  A text that many
    rows share is one row before its tokens are exploded: copies meet by two
    hashes, map-side first.
    """
    one = lambda role, col, out: lexicon.filter(F.col("role") == role).groupBy("word") \
        .agg(F.max(col).cast("long").alias(out))  # noqa: E731  one row per word
    keyed = df.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit(1), text))
    toks = keyed.filter(F.col(text).isNotNull()).select("_h1", "_h2", text).dropDuplicates(["_h1", "_h2"]) \
        .select("_h1", "_h2", tokens(text).alias("_t"))
    ctx = toks.select(
        "_h1", "_h2",
        F.explode_outer(F.transform("_t", lambda w, i: F.struct(
            w.alias("word"), F.get(F.col("_t"), i - 1).alias("p1"), F.get(F.col("_t"), i - 2).alias("p2")))).alias("c"),
    ).filter(F.col("c").isNotNull()).select("_h1", "_h2", "c.*")
    small = lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    look_up = lambda rows, words, on, by: rows.join(F.broadcast(words), on, "left") if small \
        else salted_left_join(rows, words, [on], F.struct(*by))
    hits = look_up(ctx, one("scored", "polarity", "base"), "word", ["_h1", "p1", "p2"]).filter(F.col("base").isNotNull())
    mult = one("intensifier", "intensity", "mult").withColumnRenamed("word", "p1")
    hits = look_up(hits, mult, "p1", ["_h1", "word", "p2"])
    for p in ("p1", "p2"):
        flag = one("negation", "polarity", f"_{p}").select(F.col("word").alias(p), F.lit(True).alias(f"neg_{p}"))
        hits = look_up(hits, flag, p, ["_h1", "word"])
    boosted = F.when(F.col("mult").isNotNull(), _boost(F.col("base"), F.col("mult"))).otherwise(F.col("base"))
    negated = F.coalesce("neg_p1", F.lit(False)) | F.coalesce("neg_p2", F.lit(False))
    sums = hits.groupBy("_h1", "_h2").agg(F.sum(F.when(negated, -boosted).otherwise(boosted * 2)).alias("_sent_sum"),
                                          F.count(F.lit(1)).cast("int").alias("_sent_hits"))
    spread = F.xxhash64(*[F.col(c) for c in df.columns if c != text])
    out = salted_left_join(keyed, sums, ["_h1", "_h2"], spread).drop("_h1", "_h2")
    return out.withColumn("_sent_sum", F.coalesce("_sent_sum", F.lit(0).cast("long"))) \
              .withColumn("_sent_hits", F.coalesce("_sent_hits", F.lit(0)))


def with_sentiment(df: DataFrame, text: str = "text", lexicon: Lexicon | DataFrame | None = None,
                   strategy: str | None = None, lowered_text: str | None = None) -> DataFrame:
    """Add ``sent_sum``, ``sent_hits``, ``sent_score``, ``score_e4``, ``sentiment``.

    ``lexicon`` is a ``Lexicon`` or a table; ``strategy`` is "inline" or
    "join", by default inline for the former; a table is always joined.
    ``lowered_text`` names a column already holding ``lower(text)``.
    """
    lex, blank = lexicon if lexicon is not None else Lexicon.default(), ~is_nonblank(F.col(text))
    strategy = strategy or ("inline" if isinstance(lex, Lexicon) else "join")
    if strategy == "inline":
        if not isinstance(lex, Lexicon):
            raise ValueError("a lexicon table is joined, not inlined")
        src = lowered_text or text
        out = df.withColumn("_sp", inline_parts(src, lex, lowered=lowered_text is not None)) \
                .withColumn("_sent_sum", F.col("_sp.sum")).withColumn("_sent_hits", F.col("_sp.hits")).drop("_sp")
    elif strategy == "join":
        # judged before the join, which then needs no text
        out = joined_parts(df.withColumn("_sent_blank", blank), text, lex.to_dataframe(df.sparkSession) if isinstance(lex, Lexicon) else lex)
        blank = F.col("_sent_blank")
    else:
        raise ValueError(strategy)
    s = F.when(blank, F.lit(0).cast("long")).otherwise(F.col("_sent_sum"))
    n = F.when(blank, F.lit(0)).otherwise(F.col("_sent_hits"))
    return (out.withColumn("sent_sum", s).withColumn("sent_hits", n)
            .drop("_sent_sum", "_sent_hits")
            .withColumn("sent_score", score_from_parts(F.col("sent_sum"), F.col("sent_hits")))
            .withColumn("score_e4", score_e4(F.col("sent_sum"), F.col("sent_hits")))
            .withColumn("sentiment", label_from_parts(text, F.col("sent_sum"), F.col("sent_hits"), blank))
            .drop("_sent_blank"))
