"""Small shared building blocks for the result operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialize


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def pct(num: Column, den: Column) -> Column:
    """100*num/max(den,1) as DOUBLE (guarded percentage, P17)."""
    return F.lit(100.0) * num / F.greatest(den, F.lit(1))


def explode_list(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row per element of an array column (other columns kept).

    ``explode_outer`` plus a NOT NULL filter instead of ``explode``: for a
    plain explode the optimizer infers ``size(array) > 0`` and pushes it
    below joins and filters, where it evaluates an expensive array
    expression (tagging, tokenising) a second time on rows that may later
    be dropped.
    """
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.explode_outer(col).alias(name)).filter(F.col(name).isNotNull())


def stack_rows(df: DataFrame, keep: list[str], entries: list[dict[str, Column]]) -> DataFrame:
    """Turn one wide row into ``len(entries)`` long rows (no join, no shuffle).

    ``entries`` are dicts of output column -> expression over ``df``; all
    entries must produce the same column names.
    """
    structs = [F.struct(*[e.alias(k) for k, e in ent.items()]) for ent in entries]
    names = list(entries[0].keys())
    return df.select(*keep, F.explode(F.array(*structs)).alias("_s")).select(
        *keep, *[F.col(f"_s.{n}").alias(n) for n in names])


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per key at most).

    A key may hold any part of ``left``: its rows are dealt to ``salts``
    parts by ``spread``, and ``right``, the small side of unique keys, is
    repeated for each part.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], "left").drop("_salt")


def store_labels(stores: list[str], taken: list[str]) -> dict[str, str]:
    """Store -> column name: its own, or ``store <name>`` where a result column has that name."""
    return {s: f"store {s}" if s in taken else s for s in stores}


#: Number of reviews that a row of a grain table stands for.
WEIGHT = "n_reviews"


def as_grains(e: DataFrame, dims: list[str], replied: bool = False, scored: bool = False) -> DataFrame:
    """Reviews counted by ``dims``: WEIGHT, and on demand ``replied`` and ``score_e4`` sums.

    ``e``: review rows, or a table that is counted already by these and
    other columns (``metrics.review_grains``), which is returned as it is:
    the result tables add up whatever grain they are given.
    """
    if WEIGHT in e.columns:
        return e
    sums = [F.count(F.lit(1)).alias(WEIGHT)]
    sums += [F.count_if(F.coalesce("has_reply", F.lit(False))).alias("replied")] * replied
    sums += [F.sum(F.col("score_e4").cast("long")).alias("score_e4")] * scored
    return e.groupBy(*dims).agg(*sums)


def n_if(cond: Column | None = None) -> Column:
    """Number of reviews of a grain table, of those with ``cond``."""
    n = F.col(WEIGHT) if cond is None else F.when(cond, F.col(WEIGHT))
    return F.coalesce(F.sum(n), F.lit(0).cast("long"))


def mean_rating(cond: Column | None = None) -> Column:
    """Mean rating of the rated reviews of a grain table; ratings are multiples of a half, so their sums are exact."""
    rated = F.col("rating").isNotNull() if cond is None else cond & F.col("rating").isNotNull()
    return F.try_divide(F.sum(F.when(rated, F.col("rating") * F.col(WEIGHT))), n_if(rated).cast("double"))


def by_key_and_store(g: DataFrame, key: str, stores: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per ``key``: the ``sums`` over all stores, and ``_by_store``, a map store -> reviews for the configured ones.

    One aggregate by key and store; the totals follow from that small result.
    """
    small = g.groupBy(key, "store").agg(n_if().alias("_n"), *[c.alias(k) for k, c in sums.items()])
    entry = F.when(F.col("store").isin(stores), F.struct("store", "_n"))
    return small.groupBy(key).agg(*[F.sum(k).alias(k) for k in sums], F.map_from_entries(F.collect_list(entry)).alias("_by_store"))


def with_store_columns(totals: DataFrame, stores: list[str]) -> DataFrame:
    """``totals`` with one count column per configured store instead of the map ``_by_store``."""
    shown = [c for c in totals.columns if c != "_by_store"]
    names = store_labels(stores, shown)
    return totals.select(*shown, *[F.coalesce(F.try_element_at("_by_store", F.lit(s)), F.lit(0).cast("long")).alias(names[s]) for s in stores])


def rank_small(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank rows of a result whose size is bounded by construction.

    Only for outputs that are small by definition (top-k results, one row
    per dictionary entry, per configured store or per snapshot date): the
    unpartitioned window runs in one task.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Consecutive 1-based rank (LONG) in a total order, for unbounded lists.

    One range-partitioned sort (the same exchange a global ``orderBy``
    uses), written to the shared folder.  Inside a sorted partition
    ``monotonically_increasing_id()`` holds the partition index in its upper
    bits and the row position in its lower 33 bits.  Row counts per
    partition (a bounded table, broadcast) and rows are both read from the
    written copy, so the ranks do not depend on the sort being planned or
    run only once.  No step gathers the list into one task.

    Pass only the columns that the list shows: whole rows cross the
    exchange.  A hash of the row ends the order: rows whose visible keys are
    equal (a hot key holding a third of the list) are still spread over the
    range partitions, and only identical rows tie.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = list(order) + [F.xxhash64(*[F.col(c) for c in df.columns])]
    part = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    pid = F.shiftright(F.col("_mid"), 33)
    counts = part.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: the running sum runs in one task on a tiny table
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    out = part.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
    place = F.col("_mid") - F.shiftleft(F.col("_pid"), 33) + 1
    return out.withColumn(name, F.col("_off") + place).drop("_pid", "_off", "_mid")
