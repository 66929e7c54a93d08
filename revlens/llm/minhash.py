"""Near-duplicate documents by SuperMinHash (operator 7).

1. every document's distinct word shingles give a SuperMinHash signature:
   each shingle ranks the components by a permutation of its own, so its
   ranks are correlated and the signature varies less than independent
   hashes; the walk stops at the rank where no component can improve;
2. documents with equal shingle sets form a class, whose smallest document
   stands for it from here on;
3. the signature is cut into bands; classes that agree in a band are
   candidates.  A candidate whose own shingles (found in no other
   candidate) alone put it below the threshold is linked with nothing and
   leaves;
4. in every band bucket all members are confirmed against one centre on
   their full sets, and the links are joined into components.  What a member
   has and the centre has not, or the other way round, is kept: against the
   same centre these differences stand for the full sets;
5. members of a centre whose components still differ are compared by their
   differences, in blocks, and the components of all links are the result.

Step 5 leaves no candidate pair undecided: two members of a bucket are
either in one component already or compared.  A group of near copies costs
about one full comparison a member, and no row is made for a pair.

With ``BANDS`` bands of ``ROWS`` rows a pair at similarity 0.85 is missed
with a probability of 7e-6, a more similar one less often; ``keep`` takes
0.8 and ``KEEP_BANDS`` bands of ``KEEP_ROWS`` rows with the same chance.

Defined results: null and empty texts have no shingles and are linked with
nothing; a document shorter than a shingle is one shingle.  A null key is
no document that could be linked: its component is null and it is kept.
Rows that repeat a key are one document for its component; its texts'
links all count.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import GOLDEN, U, mix, roots, salted_left_join, units, windows, word_groups
from revlens.llm.components import connected_components
from revlens.session import materialize

WORDS = 5
THRESHOLD = 85  # per cent of the union
BANDS, ROWS = 25, 6
KEEP_THRESHOLD = 80  # of ``keep`` and the pipeline's stage
KEEP_BANDS, KEEP_ROWS = 30, 5
BLOCK = 256
UNITS = "array<struct<kind:int,i:int,j:int>>"


# ---------------------------------------------------------------- shingles and signatures

def shingle_sets(counts: np.ndarray, hashes: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document: (size of each set, sorted hashes one document after another)."""
    doc, _, h = windows(counts, hashes, n)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):  # the whole sequence is one shingle
        at, start = np.concatenate(([0], np.cumsum(counts)))[few], np.zeros(len(few), U)
        with np.errstate(over="ignore"):
            for k in range(n - 1):
                on = counts[few] > k
                start[on] = mix(start[on] * U(0xD1342543DE82EF95) + hashes[at[on] + k] + U(k + 1))
        doc, h = np.append(doc, few), np.append(h, start)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        doc, h = doc[new], h[new]
    return np.bincount(doc, minlength=len(counts)), h


def superminhash(sizes: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures of sets that lie one after another in ``h``; one row of ``m`` values a set.

    Round j gives the j-th place of each element's permutation the value
    j + r, r uniform in [0, 1).  A component keeps its least value; a set
    is finished when all of its components are below j + 1, as later rounds
    give more.  Empty sets keep infinite values.
    """
    sig = np.full((len(sizes), m), np.inf)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    state, picks = h, []  # picks[i]: the exchange partner of place i, by element
    open_sets = sizes > 0
    for j in range(m):
        with np.errstate(over="ignore"):
            u = mix(state + U(2 * j + 1) * GOLDEN)
            v = mix(state + U(2 * j + 2) * GOLDEN)
        k = j + ((u >> U(32)) * U(m - j) >> U(32)).astype(np.int32)
        picks.append(k)
        place = k.copy()  # follow the exchanges back to the place's first holder
        for i in range(j - 1, -1, -1):
            place = np.where(picks[i] == place, i, place)
        value = j + (v >> U(11)) * (1.0 / (1 << 53))
        np.minimum.at(sig.reshape(-1), rows * m + place, value)
        open_sets[open_sets] = sig[open_sets].max(axis=1) >= j + 1
        stay = open_sets[rows]
        if not stay.any():
            break
        if not stay.all():
            rows, state, picks = rows[stay], state[stay], [p[stay] for p in picks]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; the band's number is part of it."""
    bits, key = sig.view(U), np.zeros((len(sig), bands), U)
    key += np.arange(1, bands + 1, dtype=U) * GOLDEN
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * U(0xD1342543DE82EF95) + bits[:, r: bands * rows: rows])
    return key


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, set_a, set_b, bands) of every row: size and 128-bit hash of its shingle set, and its band keys."""
    def run(batches):
        for b in batches:
            for first, end, counts, hashes in word_groups(b.column(1)):
                sizes, h = shingle_sets(counts, hashes)
                keys = band_keys(superminhash(sizes, h, bands * rows), bands, rows)
                at, full = np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes > 0
                a, c = np.zeros(len(sizes), U), np.zeros(len(sizes), U)
                if len(h):
                    with np.errstate(over="ignore"):
                        a[full] = np.add.reduceat(h, at[full])
                        c[full] = np.add.reduceat(mix(h + GOLDEN), at[full])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands),
                                                pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, end - first), pa.array(sizes.astype(np.int64)), pa.array(a.view(np.int64)),
                     pa.array(c.view(np.int64)), flat], ["id", "n", "set_a", "set_b", "bands"])

    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "id long, n long, set_a long, set_b long, bands array<bigint>")


def full_sets(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, n, shingles array<long>, sorted) of every row."""
    def run(batches):
        for b in batches:
            for first, end, counts, hashes in word_groups(b.column(1)):
                sizes, h = shingle_sets(counts, hashes)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)),
                                                pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(sizes.astype(np.int64)), flat],
                                                 ["id", "n", "shingles"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, shingles array<bigint>")


# ---------------------------------------------------------------- links

def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (centre, id) with both sizes, what their full sets differ in, and whether they reach the threshold."""
    a = sets.select(F.col("id").alias("centre"), F.col("shingles").alias("sa"))
    b = sets.select("id", F.col("shingles").alias("sb"))

    def run(batches):
        for t in batches:
            diff, n, linked = [], [], []
            for x, y in zip(t.column("sa"), t.column("sb")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                d = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(d)) // 2
                diff.append(d)
                n.append(len(y))
                linked.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([t.column("centre"), t.column("id"), pa.array(n, pa.int64()),
                                              pa.array(diff, pa.list_(pa.int64())), pa.array(linked, pa.bool_())],
                                             ["centre", "id", "n", "diff", "linked"])

    return pairs.join(a.hint("merge"), "centre").join(b.hint("merge"), "id").select("centre", "id", "sa", "sb").mapInArrow(
        run, "centre long, id long, n long, diff array<bigint>, linked boolean")


def links_by_difference(n: np.ndarray, diff: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                        threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (left, right) of sets given by their sizes and their differences from one centre.

    Two sets differ in what is in one of their differences only, so with
    the sizes their common part is known exactly.
    """
    size = np.array([len(d) for d in diff])
    row, (_, cell, count) = np.repeat(np.arange(len(diff)), size), np.unique(
        np.concatenate([*diff, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    row, cell = row[count[cell] > 1], cell[count[cell] > 1]  # an element of one difference only is in no common part
    _, cell = np.unique(cell, return_inverse=True)
    order = np.argsort(cell, kind="stable")
    row, cell = row[order], cell[order]
    common = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, len(diff)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    for s in range(0, int(cell[-1]) + 1 if len(cell) else 0, 2048):
        a, b = np.searchsorted(cell, [s, s + 2048])
        sides = []
        for k, m in ((0, len(left)), (1, len(right))):
            x, at = np.zeros((m, 2048), np.float32), place[k, row[a:b]]
            x[at[at >= 0], cell[a:b][at >= 0] - s] = 1
            sides.append(x)
        common += sides[0] @ sides[1].T
    apart = size[left][:, None] + size[right][None, :] - 2 * common.astype(np.int64)
    both = n[left][:, None] + n[right][None, :]
    p, q = np.nonzero(100 * (both - apart) >= threshold * (both + apart))
    return left[p], right[q]


def _compare(threshold: int):
    def run(batches):
        for t in units(batches, ["centre", "kind", "i", "j"]):
            ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
            left = np.flatnonzero(side == side[0])
            right = np.flatnonzero(side != side[0]) if t.column("kind")[0].as_py() or t.column("i")[0] != t.column("j")[0] else left
            if not len(right):
                continue
            p, q = links_by_difference(t.column("n").to_numpy(), [d.values.to_numpy() for d in t.column("diff")], left, right, threshold)
            root = roots(len(ids), p, q)
            on = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]])], ["a", "b"])

    return run


def further_links(star: DataFrame, components: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of one centre that are in different components so far.

    Members outside the centre's component are compared with one another and
    with those inside, in pairs of blocks of ``BLOCK`` members.
    """
    labelled = salted_left_join(star.select("centre", "id", "n", "diff"), components, ["id"], F.col("centre"))
    own = components.select(F.col("id").alias("centre"), F.col("component").alias("main"))
    labelled = salted_left_join(labelled, own, ["centre"], F.col("id")) \
        .withColumn("out", ~F.coalesce("component", "id").eqNullSafe(F.coalesce("main", "centre")))
    labelled = materialize(labelled.select("centre", "id", "n", "diff", "out"), "smh-labelled")
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    counts = labelled.groupBy("centre").agg(blocks(F.col("out")).alias("outs"), blocks(~F.col("out")).alias("ins"), F.count("*").alias("c")) \
        .filter("outs > 0 and c > 1").drop("c")
    rows = salted_left_join(labelled, counts, ["centre"], F.col("id")).filter("outs is not null") \
        .withColumn("side", F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(upto("outs"), lambda o: unit(0, F.least(o, F.col("side")), F.greatest(o, F.col("side"))))
    across = F.when(F.col("ins") > 0, F.transform(upto("ins"), lambda o: unit(1, F.col("side"), o))).otherwise(F.array().cast(UNITS))
    inside = F.transform(upto("outs"), lambda o: unit(1, o, F.col("side")))
    rows = rows.withColumn("unit", F.explode(F.when(F.col("out"), F.concat(among, across)).otherwise(inside))) \
        .select("centre", "unit.*", "id", "n", "diff", (F.col("side") * 2 + F.col("out").cast("int")).alias("side"))
    keys = ["centre", "kind", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``."""
    sigs = materialize(signatures(docs, key, text, bands, rows), "smh-sigs")
    # Classes of equal sets; the hot one (a third of all rows may be copies) is a partial minimum and a salted join.
    same = ["set_a", "set_b", "n"]
    classes = sigs.filter("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    members = salted_left_join(sigs.select("id", *same), classes.filter("c > 1").select(*same, "rep"), same, F.col("id"))
    members = materialize(members.select("id", "n", F.coalesce("rep", "id").alias("rep")), "smh-members")
    # The sides of the joins below grow with the corpus: all are merge joins, at every size.
    reps = members.filter("id = rep and n > 0").select("id").distinct().hint("merge")
    buckets = sigs.join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band")).distinct()
    shared = buckets.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    buckets = materialize(buckets.join(shared.hint("merge"), "band"), "smh-buckets")
    # Full sets of the candidates, and how many shingles each shares with no other.
    wanted = buckets.select("id").distinct().hint("merge")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    sets = materialize(full_sets(texts).dropDuplicates(["id", "shingles"]), "smh-sets")
    own = sets.select("id", F.explode("shingles").alias("s")).groupBy("s") \
        .agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    sizes = sets.select("id", "n").join(own.hint("merge"), "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"))
    sizes = sizes.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * threshold)
    buckets = materialize(buckets.join(sizes.select("id", "own").hint("merge"), "id"), "smh-buckets")
    # Centre: the member with the fewest shingles of its own.
    centres = buckets.groupBy("band").agg(F.min(F.struct("own", "id")).alias("m"), F.count("*").alias("c")) \
        .filter("c > 1").select("band", F.col("m.id").alias("centre"))
    star = salted_left_join(buckets, centres, ["band"], F.col("id")).filter("id != centre").select("centre", "id").distinct()
    star = materialize(confirmed(materialize(star, "smh-star"), sets, threshold), "smh-confirmed")
    first = connected_components(star.filter("linked").select(F.col("centre").alias("a"), F.col("id").alias("b")))
    more = materialize(further_links(star, first, threshold), "smh-links")
    # Rows that repeat a key join their classes, too.
    ties = members.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    repeated = members.groupBy("id").agg(F.count_distinct("rep").alias("c")).filter("c > 1 and id is not null").select("id")
    more = more.union(materialize(ties.join(repeated, F.col("a") == F.col("id"), "left_semi"), "smh-ties"))
    # Without a further link the first components are the result already.
    groups = first if more.isEmpty() else \
        connected_components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    out = salted_left_join(members, groups.withColumnRenamed("id", "rep"), ["rep"], F.col("id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = KEEP_THRESHOLD, bands: int = KEEP_BANDS,
         rows: int = KEEP_ROWS) -> DataFrame:
    """One row of each group of similar texts, unchanged: the one with the smallest key.

    Rows are judged one by one: unlike texts under one key all stay.  Of a
    group's rows that repeat its smallest key one stays, chosen by hashes of
    its text and other columns.  Rows of one key whose texts hold no word
    are one group; rows without a key all stay.
    """
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    rest = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c not in (key, text)], F.lit(0).alias(own))))  # of any type
    docs = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "smh-rows")  # written, so the numbers stay
    named = docs.filter(F.col(key).isNotNull())
    found = near_duplicates(named, own, text, threshold, bands, rows).select(F.col(own).alias("row"), "n_shingles", "component_id")
    order = named.select(F.col(own).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"), rest.alias("rest"))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.concat(F.lit("key "), F.col("key").cast("string")))
    found = materialize(found.join(order.hint("merge"), "row").select("row", "key", "hash", "rest", group.alias("group")), "smh-groups")
    first = found.groupBy("group").agg(F.min(F.struct("key", "hash", "rest", "row")).alias("m"), F.count("*").alias("c")) \
        .filter("c > 1").select("group", F.col("m.row").alias("first"))
    dropped = salted_left_join(found, first, ["group"], F.col("row")).filter("row != first").select(F.col("row").alias(own))
    return docs.join(dropped.hint("merge"), own, "left_anti").drop(own)
