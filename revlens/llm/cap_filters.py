"""Near-duplicate embeddings by spherical-cap filters (operator 10).

1. equal vectors form a class, one of which goes on;
2. filter directions are codewords of ``CODES`` random product codes: a
   codeword joins one word for each part (two parts, more for very many
   vectors) of the randomly turned space.  A vector is list-decoded to all
   codewords within the cap, from the sorted scores of its parts, without
   going through the product;
3. vectors that share a filter are compared in double precision.  A bucket
   is cut into blocks, and each pair of blocks is a unit of work of bounded
   size.  A pair counts in the smallest filter that both have, so it counts
   once.  Only sums and links to the local root leave a unit, never pairs;
4. the links are joined into components.

The cap and the size of the codes follow from the number of vectors by one
rule: about ``BUCKET`` unrelated vectors in a cap, and ``SHARED`` filters
expected in common at the threshold, for any number of vectors: where two
parts would need more than ``WORDS`` words each, codes have one part more,
and there are four times as many codes.  Many small codes rather than a few large ones, since the codewords of one
code come in clusters; measured at the threshold itself, about 2 pairs in
1,000 to 12 in 1,000 (3 million vectors) share no filter, and nearer pairs
are missed less often.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and rows without an id, link with nothing.  Vectors
of different dimension do not compare.  Every row is a vertex, also if its
id repeats; a null id gives a null component and is kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import roots, salted_left_join, units
from revlens.llm.components import connected_components
from revlens.session import materialize

THRESHOLD = 0.9
CODES, BUCKET, SHARED = 32, 256, 8.0
WORDS = 1 << 11  # words of a part, at most
WIDEST = 0.005  # share of the sphere in a cap, at most
PLAIN_BELOW = 8  # dimensions from which filters pay; below, all vectors share one bucket
BLOCK = 1_024


# ---------------------------------------------------------------- filters

def _tail(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid of t and P(<x, c> >= t) for a random unit vector in d dimensions."""
    t = np.linspace(-1, 1, 20_001)
    density = np.power(np.maximum(1 - t * t, 1e-300), (d - 3) / 2)
    tail = np.cumsum(density[::-1])[::-1]
    return t, tail / tail[0]


@lru_cache(maxsize=64)
def parameters(n: int, d: int, threshold: float = THRESHOLD) -> tuple[float, int, int, int]:
    """(cap height, codes, parts of a code, words of a part) for ``n`` vectors of ``d`` dimensions.

    Raises where the codes cannot give ``SHARED`` filters in common: the
    dimensions are too few for the parts, or the filters too many to number.
    """
    t, tail = _tail(d)
    share = min(WIDEST, BUCKET / max(n, 1))
    at = np.searchsorted(-tail, -share)
    height = float(t[at])
    # Chance that a second vector at the threshold is in the cap of a first: mean over the first's place in the cap.
    t2, tail2 = _tail(d - 1)
    s = t[t >= height][:-1]
    need = (height - threshold * s) / np.sqrt((1 - threshold ** 2) * (1 - s * s))
    weight = np.power(1 - s * s, (d - 3) / 2)
    joint = float((np.interp(need, t2, tail2, left=1, right=0) * weight).sum() / weight.sum()) * share
    if not joint > 0:
        raise ValueError(f"no cap for {n} vectors of {d} dimensions at {threshold}")
    parts, codes = 2, CODES
    while SHARED / (codes * joint) > float(WORDS) ** parts:
        parts, codes = parts + 1, codes * 4
    words = int(max(4, np.ceil((SHARED / (codes * joint)) ** (1 / parts))))
    if parts > d // 4 and parts > 2 or (d + 1) * codes * words ** parts >= 1 << 63:
        raise ValueError(f"{SHARED / joint:.2g} codewords cannot be made of {d} dimensions")
    return height, codes, parts, words


def shared_filters(n: int, d: int, threshold: float = THRESHOLD) -> float:
    """Filters that a pair at the threshold is expected to have in common, with the parameters for ``n`` vectors."""
    height, codes, parts, words = parameters(n, d, threshold)
    t, tail = _tail(d)
    t2, tail2 = _tail(d - 1)
    s = t[t >= height][:-1]
    need = (height - threshold * s) / np.sqrt((1 - threshold ** 2) * (1 - s * s))
    weight = np.power(1 - s * s, (d - 3) / 2)
    second = float((np.interp(need, t2, tail2, left=1, right=0) * weight).sum() / weight.sum())
    return codes * float(words) ** parts * second * float(np.interp(height, t, tail))


@lru_cache(maxsize=8)
def _codes(d: int, codes: int, parts: int, words: int) -> list[tuple[np.ndarray, ...]]:
    """Per code: a random turn of the space and the words of its parts, as columns."""
    edges = [d * k // parts for k in range(parts + 1)]
    out = []
    for c in range(codes):
        rng = np.random.default_rng([c, d, words])
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        own = []
        for k in np.diff(edges):
            w = rng.standard_normal((k, words))
            own.append(w / np.linalg.norm(w, axis=0) * np.sqrt(k / d))
        out.append((turn, *own))
    return out


def filters_of(x: np.ndarray, n: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of unit vectors ``x``, sorted, for a table of ``n`` vectors of their dimension."""
    d = x.shape[1]
    if d < PLAIN_BELOW:
        return np.arange(len(x)), np.full(len(x), d << 32, np.int64)
    height, codes, parts, words = parameters(n, d, threshold)
    edges = [d * k // parts for k in range(parts + 1)]
    rows, found = [], []
    for c, (turn, *own) in enumerate(_codes(d, codes, parts, words)):
        y = x @ turn
        scores = [y[:, a:e] @ w for a, e, w in zip(edges, edges[1:], own)]
        best = np.stack([s.max(axis=1) for s in scores])
        rest = np.cumsum(best[::-1], axis=0)[::-1]  # what the parts from k on can add
        r, code = np.nonzero(scores[0] + rest[1][:, None] >= height)  # words of the first part that the others can complete
        held = scores[0][r, code]
        for k in range(1, parts):
            order = np.argsort(-scores[k], axis=1)
            sorted_ = np.take_along_axis(scores[k], order, axis=1)
            after = rest[k + 1] if k + 1 < parts else np.zeros(len(x))
            on, at, new = np.arange(len(r)), 0, []
            while len(on) and at < words:  # the next best word, as long as the cap can be reached
                on = on[held[on] + sorted_[r[on], at] + after[r[on]] >= height]
                new.append((on, order[r[on], at], sorted_[r[on], at]))
                at += 1
            if new:
                at, word, score = (np.concatenate(v) for v in zip(*new))
                r, code, held = r[at], code[at] * words + word, held[at] + score
        rows.append(r)
        found.append((d * codes + c) * words ** parts + code)
    row, f = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (rows, found))
    by = np.lexsort((f, row))
    return row[by], f[by]


def _unit(vectors: list[bytes], kind: str, d: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(-1, d).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def memberships(classes: DataFrame, sizes: dict[int, int], threshold: float, whole: bool) -> DataFrame:
    """A row per vector and filter; with ``whole`` it holds what a comparison needs, the list of its filters included."""
    def run(batches):
        for b in batches:
            lists = b.column("vector")
            dims = np.diff(np.array(lists.offsets))
            kind = "<f4" if lists.type.value_type == pa.float32() else "<f8"
            flat, off = np.asarray(lists.values), np.array(lists.offsets)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = [flat[off[i]:off[i + 1]].astype(kind).tobytes() for i in at]
                for s in range(0, len(at), 512):
                    row, f = filters_of(_unit(x[s:s + 512], kind, d), sizes[d], threshold)
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(f)], ["filter"])
                        continue
                    of, places = at[s + row], np.searchsorted(row, np.arange(len(x[s:s + 512]) + 1))
                    own = [f[a:e].tobytes() for a, e in zip(places, places[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f), b.column("cls").take(pa.array(of)), b.column("c").take(pa.array(of)),
                         pa.array([x[s + r] for r in row], pa.binary()), pa.array([own[r] for r in row], pa.binary())],
                        ["filter", "cls", "c", "vector", "filters"])

    return classes.mapInArrow(run, "filter long, cls long, c long, vector binary, filters binary" if whole else "filter long")


# ---------------------------------------------------------------- comparison

def compare_unit(f: int, side: np.ndarray, cls: np.ndarray, c: np.ndarray, x: np.ndarray, own: list[np.ndarray],
                 threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, linked vectors, root's place) of the linked places of one unit: links within it (one side) or across its two sides."""
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side != side.min())
    near = x[left] @ x[right if len(right) else left].T >= threshold
    p, q = np.nonzero(near if len(right) else np.triu(near, 1))
    p, q = left[p], (right if len(right) else left)[q]
    # Pairs that share a smaller filter count there.
    lower = [o[o < f] for o in own]
    ids, place = np.unique(np.concatenate(lower), return_inverse=True)
    if len(ids) and len(p):
        bits = np.zeros((len(own), len(ids) // 64 + 1), np.uint64)
        row = np.repeat(np.arange(len(own)), [len(o) for o in lower])
        np.bitwise_or.at(bits, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        here = np.concatenate([~(bits[p[s:s + 8192]] & bits[q[s:s + 8192]]).any(axis=1) for s in range(0, len(p), 8192)])
        p, q = p[here], q[here]
    links = np.bincount(p, c[q], len(cls)) + np.bincount(q, c[p], len(cls))
    on = np.flatnonzero(links)
    return on, links[on].astype(np.int64), roots(len(cls), p, q)[on]


def _compare(kind: str, threshold: float):
    size = 4 if kind == "<f4" else 8

    def run(batches):
        for t in units(batches, ["filter", "i", "j"]):
            side = t.column("side").to_numpy()
            if t.num_rows < 2 or (t.column("i")[0] != t.column("j")[0] and (side == side[0]).all()):
                continue  # nothing to compare
            vectors = t.column("vector").to_pylist()
            x, cls = _unit(vectors, kind, len(vectors[0]) // size), t.column("cls").to_numpy()
            own = [np.frombuffer(o, np.int64) for o in t.column("filters").to_pylist()]
            on, links, root = compare_unit(t.column("filter")[0].as_py(), side, cls, t.column("c").to_numpy(), x, own, threshold)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(cls[on]), pa.array(links), pa.array(cls[root])], ["cls", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``."""
    v = F.col("vector")
    sound = (F.col("id").isNotNull() & v.isNotNull()
             & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
             & F.exists(v, lambda e: e != 0))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")) \
        .withColumn("cls", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.xxhash64("vector"), "vector")))
    kind = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    classes = materialize(rows.filter("cls is not null").groupBy("cls").agg(
        F.min("id").alias("rep"), F.count("*").alias("c"), F.first("vector").alias("vector")), "caps-classes")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    counts = memberships(classes, sizes, threshold, False).groupBy("filter").agg(F.count("*").alias("n")) \
        .filter("n > 1").select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = memberships(classes, sizes, threshold, True).join(counts, "filter") \
        .withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = own.withColumn("other", other).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")) \
        .select("filter", "i", "j", "side", "cls", "c", "vector", "filters") \
        .repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found = materialize(units.mapInArrow(_compare(kind, threshold), "cls long, links long, root long"), "caps-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    # The right sides grow with the vectors: all are merge joins, at every size.  Spark sizes a table read
    # back by its compressed files, and the salted one without its copies.
    groups = materialize(classes.select("cls", "rep", "c").join(links.hint("merge"), "cls", "left")
                         .join(groups.withColumnRenamed("id", "cls").hint("merge"), "cls", "left")
                         .select("cls", "rep", F.coalesce("component", "cls").alias("component"),
                                 (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links")), "caps-groups")
    least = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    groups = salted_left_join(groups, least.hint("merge"), ["component"], F.col("cls"))
    out = salted_left_join(rows.select("id", "cls"), groups.select("cls", "n_links", "component_id").hint("merge"), ["cls"], F.col("id"))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
