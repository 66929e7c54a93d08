"""Quality classifier by nearest-neighbour voting (operator 8).

1. every document becomes counts of hashed words, of pairs of character
   classes, and of a few shapes (length, repeated words);
2. latent semantic analysis of a bounded sample of labelled documents:
   counts are damped and weighted by inverse document frequency, and a
   truncated singular value decomposition gives the latent axes;
3. the labelled vectors are broadcast: ``MAX_LABELLED`` rows of ``RANK``
   numbers at most, however large the corpus.  Each task computes the exact
   cosines of its documents with all of them, a block at a time;
4. the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity.

Only the text enters a score.  The sample is the labelled training rows
with the smallest hash of their key; ``MAX_LABELLED`` bounds it.

Defined results: null and empty texts have a length of 0 as their only
feature and are scored like any others.  A document similar to no labelled
one, or without any labelled rows at all, gets the share of label 1 in the
sample (0.5 if there is none).  Every input row is scored, also with a null
or repeated key.  Labels other than 0 and 1 and null keys are not used; of
several labels for one key the smallest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import GOLDEN, U, byte_values, held_fold, mix, text_bytes, windows, word_groups

FOLDS = 5  # one of them is held out
MAX_LABELLED = 6_000
WORDS, RANK, NEIGHBOURS, BLOCK = 2_048, 64, 25, 512
THRESHOLD = 0.3

_KINDS = 9
_KIND = np.zeros(256, np.int64)  # character classes by byte
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,", "!?;:'\"()-",
                             "#*$%&|<>+=@[]\\^_`{}~/")):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 8
_SHAPES = 48  # length by powers of two, then repeated words, repeated triples and words like the one before, by tenths
WIDTH = WORDS + _KINDS * _KINDS + _SHAPES
_PLAIN = byte_values(True).copy()
_PLAIN[[ord(c) for c in ".,!?;:'\"()-#*$%&|<>"]] = 0  # closing punctuation does not make another word
#: Weight of each block of features after it is scaled to unit length.
_BLOCKS = ((0, WORDS, 1.0), (WORDS, WORDS + _KINDS * _KINDS, 1.5), (WORDS + _KINDS * _KINDS, WIDTH, 1.0))


def _repeats(docs: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many of each document's items were found before in it."""
    order = np.lexsort((h, docs))
    d, x = docs[order], h[order]
    return np.bincount(d[1:][(d[1:] == d[:-1]) & (x[1:] == x[:-1])], minlength=n)


def counts(texts: pa.Array):
    """Yields (first, end, counts): float32 feature counts of consecutive documents, up to ``BLOCK`` at a time."""
    data, off = text_bytes(texts)
    for first, end, n_words, h in word_groups(texts, table=_PLAIN):
        ends = np.cumsum(n_words)
        for a in range(first, end, BLOCK):
            b = min(end, a + BLOCK)
            n, lo, hi = b - a, int(ends[a - first] - n_words[a - first]), int(ends[b - first - 1])
            words, size = n_words[a - first:b - first], np.diff(off[a:b + 1])
            doc, wh = np.repeat(np.arange(n), words), h[lo:hi]
            x = np.zeros((n, WIDTH), np.float32)
            x[:, :WORDS] = np.bincount(doc * WORDS + (mix(wh + GOLDEN) % U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
            part, bdoc, pairs = data[off[a]:off[b]], np.repeat(np.arange(n), size), _KINDS * _KINDS
            if len(part) > 1:
                k = _KIND[part]
                same = bdoc[1:] == bdoc[:-1]
                at = bdoc[:-1] * pairs + k[:-1] * _KINDS + k[1:]
                x[:, WORDS:WORDS + pairs] = np.bincount(at[same], minlength=n * pairs).reshape(n, pairs)
            base, row, total = WORDS + pairs, np.arange(n), np.maximum(words, 1)
            x[row, base + np.minimum(np.ceil(np.log2(words + 1)).astype(int), 14)] = 1
            wd, _, triples = windows(words, wh, 3)
            before = np.bincount(doc[1:][(wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(wh) else np.zeros(n, int)
            for i, found in enumerate((_repeats(doc, wh, n), _repeats(wd, triples, n), before)):
                x[row, base + 15 + 11 * i + found * 10 // total] = np.where(words > 0, 1, 0)
            yield a, b, x


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, each block of features scaled to its weight."""
    x = np.log1p(x) * idf
    for a, b, w in _BLOCKS:
        x[:, a:b] *= w / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


@dataclass
class Model:
    """idf, latent axes (WIDTH x rank), unit vectors and labels of the labelled sample, share of label 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def train(x: np.ndarray, y: np.ndarray, rank: int = RANK) -> Model:
    """The model of labelled feature counts ``x``; the singular vectors are found by subspace iteration from a fixed start."""
    if not len(y):
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    w = np.empty(x.shape, np.result_type(x, idf))
    for a in range(0, len(x), BLOCK):  # the driver holds the counts and their weights, no third copy
        w[a:a + BLOCK] = weigh(x[a:a + BLOCK], idf)
    q = np.random.default_rng(0).standard_normal((WIDTH, min(rank + 16, len(w)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    _, _, vt = np.linalg.svd(w @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :rank].astype(np.float32)
    return Model(idf, axes, latent(w, axes), y.astype(np.float32), float(y.mean()))


def latent(weighed: np.ndarray, axes: np.ndarray) -> np.ndarray:
    v = weighed @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def vote(model: Model, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of feature counts: similarity-weighted share of label 1 among the nearest labelled vectors."""
    if not len(model.labels):
        return np.full(len(x), model.prior)
    cos = latent(weigh(x, model.idf), model.axes) @ model.vectors.T
    k = min(neighbours, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** 4
    total = w.sum(axis=1)
    return np.where(total > 0, (w * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), model.prior)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        most: int = MAX_LABELLED) -> Model:
    """Train on the labelled rows outside the held-out fold, ``most`` of them at most."""
    usable = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & (held_fold(F.col("k"), FOLDS) != 0))
    chosen = usable.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    # At most ``most`` rows, so the join with the documents is a broadcast and moves no text.
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", "t")

    def run(batches):
        for b in batches:
            for first, end, x in counts(b.column("t")):
                cells = (np.flatnonzero(v).astype("<i4") for v in x)
                rows = [i.tobytes() + v[i].astype("<f4").tobytes() for i, v in zip(cells, x)]
                yield pa.RecordBatch.from_arrays([b.column("k").slice(first, end - first), b.column("y").slice(first, end - first),
                                                  pa.array(rows, pa.binary())], ["k", "y", "x"])

    kind = texts.schema["k"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"k {kind}, y int, x binary").groupBy("k", "y").agg(F.min("x").alias("x")).orderBy("k").collect()
    x = np.zeros((len(rows), WIDTH), np.float32)
    for r, row in enumerate(rows):
        n = len(row["x"]) // 8
        x[r, np.frombuffer(row["x"], "<i4", n)] = np.frombuffer(row["x"], "<f4", n, 4 * n)
    y = np.array([r["y"] for r in rows], np.int64)
    rows.clear()  # the driver's memory is needed for the decomposition
    return train(x, y)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = [vote(sent.value, x) for _, _, x in counts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], ["key", "score"])

    found = rows.mapInArrow(run, f"key {kind}, score double")
    return found.select(F.col("key").alias(key), (held_fold(F.col("key"), FOLDS) == 0).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, unchanged."""
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for first, end, x in counts(b.column(at)):
                yield b.slice(first, end - first).filter(pa.array(vote(sent.value, x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    return score(docs, fit(docs, labels, key, text, label), key, text)
