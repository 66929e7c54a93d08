"""Phrase collocation mining by top-order marginalisation (operator 11).

Phrases of 2 to ``ORDER`` words are counted without an explosion per length.
Each word leads one window: itself and the next words of its piece, padded
at the piece's end.  Only these longest windows are counted; the frequency
of a shorter phrase is the sum over the windows that it begins, and Spark's
ROLLUP over (lang, w1, w2, ...) gives all prefixes at once.  Its last level
but one is the number of all words of a language.

1. *Count.*  A task sorts and counts the windows of a group of documents and
   deals them to ranges of the window order, whose bounds come from a sample
   of texts.  The sample decides nothing but the sizes of the ranges.
2. *Fold.*  A range merges its windows.  Windows of a prefix that lies within
   the range and occurs fewer than ``min_count`` times cannot lead to a
   candidate: they are folded into the next shorter prefix.  The first and
   the last prefix of each length may go on in a neighbour range and are kept.
3. *ROLLUP* over the folded windows, which are few, joins the ranges and
   gives the exact frequency of every phrase that occurs often enough.

No group is dealt by a phrase, so a frequent pair of words or one language
that holds most of the text is spread over many ranges; a window is one row
per group of documents however often it occurs.

Scores follow from joins of the candidates with the frequent phrases: salted,
since one word begins many candidates, and merge joins at every size, since
Spark sizes the phrases by their compressed files and without what is
exploded from them.  All arithmetic is in integers or decimals without
fractions.

Defined results: a null or empty text has no words; a null lang is ``und``
(and shares its figures with rows that say so).  Keys are not read: repeated
rows count as often as they occur.  Other columns are not read, whatever
their names.  Very long texts are read whole, one at a time.  Ties in score
and frequency are ranked by the phrase's UTF-8 bytes.  An empty table gives
no rows.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import salted_left_join, text_bytes
from revlens.session import materialize

ORDER = 4
MIN_COUNT = 30
COVER_PERCENT = 80  # a phrase is dropped if a longer candidate holds it with at least this share of its frequency
TOP = 2_000
UNKNOWN = "und"
GROUP_BYTES = 1 << 22  # text whose windows are counted together, about; a longer text stands alone
RANGE_WINDOWS = 1_000_000  # windows of a range, about
SAMPLE_DOCS, SAMPLE_WINDOWS = 10_000, 8  # texts that place the ranges, about, and windows of each

_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- windows

def words_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(words, document of each, whether the next word follows in the same piece) of texts' bytes."""
    apart = _SPACE[data] | _STOP[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    inside = ~apart
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    if not len(starts):
        return pa.array([], pa.large_string()), starts, np.zeros(0, bool)
    doc = np.searchsorted(off, starts, "right") - 1
    where = np.concatenate(([0], np.cumsum(inside)))  # place of a byte among the bytes of words
    at = np.append(where[starts], where[-1])
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))[starts]
    goes_on = np.append((stops[1:] == stops[:-1]) & (doc[1:] == doc[:-1]), False)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]]))
    return words, doc, goes_on


class Windows:
    """Distinct windows in ascending order with their counts: ``words`` ascending (the padding, '', first), codes into them."""

    def __init__(self, langs: list[str], words: list[str], lang: np.ndarray, codes: np.ndarray, count: np.ndarray):
        self.langs, self.words, self.lang, self.codes, self.count = langs, words, lang, codes, count

    def merged(self) -> Windows:
        # as many columns as fit into one number are sorted together
        keys, room = [self.lang.astype(np.int64)], 63 - max(1, len(self.langs)).bit_length()
        bits = max(1, len(self.words)).bit_length()
        for c in self.codes:
            if room < bits:
                keys.append(np.zeros(len(c), np.int64))
                room = 63
            keys[-1] = keys[-1] << bits | c
            room -= bits
        order = np.lexsort(keys[::-1])
        del keys
        lang, codes, count = self.lang[order], self.codes[:, order], self.count[order]
        new = np.ones(len(lang), bool)
        new[1:] = (lang[1:] != lang[:-1]) | (codes[:, 1:] != codes[:, :-1]).any(axis=0)
        at = np.flatnonzero(new)
        return Windows(self.langs, self.words, lang[at], codes[:, at], np.add.reduceat(count, at) if len(at) else count)

    def key(self, i: int) -> tuple[bytes, ...]:
        """A window's place in the order: language and words, by their bytes."""
        return (self.langs[self.lang[i]].encode(), *(self.words[c].encode() for c in self.codes[:, i]))

    def pack(self, lo: int, hi: int) -> bytes:
        """The windows ``lo:hi`` with the words that they use, compressed."""
        codes = self.codes[:, lo:hi]
        on = np.zeros(len(self.words), bool)
        on[codes] = True
        used, local = np.flatnonzero(on), (np.cumsum(on) - 1)[codes]
        words = " ".join(self.words[c] for c in used.tolist()).encode()  # no word holds a space
        langs = json.dumps(self.langs).encode()
        head = struct.pack("<5q", hi - lo, len(codes), len(used), len(langs), len(words))
        body = b"".join((langs, words, self.lang[lo:hi].astype("<u4").tobytes(), local.reshape(codes.shape).astype("<u4").tobytes(),
                         self.count[lo:hi].astype("<i8").tobytes()))
        return head + struct.pack("<q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(blob: bytes) -> Windows:
        n, order, n_words, n_langs, n_bytes, size = struct.unpack_from("<6q", blob)
        body = pa.decompress(blob[48:], decompressed_size=size, codec="zstd", asbytes=True)
        langs, at = json.loads(body[:n_langs]), n_langs + n_bytes
        words = body[n_langs:at].decode().split(" ")
        assert len(words) == n_words or not n
        lang = np.frombuffer(body, "<u4", n, at).astype(np.int32)
        codes = np.frombuffer(body, "<u4", n * order, at + 4 * n).astype(np.int32).reshape(order, n)
        return Windows(langs, words, lang, codes, np.frombuffer(body, "<i8", n, at + 4 * n * (1 + order)))

    @staticmethod
    def join(parts: list[Windows]) -> Windows:
        """All windows of several lots, merged."""
        langs, words = sorted({x for p in parts for x in p.langs}), pa.chunked_array([pa.array(p.words, pa.large_string()) for p in parts])
        words, code = _ordered(words.combine_chunks())
        lang, codes, at = [], [], 0
        for p in parts:
            codes.append(code[at: at + len(p.words)][p.codes])
            lang.append(np.array([langs.index(x) for x in p.langs], np.int32)[p.lang])
            at += len(p.words)
        return Windows(langs, words, np.concatenate(lang), np.concatenate(codes, axis=1), np.concatenate([p.count for p in parts])).merged()


def _ordered(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """(distinct words ascending by their bytes, with '' first; the number of each given word among them)."""
    found = words.dictionary_encode()
    names = found.dictionary
    if "" not in (own := names.to_pylist()):
        own.append("")
        names = pa.array(own, pa.large_string())
    order = np.asarray(pa.compute.sort_indices(names.cast(pa.large_binary())))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return names.take(pa.array(order)).to_pylist(), rank[np.asarray(found.indices)]


def leads(data: np.ndarray, off: np.ndarray, lang_of: list[str], order: int) -> tuple[Windows, np.ndarray]:
    """The padded window that every word leads (each counted once, in text order), and its document."""
    words, doc, goes_on = words_of(data, off)
    names, code = _ordered(words)
    codes = np.zeros((order, len(code)), np.int32)
    codes[0] = code
    on = np.ones(len(code), bool)
    for k in range(1, order):  # the word k places on, while the piece goes on
        on = on & np.append(goes_on[k - 1:], np.zeros(min(k - 1, len(code)), bool))[: len(code)]
        codes[k, : len(code) - k] = np.where(on[: len(code) - k], code[k:], 0) if len(code) > k else 0
    langs = sorted(set(lang_of))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in lang_of], np.int32)[doc] if len(doc) else np.zeros(0, np.int32)
    return Windows(langs, names, lang, codes, np.ones(len(code), np.int64)), doc


def _groups(batches: Iterator[pa.RecordBatch], order: int, group_bytes: int) -> Iterator[tuple[Windows, np.ndarray]]:
    """``leads`` of groups of consecutive rows (lang, text)."""
    for b in batches:
        data, off = text_bytes(b.column(1))
        langs, at = b.column(0).to_pylist(), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + group_bytes, "right")) - 1)
            yield leads(data[off[at]: off[to]], off[at:to + 1] - off[at], langs[at:to], order)
            at = to


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))


def range_bounds(rows: DataFrame, order: int, range_windows: int) -> list[tuple[bytes, ...]]:
    """First windows of the ranges after the first, from ``SAMPLE_WINDOWS`` windows of about ``SAMPLE_DOCS`` texts."""
    n_docs = rows.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    picked = rows.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches):
        for w, doc in _groups(batches, order, GROUP_BYTES):
            at = np.searchsorted(doc, np.arange(int(doc.max(initial=-1)) + 2))
            for a, e in zip(at[:-1].tolist(), at[1:].tolist()):
                step = max(1, (e - a) // SAMPLE_WINDOWS)
                found = [w.key(i) for i in range(a, e, step)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary())), pa.array([(e - a) / len(found)] * len(found))],
                                                     ["key", "weight"])

    # copies of a text are picked together: equal windows are added up first, so that what is collected is bounded by the sample's size
    found = picked.mapInArrow(run, "key array<binary>, weight double").groupBy("key").agg(F.sum("weight").alias("weight"))
    got = sorted((tuple(bytes(x) for x in r["key"]), r["weight"]) for r in found.collect())
    total = sum(x for _, x in got) / share
    n = -(-int(total) // range_windows)
    bounds, held = [], 0.0
    for k, x in got:
        if held * n >= (len(bounds) + 1) * total * share and (not bounds or k > bounds[-1]):
            bounds.append(k)
        held += x
    return bounds


def counted(rows: DataFrame, bounds: list[tuple[bytes, ...]], order: int, group_bytes: int) -> DataFrame:
    """(part, windows): the counted windows of groups of documents, dealt to the ranges."""
    def run(batches):
        for w, _ in _groups(batches, order, group_bytes):
            w = w.merged()
            keys = _Keys(w)
            cut = [0, *(bisect_left(keys, b) for b in bounds), len(keys)]
            parts = [p for p in range(len(cut) - 1) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([w.pack(cut[p], cut[p + 1]) for p in parts], pa.binary())],
                                             ["part", "windows"])

    return rows.mapInArrow(run, "part int, windows binary")


class _Keys:
    """The windows' keys as a sequence, made where looked at."""

    def __init__(self, w: Windows):
        self.w = w

    def __len__(self) -> int:
        return len(self.w.lang)

    def __getitem__(self, i: int) -> tuple[bytes, ...]:
        return self.w.key(i)


def folded(w: Windows, min_count: int, alone: bool = False) -> Windows:
    """Windows of rare prefixes, folded into the next shorter one; prefixes that may go on in a neighbour range are kept.

    ``alone``: there is no neighbour.
    """
    n = len(w.lang)
    if not n:
        return w
    keep = np.zeros(n, np.int32)  # words that a window keeps
    level = np.concatenate(([True], w.lang[1:] != w.lang[:-1]))
    for k, c in enumerate(w.codes, 1):
        level = level | np.concatenate(([True], c[1:] != c[:-1]))
        at = np.flatnonzero(level)
        size = np.add.reduceat(w.count, at)
        stays = size >= min_count
        if not alone:
            stays[[0, -1]] = True
        keep[np.repeat(stays, np.diff(np.append(at, n))) & (keep == k - 1)] = k
    codes = np.where(np.arange(len(w.codes), dtype=np.int32)[:, None] < keep, w.codes, np.int32(0))
    return Windows(w.langs, w.words, w.lang, codes, w.count).merged()


def _fold(min_count: int, alone: bool):
    def run(table: pa.Table) -> pa.Table:
        w = folded(Windows.join([Windows.unpack(b) for b in table.column("windows").to_pylist()]), min_count, alone)
        names, langs = pa.array(w.words, pa.string()), pa.array(w.langs, pa.string())
        return pa.table([langs.take(pa.array(w.lang)), *(names.take(pa.array(c)) for c in w.codes), pa.array(w.count)],
                        names=["lang", *(f"w{k + 1}" for k in range(len(w.codes))), "n"])
    return run


# ---------------------------------------------------------------- phrases

def phrase_counts(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang",
                  group_bytes: int = GROUP_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """lang, words (number), phrase, f: every phrase of up to ``order`` words that occurs ``min_count`` times, and per lang one row of 0 words, all word occurrences."""
    rows = _rows(docs, text, lang)
    bounds = range_bounds(rows, order, range_windows)
    w = [f"w{k + 1}" for k in range(order)]
    schema = ", ".join(["lang string", *(f"{c} string" for c in w), "n long"])
    windows = counted(rows, bounds, order, group_bytes).groupBy("part").applyInArrow(_fold(min_count, not bounds), schema)
    sums = windows.rollup("lang", *w).agg(F.sum("n").alias("f"), F.grouping_id().alias("_g"))
    # grouping_id has one bit for each column summed over, the last column's lowest
    level: Column = F.lit(None).cast("int")
    for k in range(order + 1):
        whole = F.lit(True) if k == 0 else F.col(w[k - 1]) != ""
        level = F.when((F.col("_g") == (1 << (order - k)) - 1) & whole, F.lit(k)).otherwise(level)
    return sums.withColumn("words", level).filter((F.col("words") == 0) | (F.col("words").isNotNull() & (F.col("f") >= min_count))) \
        .select("lang", "words", F.concat_ws(" ", *[F.when(F.col("words") > k, F.col(c)) for k, c in enumerate(w)]).alias("phrase"), "f")


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, cover: int = COVER_PERCENT, top: int = TOP,
                 text: str = "text", lang: str = "lang", group_bytes: int = GROUP_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    counts = materialize(phrase_counts(docs, order, min_count, text, lang, group_bytes, range_windows), "phrases")
    phrases = counts.filter("words > 0").select("lang", "phrase", "f")
    found = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = found.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for c, name in (("head", "l"), ("rest", "r")):
        own = phrases.select("lang", F.col("phrase").alias(c), F.col("f").alias(name)).hint("merge")
        cuts = salted_left_join(cuts, own, ["lang", c], F.col("phrase"))
    scored = cuts.withColumn("l", _whole("l")).withColumn("r", _whole("r")) \
        .withColumn("score", F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (l + r)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    # the most frequent longer candidate around a phrase: all shorter runs of its words
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    covers = found.filter("words > 2").select("lang", F.explode(runs).alias("phrase"), F.col("a").alias("_f")) \
        .groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = worst.join(covers.hint("merge"), ["lang", "phrase"], "left") \
        .filter(F.col("_f").isNull() | (_whole("_f") * 100 < _whole("a") * cover)).drop("_f")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("l").cast("long").alias("l"),
        F.col("r").cast("long").alias("r"), "n", F.col("score").cast("long").alias("score"))
