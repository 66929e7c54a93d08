"""Quality rules by distribution divergence (operator 6).

Two passes.  The first reads every whole text once and counts, per
document, the base figures, the characters by class and the common words of
its language.  The second makes each language's
references (a few dozen numbers, from all of its documents that pass the
base rules) and compares each document's histograms with them by
Jensen-Shannon distance.  A reference holds the median share of each class
or word, in thousandths, so junk does not move it.  A histogram of fewer
than a minimum of characters or words is not judged.

Documents of a language without a list of common words (or of none) are
held against the reference that is nearest to them.  While no document
passes the base rules there is no reference and nothing is judged.

Defined results: null and empty texts have no words, so they fail the base
rule; every row is judged by itself, also with a null or repeated key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import byte_values, text_bytes, windows, word_groups
from revlens.session import materialize

# Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that it on for was with as be by this are at from or an not which have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus sur pas au avec ce il se".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
SYMBOLS = "#*$%&|<>"
# Character classes by byte; letters beyond ASCII are counted by their first byte.
CLASSES = ["lower", "upper", "digit", "space", "stop", "mark", "symbol", "beyond_ascii", "control"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.19, 0.30


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("control"), np.int64)
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
                        ("space", " \t\n\r\x0b\x0c"), ("stop", ".,"), ("mark", "!?;:'\"()-"), ("symbol", "#*$%&|<>+=@[]\\^_`{}~/")):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    t[192:] = CLASSES.index("beyond_ascii")
    t[128:192] = len(CLASSES)  # later bytes of a character
    return t


_CLASS = _class_table()
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})


@lru_cache(maxsize=1)
def _vocabulary() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte values that ignore case and closing punctuation, sorted hashes of the common words, their places)."""
    values = byte_values(True).copy()
    values[[ord(c) for c in ".,!?;:'\"()-#*$%&|<>"]] = 0
    hashes = np.concatenate([h for _, _, _, h in word_groups(pa.array(VOCABULARY), table=values)])
    order = np.argsort(hashes)
    return values, hashes[order], order


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.encode().split(b"\n"):
        if line in seen:
            n += 1
        elif line.split():
            seen.add(line)
    return n


def _features(texts: pa.Array) -> dict[str, pa.Array]:
    values, known, order = _vocabulary()
    data, off = text_bytes(texts)
    out = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "words")}
    k, v, symbol = len(CLASSES), len(VOCABULARY), np.zeros(256, np.int64)
    symbol[[ord(c) for c in SYMBOLS]] = 1
    for (first, end, counts, h), (*_, plain) in zip(word_groups(texts, fold=False), word_groups(texts, table=values)):
        n = end - first
        part, size = data[off[first]:off[end]], np.diff(off[first:end + 1])
        doc, wdoc = np.repeat(np.arange(n), size), np.repeat(np.arange(n), counts)
        classes = np.bincount(doc * (k + 1) + _CLASS[part], minlength=n * (k + 1)).reshape(n, k + 1)
        chars = size - classes[:, k]
        # words in windows of three that are found twice or more
        wd, at, w3 = windows(counts, h, 3)
        by = np.lexsort((w3, wd))
        same = np.flatnonzero((w3[by][1:] == w3[by][:-1]) & (wd[by][1:] == wd[by][:-1]))
        repeat, again = np.zeros(len(h) + 2, bool), at[by[np.append(same, same + 1)]]
        for d in range(3):
            repeat[again + d] = True
        near = np.minimum(np.searchsorted(known, plain), v - 1)
        hit = known[near] == plain
        out["n_words"].append(counts)
        out["word_chars"].append(chars - classes[:, CLASSES.index("space")])
        out["n_symbols"].append(np.bincount(doc, symbol[part], minlength=n).astype(np.int64))
        out["n_dup_lines"].append([_dup_lines(t) for t in texts.slice(first, n).to_pylist()])
        out["n_repeat_words"].append(np.bincount(wdoc[repeat[:len(h)]], minlength=n))
        out["classes"].append(classes[:, :k])
        out["words"].append(np.bincount(wdoc[hit] * v + order[near[hit]], minlength=n * v).reshape(n, v))
    flat = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
    lists = {c: pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * w), pa.array(flat[c].reshape(-1)))
             for c, w in (("classes", k), ("words", v))}
    return {c: lists[c] if c in lists else pa.array(x.astype(np.int64)) for c, x in flat.items()}


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base figures and histograms of every row, in one pass over the whole texts."""
    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            f = _features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *f.values()], ["key", "lang", *f])

    return rows.mapInArrow(run, f"key {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, classes array<bigint>, words array<bigint>") \
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def references(feats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (class shares, common-word shares with the rest last): medians over its documents, in thousandths."""
    judged = feats.filter(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda c, n: F.percentile(F.floor(c * 1000 / n), F.lit(0.5))  # noqa: E731  at most 1001 distinct values each
    rows = judged.groupBy("lang").agg(
        F.array(*(share(F.col("classes")[i], chars) for i in range(len(CLASSES)))).alias("c"),
        F.array(*(share(F.col("words")[i], F.col("n_words")) for i in range(len(VOCABULARY)))).alias("w")).collect()  # a row a list
    found = {}
    for r in rows:
        words = np.array(r["w"])[_own(r["lang"])]
        found[r["lang"]] = (np.array(r["c"]), np.append(words, max(0.0, 1000 - words.sum())))
    return found


def _own(lang: str) -> list[int]:
    return [VOCABULARY.index(w) for w in COMMON_WORDS[lang]]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of the rows of ``p`` from ``q``, both as counts; 0 for a row without counts."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1e-300), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q)) / 2
    return np.where(p.sum(axis=1) > 0, np.sqrt(np.maximum(d, 0)), 0)


def _judged(langs: np.ndarray, classes: np.ndarray, words: np.ndarray, total: np.ndarray, failed: np.ndarray,
            refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distances from the class and word references, kept) of documents."""
    best = np.full((len(total), 2), np.inf)
    for lang, (rc, rw) in refs.items():
        mine = (langs == lang) | ~np.isin(langs, list(refs))
        own = words[mine][:, _own(lang)]
        own = np.column_stack([own, total[mine] - own.sum(axis=1)])
        d = np.column_stack([distance(classes[mine], rc), distance(own, rw)])
        best[mine] = np.where((d.sum(axis=1) < best[mine].sum(axis=1))[:, None], d, best[mine])
    best[~np.isfinite(best)] = 0
    far = ((best[:, 0] > MAX_CLASS_DISTANCE) & (classes.sum(axis=1) >= MIN_CHARS_JUDGED)
           | (best[:, 1] > MAX_WORD_DISTANCE) & (total >= MIN_WORDS_JUDGED))
    return best, ~far & ~failed


def _histograms(b: pa.RecordBatch | dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes, words = (np.array(b[c].flatten()).reshape(n, w) for c, w in (("classes", len(CLASSES)), ("words", len(VOCABULARY))))
    return classes, words, np.array(b["n_words"])


def judge(feats: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``feats`` (without histograms) with class_distance, word_distance and kept."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

    def run(batches):
        for b in batches:
            d, kept = _judged(np.array(b.column("lang").to_pylist(), object), *_histograms(b, b.num_rows),
                              np.array(b.column("base_failed").to_numpy(zero_copy_only=False), bool), refs)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(b.column(c) for c in base), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(kept)],
                                             ["key", *base, "class_distance", "word_distance", "kept"])

    kind = feats.schema["key"].dataType.simpleString()
    return feats.mapInArrow(run, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean")


def keep(docs: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged; they are counted anew, so no row has to be found by its key."""
    t, at = docs.columns.index(text), docs.columns.index(lang)

    def run(batches):
        for b in batches:
            f = _features(b.column(t))
            total, repeats = np.array(f["n_words"]), np.array(f["n_repeat_words"])
            failed = (total < MIN_WORDS) | (repeats * 100 > total * MAX_REPEAT_PERCENT)
            langs = np.array(b.column(at).cast(pa.string()).to_pylist(), object)
            yield b.filter(pa.array(_judged(langs, *_histograms(f, b.num_rows), failed, refs)[1]))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, base figures, base_failed, class_distance, word_distance, kept) of every row."""
    feats = materialize(features(docs, key, text, lang), "rules-features")
    return judge(feats, references(feats)).withColumnRenamed("key", key)
