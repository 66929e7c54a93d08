"""Quality rules against a brute-force version on Python strings."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlens.llm import quality_rules as qr
from revlens.llm import queries
from tests.conftest import SF0001, SF001

STRIP = ".,!?;:'\"()-#*$%&|<>"


def base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    wins = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if wins[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


def histograms(text):
    text = text or ""
    kinds = Counter()
    for ch in text:
        kinds[qr.CLASSES[qr._CLASS[ch.encode()[0]]]] += 1
    lower = [w.translate({c: c + 32 for c in range(65, 91)}).rstrip(STRIP) for w in (x.decode() for x in text.encode().split())]
    return np.array([kinds[c] for c in qr.CLASSES]), Counter(lower)


def jsd(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def brute(rows):
    facts = [(k, lang, base(t), *histograms(t)) for k, t, lang in rows]
    shares = defaultdict(list)
    for _, lang, b, kinds, words in facts:
        if not b[-1]:
            shares[lang].append((np.floor(kinds * 1000 / kinds.sum()),
                                 np.floor(np.array([words[w] for w in qr.COMMON_WORDS[lang]]) * 1000 / b[0])))
    refs = {}
    for lang, s in shares.items():
        w = np.median([y for _, y in s], axis=0)
        refs[lang] = (np.median([x for x, _ in s], axis=0), np.append(w, 1000 - w.sum()))
    out = {}
    for k, lang, b, kinds, words in facts:
        kept = not b[-1]
        if kept:
            own = [words[w] for w in qr.COMMON_WORDS[lang]]
            kept = not (kinds.sum() >= qr.MIN_CHARS_JUDGED and jsd(kinds, refs[lang][0]) > qr.MAX_CLASS_DISTANCE
                        or b[0] >= qr.MIN_WORDS_JUDGED and jsd(np.array([*own, b[0] - sum(own)]), refs[lang][1]) > qr.MAX_WORD_DISTANCE)
        out[k] = (*b, kept)
    return out


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"])
           for r in queries.QUERIES["op6_quality_rules"](spark, sf).collect()}
    assert got == brute(rows)


def test_junk_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op6_quality_rules"](spark, sf).filter("not base_failed").join(labels, "doc_id").collect()
    kept = {q: np.mean([r["kept"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert kept[1] > 0.99 and kept[0] < 0.02


def test_edge_rows(spark):
    words = "the of and to in a is that it on " * 30
    rows = [(1, None, "en"), (2, "", None), (3, " \n\n ", "xx"), (None, "a b c a b c a b", "en"), (5, "x\nx\n \n \nx |", "en"),
            (6, "ü" * 30_000, None), (6, words, "xx")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, lang string, key int, words string")
    got = qr.quality_rules(df).collect()
    assert len(got) == len(rows)
    figures = {(r["doc_id"], r["n_words"]): (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["kept"]) for r in got}
    assert figures == {(1, 0): (0, 0, 0, 0, False), (2, 0): (0, 0, 0, 0, False), (3, 0): (0, 0, 0, 0, False), (None, 8): (8, 0, 0, 8, False),
                       (5, 4): (4, 1, 1, 0, False), (6, 1): (30_000, 0, 0, 0, False), (6, 300): (690, 0, 0, 300, False)}
    assert qr.quality_rules(df.limit(0)).collect() == []
