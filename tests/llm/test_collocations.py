"""Phrase collocations against a brute-force version, over many ranges and groups."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import collocations as co

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, order=4, min_count=30, cover=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, order + 1):
                for i in range(len(words) - k + 1):
                    f[(lang, *words[i: i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = {}
    for p, a in cand.items():
        score, k = min((2_000_000 * a // (f[p[:k + 1]] + f[(p[0], *p[k + 1:])]), k) for k in range(1, len(p) - 1))
        if any(q[0] == p[0] and len(q) > len(p) and 100 * b >= cover * a and any(q[i: i + len(p) - 1] == p[1:] for i in range(1, len(q)))
               for q, b in cand.items()):
            continue
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[(p[0], *p[k + 1:])]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in out.items() for i, x in enumerate(sorted(own)[:top], 1))


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def make(spark, docs):
    return spark.createDataFrame([(lang, text, "x", 1, "w") for lang, text in docs], "lang string, text string, phrase string, n int, w1 string")


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = ["a", "B", "the", "é", "中", "x\x1cy", " ", "-", "longer", "Zz", "É"]
    bits = [*words, "new york city hall", "New  York\tcity", "ab ab ab ab ab", ".", ", ", "\n", "!?"]
    docs = [(rnd.choice(["en", "en", "en", "de", None, "und"]), " ".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))) for _ in range(n)]
    return docs + [(None, None), ("en", ""), ("fr", "."), ("de", "hot pair " * 3000), *[("en", "of the people")] * 200]


@pytest.mark.parametrize("seed, min_count, top, windows, group", [(1, 3, 2000, 100, 500), (2, 30, 7, 2000, 1 << 23), (3, 2, 50, 37, 60)])
def test_against_brute_force(spark, seed, min_count, top, windows, group):
    docs = corpus(seed, 400 if windows > 50 else 120)
    want = brute(docs, min_count=min_count, top=top)
    got = rows(co.collocations(make(spark, docs), min_count=min_count, top=top, range_windows=windows, group_bytes=group))
    assert len(want) > 10 and got == want


def test_other_orders(spark):
    docs = corpus(4, 100)
    for order in (2, 3, 5):
        assert rows(co.collocations(make(spark, docs), order=order, min_count=5, range_windows=300)) == brute(docs, order, 5)


def test_empty_tables(spark):
    for docs in ([], [("en", None), (None, " .,")]):
        assert co.collocations(make(spark, docs)).collect() == []


def test_ranges_are_many_and_rare_tails_are_folded(spark):
    docs = corpus(5)
    rows_ = co._rows(make(spark, docs), "text", "lang")
    bounds = co.range_bounds(rows_, 4, 500)
    assert len(bounds) > 5 and bounds == sorted(set(bounds))
    dealt = co.counted(rows_, bounds, 4, 1 << 12)
    assert dealt.select("part").distinct().count() > 5
    parts = {}
    for r in dealt.collect():
        parts.setdefault(r["part"], []).append(co.Windows.unpack(r["windows"]))
    raw = sum(len(w.lang) for own in parts.values() for w in own)
    kept = sum(len(co.folded(co.Windows.join(own), 30).lang) for own in parts.values())
    assert kept < raw / 3
    total = sum(int(w.count.sum()) for own in parts.values() for w in own)
    assert total == sum(len(re.findall("[^ \t.,;:!?\n\x0b\x0c\r]+", t or "")) for _, t in docs)


def test_windows_survive_packing():
    text = "b a. a b a b\nc é a"
    w, doc = co.leads(*_bytes([text, "", "a b"]), ["en", "de", "de"], 3)
    assert [(w.langs[w.lang[i]], *(w.words[c] for c in w.codes[:, i])) for i in range(len(doc))] == [
        ("en", "b", "a", ""), ("en", "a", "", ""), ("en", "a", "b", "a"), ("en", "b", "a", "b"), ("en", "a", "b", ""), ("en", "b", "", ""),
        ("en", "c", "é", "a"), ("en", "é", "a", ""), ("en", "a", "", ""), ("de", "a", "b", ""), ("de", "b", "", "")]
    m = w.merged()
    back = co.Windows.unpack(m.pack(2, 7))
    assert [back.key(i) for i in range(5)] == [m.key(i) for i in range(2, 7)]
    assert back.count.tolist() == m.count[2:7].tolist()
    assert [m.key(i) for i in range(len(m.lang))] == sorted(m.key(i) for i in range(len(m.lang)))


def _bytes(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data])))


def test_words_of_very_long_text():
    words, doc, on = co.words_of(*_bytes(["a " * 300_000, "b"]))
    assert len(words) == 300_001 and on[:-2].all() and not on[-2:].any() and isinstance(words, pa.LargeStringArray)


def test_phrases_are_not_broadcast(spark):
    """Whatever size Spark takes them for: it reads compressed files, and an exploded table has many rows for one."""
    docs = corpus(6, 100)
    out = co.collocations(make(spark, docs), min_count=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and plan.count("BroadcastHashJoin") <= 1  # but a row a language
    assert rows(out) == brute(docs, min_count=3)


def test_copies_of_a_text_are_collected_once(spark, monkeypatch):
    """They are sampled together, however many there are."""
    from pyspark.sql.classic.dataframe import DataFrame
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    text = "one two three four five six"
    bounds = co.range_bounds(co._rows(make(spark, [("en", text)] * 300 + [("de", "one two")] * 50), "text", "lang"), 4, 100)
    assert max(map(len, seen)) == 8 and bounds == sorted(set(bounds)) and len(bounds) > 3
