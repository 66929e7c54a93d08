"""Randomised checks whose expectation comes from the generator, not from parsing the input again.

A phrase is built from a template, a unit and a number, so its month is
known before it is written; keywords are planted in neutral text, so their
categories are known; scored words are placed in slots that nothing else
influences, so sums add up.  Each test is one Spark job over all inputs.
"""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from revlens.functions import categories as cat
from revlens.functions import dates
from revlens.functions.sentiment import Lexicon, with_sentiment
from revlens.schema import ANALYSIS_CATEGORIES, GENERAL_CATEGORY

AS_OF = dt.date(2026, 3, 31)


def months_back(n: int) -> str | None:
    at = AS_OF.year * 12 + AS_OF.month - 1 - n
    return f"{at // 12:04d}-{at % 12 + 1:02d}" if at >= 12 else None


def days_back(n: int) -> str | None:
    return (AS_OF - dt.timedelta(days=n)).strftime("%Y-%m").zfill(7) if n < (AS_OF - dt.date.min).days + 1 else None


#: What a number of units before the anchor gives.
STEPS = {"day": days_back, "week": lambda n: days_back(7 * n), "month": months_back, "year": lambda n: months_back(12 * n)}
COUNTED = ["{n} {u}s ago", "{n} {u} ago", " {n}  {u}s ago", "Edited {n} {u}s ago", "EDITED {n} {u}S AGO\t", "about {n} {u}s"]
SINGLE = ["a {u} ago", " A {u} Ago ", "a  {u}  ago"]
FIXED = {"just now": "2026-03", "an hour ago": "2026-03", "Today": "2026-03", "30 minutes ago": "2026-03", "a few seconds ago": "2026-03",
         "yesterday": "2026-03", "": None, "  ": None, "2 hours ago": None, "Edited a month ago": None, "long ago": None, "{n} moons ago": None}


@pytest.mark.parametrize("seed", range(3))
def test_relative_dates(spark, seed):
    rnd, rows = random.Random(seed), []
    for _ in range(300):
        unit = rnd.choice(list(STEPS))
        n = rnd.choice([rnd.randrange(1, 60), rnd.randrange(1, 5000), rnd.randrange(1, 10**6)])
        rows.append((rnd.choice(COUNTED).format(n=n, u=unit), STEPS[unit](n)))
        rows.append((rnd.choice(SINGLE).format(u=unit), STEPS[unit](1)))
        phrase = rnd.choice(list(FIXED))
        rows.append((phrase.format(n=n), FIXED[phrase]))
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, d string")
    got = {r["i"]: r["m"] for r in df.select("i", dates.month_year(dates.resolve_relative_date("d", AS_OF)).alias("m")).collect()}
    assert [(rows[i], got[i]) for i in got if got[i] != rows[i][1]] == []


def test_the_calendar_is_the_limit(spark):
    days = (AS_OF - dt.date.min).days
    rows = [(f"{days} days ago", "0001-01"), (f"{days + 1} days ago", None), ("2025 years ago", "0001-03"), ("2026 years ago", None),
            ("999999999999 days ago", None), (f"{days // 7} weeks ago", "0001-01"), ("24302 months ago", "0001-01"), ("24303 months ago", None)]
    df = spark.createDataFrame([(r,) for r, _ in rows], "d string")
    got = [r["m"] for r in df.select(dates.month_year(dates.resolve_relative_date("d", AS_OF)).alias("m")).collect()]
    assert got == [m for _, m in rows]


NEUTRAL = ["zq", "xjx", "qvq", "ÉÈ", "1234", "|", "zzz"]  # holds no keyword, also not side by side with blanks


@pytest.mark.parametrize("seed", range(3))
def test_planted_keywords(spark, seed):
    rnd, rows = random.Random(seed), []
    holders = {}  # keyword -> categories that list a part of it
    every = {k for _, kws in ANALYSIS_CATEGORIES for k in kws}
    for k in every:
        holders[k] = {name for name, kws in ANALYSIS_CATEGORIES if not set(kws).isdisjoint({p for p in every if p in k})}
    for _ in range(200):
        chosen = rnd.sample(sorted(every), rnd.randrange(4))
        words = [w for k in chosen for w in (rnd.choice(NEUTRAL), rnd.choice([k, k.upper(), k.title(), f"zq{k}qz"]))] + [rnd.choice(NEUTRAL)]
        found = set().union(*(holders[k] for k in chosen))
        rows.append((" ".join(words), ", ".join(name for name, _ in ANALYSIS_CATEGORIES if name in found) or GENERAL_CATEGORY))
    rows += [(None, GENERAL_CATEGORY), ("", GENERAL_CATEGORY), ("   ", GENERAL_CATEGORY)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", cat.joined(cat.category_list(F.col("t"))).alias("c")).collect()}
    assert [(rows[i], got[i]) for i in got if got[i] != rows[i][1]] == []


@pytest.mark.parametrize("seed", range(3))
def test_scored_words_add_up(spark, seed):
    """Slots of (words, doubled contribution), three neutral words apart."""
    rnd, rows = random.Random(seed), []
    lex = Lexicon.default()
    slots = [(w, 2 * p) for w, p in lex.polarity.items()] + [(f"{n} {w}", -p) for n in lex.negations for w, p in lex.polarity.items()]
    slots += [(f"{n} so {w}", -p) for n in lex.negations for w, p in lex.polarity.items()] + [("Very good", 18200), ("VERY great", 20000), ("not very nice", -7800)]
    for i in range(200):
        own = [rnd.choice(slots) for _ in range(rnd.randrange(6))]
        text = " zq xj, qv! ".join(["start", *(s for s, _ in own)])
        total, n = sum(v for _, v in own), len(own)
        rows.append((str(i), text, total, n, "Positive" if total > 2000 * n else "Negative" if total < -2000 * n else "Neutral"))
    df = spark.createDataFrame([r[:2] for r in rows], "review_id string, text string")
    for strategy in ("inline", "join"):
        got = {r["review_id"]: (r["sent_sum"], r["sent_hits"], r["sentiment"]) for r in with_sentiment(df, strategy=strategy).collect()}
        assert [(r, got[r[0]]) for r in rows if got[r[0]] != r[2:]] == []


def test_tags_by_one_pattern_equal_substrings_for_odd_dictionaries(spark):
    """Keywords inside others, at one place, overlapping, of odd letters, shared, empty; texts NULL and empty."""
    from revlens.functions import categories as cat
    odd = [("a", ["ab", "abcd", "a-b"]), ("b", ["bc", "^x", "]["]), ("c", ["abc d", "É é", "&&"]), ("none", []), ("b", ["d.", "\\E", "𝄞x", "\n"])]
    rng = random.Random(11)
    letters = ["a", "b", "c", "d", "-", "^", "x", "]", "[", "&", "é", " ", ".", "\\", "E", "𝄞", "\n", "A", "É"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(400)] + ["", None, "abcd", "xabc dab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for categories in (odd, odd + [("all", ["zz", ""])], [("none", [])], []):
        got = {r["i"]: r["c"] for r in df.select("i", cat.category_list("t", categories).alias("c")).collect()}
        for i, t in enumerate(texts):
            want = [n for n, kws in categories if any(k.lower() in t.lower() for k in kws)] if t is not None else []
            assert got[i] == (want or ["General"]), (t, categories)
    plan = df.select(cat.category_list("t", odd).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "contains" not in plan.lower()  # one pass over the text
