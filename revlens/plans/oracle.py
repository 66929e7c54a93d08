"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written separately from the Spark plans: derivations as CTEs over
the driver tables, tagging as a keyword join, sentiment as unnest with
ordinality plus ``lag`` windows, lists with ``row_number``.  Only the
dictionaries (parameters) are shared with the Spark side.
"""

from __future__ import annotations

from revlens.schema import (ANALYSIS_CATEGORIES, DEFAULT_AS_OF, REPORT_SHEETS, SNAPSHOT_CAP, STOPWORDS, TEST_LEXICON,
                            WEEKLY_CATEGORIES)
from revlens.sources.fixtures import (DATE_PHRASES, FILLED_CATEGORY, LONG_REPLY, OTHER_STORE, REPLY_TEXT, SNAPSHOT_PLAN,
                                      TEXT_PREFIXES, store_names)

AS_OF = f"DATE '{DEFAULT_AS_OF.isoformat()}'"
NB = r"'[^\s\p{Z}]'"
EDGE = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
STORES = store_names()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nonblank(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {NB}), false)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {EDGE}, '', 'g')"


def _case_pick(expr: str, values: list[str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


def _cat_rows(cats) -> list[tuple]:
    return [(i, name, kw) for i, (name, kws) in enumerate(cats) for kw in kws]


def _shift(unit: str, n: str) -> str:
    return (f"CASE {unit} "
            f"WHEN 'day' THEN CASE WHEN {n} <= 730000 THEN CAST({AS_OF} - to_days({n}) AS DATE) END "
            f"WHEN 'week' THEN CASE WHEN {n} <= 104000 THEN CAST({AS_OF} - to_days(7 * {n}) AS DATE) END "
            f"WHEN 'month' THEN CASE WHEN {n} <= 24000 THEN CAST({AS_OF} - to_months({n}) AS DATE) END "
            f"WHEN 'year' THEN CASE WHEN {n} <= 2000 THEN CAST({AS_OF} - to_months(12 * {n}) AS DATE) END END")


_lex_scored = [(w, p) for w, p, _, role in TEST_LEXICON if role == "scored"]
_lex_neg = [w for w, _, _, role in TEST_LEXICON if role == "negation"]
_lex_int = [(w, m) for w, _, m, role in TEST_LEXICON if role == "intensifier"]
_negs = ", ".join(q(w) for w in _lex_neg)
_stops = ", ".join(q(w) for w in STOPWORDS)

snap_union = " UNION ALL ".join(f"SELECT DATE '{d.isoformat()}' AS snapshot_date, {k} AS k" for k, (d, _) in enumerate(SNAPSHOT_PLAN))
snap_cond = " OR ".join(
    f"(s.k = {k} AND CAST(r.review_id AS BIGINT) % 5 IN ({', '.join(str(c) for c in cls)}))"
    for k, (_, cls) in enumerate(SNAPSHOT_PLAN))

PRELUDE = f"""
reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS review_id,
    'store_' || CAST((d.doc_id // 5) % 5 AS VARCHAR) AS store,
    'author_' || CAST(d.doc_id % 97 AS VARCHAR) AS author,
    CAST(CASE WHEN d.doc_id % 23 = 0 THEN NULL WHEN d.doc_id % 41 = 0 THEN 0 WHEN d.doc_id % 43 = 0 THEN 4.5 WHEN l.toxic = 1 THEN 1 + d.doc_id % 2
         WHEN l.quality = 0 THEN 2 + d.doc_id % 2 WHEN d.doc_id % 10 < 6 THEN 5
         WHEN d.doc_id % 10 = 6 THEN 4 WHEN d.doc_id % 10 = 7 THEN 3 WHEN d.doc_id % 10 = 8 THEN 2 ELSE 1 END AS DOUBLE) AS rating,
    {_case_pick('d.doc_id % 16', DATE_PHRASES)} AS date_raw,
    CASE WHEN d.doc_id % 13 = 0 THEN '' WHEN d.doc_id % 29 = 0 THEN '   '
         ELSE concat({_case_pick('d.doc_id % 9', TEXT_PREFIXES)}, d.text) END AS text,
    CAST(CASE WHEN d.doc_id % 47 <> 0 THEN (d.doc_id * 7919) % 41 END AS INTEGER) AS likes,
    CASE WHEN d.doc_id % 33 = 0 THEN {q(LONG_REPLY)} WHEN d.doc_id % 3 = 0 THEN {q(REPLY_TEXT)} WHEN d.doc_id % 31 = 0 THEN '  ' ELSE '' END AS owner_reply
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
snapshots0 AS (
  SELECT s.snapshot_date, r.*, r.review_id AS rid, CAST(r.review_id AS BIGINT) % 53 = 0 AS filled
  FROM reviews r JOIN ({snap_union}) s ON {snap_cond}
),
snapshots AS (
  SELECT * REPLACE (CASE WHEN CAST(rid AS BIGINT) % 61 = 0 THEN '' ELSE review_id END AS review_id) FROM (
    SELECT * FROM snapshots0 UNION ALL
    SELECT * REPLACE ({q(OTHER_STORE)} AS store) FROM snapshots0 WHERE CAST(rid AS BIGINT) % 59 = 0)
),
stores AS (
  SELECT * FROM {_values([(f"store_{k}", 50 + 60 * k) for k in range(6)], 'store, expected')}
),
dr AS (
  SELECT review_id, date_raw, lower({strip('date_raw')}) AS r FROM reviews
),
dated AS (
  SELECT review_id,
    CASE
      WHEN date_raw IS NULL OR date_raw = '' THEN NULL
      WHEN contains(r, 'just now') OR contains(r, 'today') OR contains(r, 'hour ago') OR contains(r, 'second') OR contains(r, 'minute') THEN {AS_OF}
      WHEN contains(r, 'yesterday') THEN CAST({AS_OF} - to_days(1) AS DATE)
      WHEN regexp_matches(r, '^a\\s+(day|week|month|year)\\s+ago$') THEN {_shift("regexp_extract(r, '^a\\s+(day|week|month|year)\\s+ago$', 1)", '1')}
      WHEN regexp_extract(r, '(\\d+)\\s+(day|week|month|year)', 1) <> '' THEN
        {_shift("regexp_extract(r, '(\\d+)\\s+(day|week|month|year)', 2)", "TRY_CAST(regexp_extract(r, '(\\d+)\\s+(day|week|month|year)', 1) AS INTEGER)")}
    END AS review_date
  FROM dr
),
tok AS (
  SELECT r.review_id, t.w, t.pos
  FROM reviews r, unnest(regexp_extract_all(lower(r.text), '[a-z'']+')) WITH ORDINALITY AS t(w, pos)
),
ctx AS (
  SELECT review_id, w, lag(w, 1) OVER (PARTITION BY review_id ORDER BY pos) AS p1,
         lag(w, 2) OVER (PARTITION BY review_id ORDER BY pos) AS p2 FROM tok
),
lex AS (SELECT * FROM {_values(_lex_scored, 'word, polarity')}),
intens AS (SELECT * FROM {_values(_lex_int, 'word, mult')}),
hit AS (
  SELECT c.review_id, CAST(x.polarity AS BIGINT) AS p, i.mult,
    (coalesce(c.p1 IN ({_negs}), false) OR coalesce(c.p2 IN ({_negs}), false)) AS neg
  FROM ctx c JOIN lex x ON c.w = x.word LEFT JOIN intens i ON c.p1 = i.word
),
hit2 AS (
  SELECT review_id, neg,
    CASE WHEN mult IS NULL THEN p
         ELSE greatest(-10000, least(10000, CASE WHEN p < 0 THEN -((-p * mult) // 10000) ELSE (p * mult) // 10000 END)) END AS b
  FROM hit
),
sent AS (
  SELECT review_id, CAST(sum(CASE WHEN neg THEN -b ELSE 2 * b END) AS BIGINT) AS s, CAST(count(*) AS INTEGER) AS n
  FROM hit2 GROUP BY review_id
),
sentl AS (
  SELECT r.review_id,
    CASE WHEN {nonblank('r.text')} THEN coalesce(s.s, 0) ELSE 0 END AS sent_sum,
    CASE WHEN {nonblank('r.text')} THEN coalesce(s.n, 0) ELSE 0 END AS sent_hits
  FROM reviews r LEFT JOIN sent s ON r.review_id = s.review_id
),
sentf AS (
  SELECT review_id, sent_sum, sent_hits,
    CASE WHEN sent_hits > 0 THEN CAST(sent_sum AS DOUBLE) / (sent_hits * CAST(20000 AS DOUBLE)) ELSE 0.0 END AS sent_score,
    CAST(CASE WHEN sent_hits = 0 THEN 0
         WHEN sent_sum >= 0 THEN (sent_sum + sent_hits) // (2 * sent_hits)
         ELSE -((-sent_sum + sent_hits) // (2 * sent_hits)) END AS BIGINT) AS score_e4,
    sent_sum > 2000 * sent_hits AND sent_hits > 0 AS is_pos,
    sent_sum < -2000 * sent_hits AND sent_hits > 0 AS is_neg
  FROM sentl
),
catkw AS (SELECT * FROM {_values(_cat_rows(ANALYSIS_CATEGORIES), 'ord, category, keyword')}),
cathit AS (
  SELECT DISTINCT r.review_id, k.ord, k.category FROM reviews r JOIN catkw k ON contains(lower(r.text), k.keyword)
),
cats AS (SELECT review_id, string_agg(category, ', ' ORDER BY ord) AS categories FROM cathit GROUP BY review_id),
wcatkw AS (SELECT * FROM {_values(_cat_rows(WEEKLY_CATEGORIES), 'ord, category, keyword')}),
wcathit AS (
  SELECT DISTINCT r.review_id, k.ord, k.category FROM reviews r JOIN wcatkw k ON contains(lower(r.text), k.keyword)
),
wcats AS (SELECT review_id, string_agg(category, ', ' ORDER BY ord) AS categories FROM wcathit GROUP BY review_id),
labeled AS (
  SELECT r.review_id, f.sent_sum, f.sent_hits, f.sent_score, f.score_e4,
    CASE WHEN NOT {nonblank('r.text')} THEN 'No Text' WHEN f.is_pos THEN 'Positive' WHEN f.is_neg THEN 'Negative'
         ELSE 'Neutral' END AS sentiment
  FROM reviews r JOIN sentf f ON r.review_id = f.review_id
),
enriched AS (
  SELECT r.review_id, r.store, r.author, r.rating, r.date_raw, r.text, coalesce(r.likes, 0) AS likes, r.owner_reply,
    d.review_date,
    CAST(date_trunc('month', d.review_date) AS DATE) AS month,
    strftime(d.review_date, '%Y-%m') AS month_year,
    substr(strftime(d.review_date, '%Y-%m'), 1, 4) AS year,
    {nonblank('r.owner_reply')} AS has_reply,
    {nonblank('r.text')} AS has_text,
    lb.sentiment, lb.sent_sum, lb.sent_hits, lb.sent_score, lb.score_e4,
    coalesce(c.categories, 'General') AS categories
  FROM reviews r JOIN dated d ON r.review_id = d.review_id
  JOIN labeled lb ON r.review_id = lb.review_id
  LEFT JOIN cats c ON r.review_id = c.review_id
),
ecat AS (
  SELECT e.review_id, e.store, e.rating, e.sentiment, h.category FROM enriched e JOIN cathit h ON e.review_id = h.review_id
  UNION ALL
  SELECT e.review_id, e.store, e.rating, e.sentiment, 'General' FROM enriched e
  WHERE NOT EXISTS (SELECT 1 FROM cathit h WHERE h.review_id = e.review_id)
),
prevd AS (SELECT max(snapshot_date) AS d FROM snapshots WHERE snapshot_date < {AS_OF}),
newr AS (
  SELECT c.* FROM snapshots c
  WHERE c.snapshot_date = {AS_OF}
    AND EXISTS (SELECT 1 FROM prevd WHERE d IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM snapshots p, prevd WHERE p.snapshot_date = prevd.d
                    AND coalesce(p.review_id, '') = coalesce(c.review_id, ''))
),
newe AS (
  SELECT n.snapshot_date, n.review_id, n.store, n.author, n.rating, n.date_raw, n.text, n.likes, n.owner_reply, n.rid, n.filled,
    CASE WHEN n.filled THEN 'Positive' ELSE lb.sentiment END AS sentiment, CASE WHEN n.filled THEN 0.5 ELSE lb.sent_score END AS sent_score,
    CASE WHEN n.filled THEN {q(FILLED_CATEGORY)} ELSE coalesce(w.categories, 'General') END AS categories,
    {nonblank('n.owner_reply')} AS has_reply
  FROM newr n JOIN labeled lb ON n.rid = lb.review_id LEFT JOIN wcats w ON n.rid = w.review_id
),
sdates AS (SELECT DISTINCT snapshot_date FROM snapshots),
sprev AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS prev_date FROM sdates),
j2 AS (
  SELECT s.*, p.prev_date FROM snapshots s JOIN sprev p ON s.snapshot_date = p.snapshot_date
  WHERE NOT EXISTS (SELECT 1 FROM snapshots x WHERE x.snapshot_date = p.prev_date
                    AND coalesce(x.review_id, '') = coalesce(s.review_id, ''))
),
cstore AS (SELECT store FROM stores),
rc AS (
  SELECT CAST(review_id AS BIGINT) AS doc, store, CAST(review_id AS BIGINT) * 2 AS ord,
    CASE WHEN CAST(review_id AS BIGINT) % 37 = 0 THEN '' WHEN CAST(review_id AS BIGINT) % 101 = 0
      THEN 'shared_' || CAST(CAST(review_id AS BIGINT) % 3 AS VARCHAR) ELSE review_id END AS review_id,
    CASE WHEN CAST(review_id AS BIGINT) % 11 = 0 THEN [' ', ''] ELSE ['  ', author] END AS author_cands,
    CASE WHEN rating IS NULL THEN ['no digits'] ELSE ['', 'Rated ' || CAST(CAST(floor(rating) AS BIGINT) AS VARCHAR) || '.5 stars'] END AS rating_cands,
    [chr(9), text] AS text_cands,
    [date_raw, 'ignored later'] AS date_cands,
    CASE WHEN CAST(review_id AS BIGINT) % 19 = 0 THEN printf('%d,%03d', likes, likes) ELSE CAST(likes AS VARCHAR) END AS likes_raw,
    owner_reply AS reply_raw
  FROM reviews
),
raw_cards AS (
  SELECT store, ord, review_id, author_cands, rating_cands, text_cands, date_cands, likes_raw, reply_raw FROM rc
  UNION ALL
  SELECT store, ord + 1, review_id, author_cands, rating_cands, ['repeated card'], date_cands, likes_raw, reply_raw
  FROM rc WHERE doc % 7 = 0
),
cardf AS (
  SELECT store, ord, coalesce(review_id, '') AS review_id,
    coalesce({strip("list_filter(author_cands, lambda x: regexp_matches(x, " + NB + "))[1]")}, 'Anonymous') AS author,
    TRY_CAST(regexp_extract(list_filter(rating_cands, lambda x: regexp_matches(x, '[0-9]'))[1], '([0-9]+)', 1) AS INTEGER) AS rating,
    coalesce({strip("list_filter(date_cands, lambda x: regexp_matches(x, " + NB + "))[1]")}, '') AS date_raw,
    coalesce({strip("list_filter(text_cands, lambda x: regexp_matches(x, " + NB + "))[1]")}, '') AS text,
    CASE WHEN regexp_matches(likes_raw, '^[0-9]+$') THEN TRY_CAST(likes_raw AS INTEGER) ELSE 0 END AS likes,
    coalesce({strip('reply_raw')}, '') AS owner_reply
  FROM raw_cards
),
cards AS (
  SELECT *, {nonblank('text')} AS has_text FROM cardf
  QUALIFY row_number() OVER (PARTITION BY store, review_id ORDER BY ord) = 1
)
"""


def with_prelude(body: str) -> str:
    return "WITH " + PRELUDE.strip() + ",\n__q AS (\n" + body + "\n)\nSELECT * FROM __q"


def pct(num: str, den: str) -> str:
    return f"CAST(100 AS DOUBLE) * ({num}) / greatest({den}, 1)"


def cnt_if(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def store_counts(cond: str | None = None, col: str = "store") -> str:
    return ", ".join(cnt_if(f"{col} = {q(s)}" + (f" AND {cond}" if cond else "")) + f" AS {s}" for s in STORES)


STARS = [5, 4, 3, 2, 1]


def _rank(order: str, part: str = "", kind: str = "INTEGER") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"CAST(row_number() OVER ({p}ORDER BY {order}) AS {kind})"


SQL: dict[str, str] = {}

# ----------------------------------------------------------------- sources / sinks
REVIEW_COLS = "review_id, store, author, rating, date_raw, text, likes, owner_reply"
SQL["scan_reviews"] = f"SELECT {REVIEW_COLS.replace('likes', 'coalesce(likes, 0) AS likes')} FROM reviews"
SQL["write_reviews"] = f"SELECT {REVIEW_COLS} FROM reviews"
SQL["all_snapshots"] = "SELECT snapshot_date, review_id, store, rating, date_raw FROM snapshots"
SQL["json_snapshots"] = ("SELECT snapshot_date, review_id, store, rating, CASE WHEN filled THEN 'Positive' ELSE '' END AS sentiment "
                         "FROM snapshots")
SQL["write_snapshot"] = ("SELECT snapshot_date, count(*) AS rows, count(DISTINCT review_id) AS ids "
                         "FROM snapshots GROUP BY snapshot_date")
SQL["latest_snapshot"] = ("SELECT snapshot_date, review_id, store, rating FROM snapshots "
                          "WHERE snapshot_date = (SELECT d FROM prevd)")
SQL["normalize_cards"] = ("SELECT store, review_id, ord, author, rating, date_raw, text, likes, owner_reply, has_text "
                          "FROM cards")
SQL["dedup_reviews"] = ("SELECT store, coalesce(review_id, '') AS review_id, min(ord) AS ord FROM raw_cards "
                        "GROUP BY store, coalesce(review_id, '')")
SQL["newest_per_store"] = (f"SELECT * FROM (SELECT store, {_rank('ord, review_id', 'store')} AS rank, review_id, ord "
                           f"FROM cards) WHERE rank <= {SNAPSHOT_CAP}")
SQL["union_sources"] = ("SELECT 'reviews' AS source, review_id, store, rating, CAST(NULL AS BIGINT) AS ord, "
                        "CAST(NULL AS BOOLEAN) AS has_text FROM reviews UNION ALL "
                        "SELECT 'cards', review_id, store, rating, ord, has_text FROM cards")
SQL["cross_store_duplicates"] = (
    "SELECT review_id, count(*) AS n_stores, CAST(sum(n) AS BIGINT) AS n_rows, min(store) AS first_store, "
    "max(store) AS last_store FROM (SELECT coalesce(review_id, '') AS review_id, store, count(*) AS n "
    "FROM raw_cards WHERE coalesce(review_id, '') <> '' GROUP BY 1, 2) GROUP BY review_id HAVING count(*) > 1")
SQL["collection_summary"] = ("SELECT store, count(*) AS collected, " + cnt_if("has_text") + " AS with_text, "
                             + cnt_if("NOT has_text") + " AS stars_only FROM cards GROUP BY store")
SQL["capture_rate"] = (
    "SELECT s.store, s.expected, coalesce(c.n, 0) AS collected, "
    "CASE WHEN s.expected > 0 THEN CAST(100 AS DOUBLE) * coalesce(c.n, 0) / s.expected END AS capture_pct, "
    "(CAST(100 AS DOUBLE) * coalesce(c.n, 0) / s.expected BETWEEN 85 AND 95) AS in_normal_band "
    "FROM stores s LEFT JOIN (SELECT store, count(*) AS n FROM cards GROUP BY store) c ON s.store = c.store")

# ----------------------------------------------------------------- projections
ENRICHED_COLS = ("review_id, store, author, rating, date_raw, text, likes, owner_reply, review_date, month, "
                 "month_year, year, has_reply, has_text, sentiment, sent_sum, sent_hits, sent_score, score_e4, categories")
SQL["build_reviews"] = f"SELECT {ENRICHED_COLS} FROM enriched"
SQL["all_reviews"] = ("SELECT review_id, store, author, rating, date_raw, month_year, sentiment, sent_score, "
                      "categories, text, likes, has_reply, owner_reply FROM enriched")
SQL["reply_flag"] = f"SELECT review_id, owner_reply, {nonblank('owner_reply')} AS has_reply FROM reviews"
SQL["has_text"] = f"SELECT review_id, {nonblank('text')} AS has_text FROM reviews"
SQL["parse_relative_date"] = "SELECT review_id, date_raw, review_date, month_year, year FROM enriched"
SQL["categorize"] = "SELECT review_id, categories FROM enriched"
SQL["categorize_join"] = SQL["categorize"]
SQL["sentiment_score"] = "SELECT review_id, sent_sum, sent_hits, sent_score, score_e4 FROM enriched"
SQL["sentiment_label"] = "SELECT review_id, sentiment FROM enriched"
SQL["enrich"] = ("SELECT s.snapshot_date, s.review_id, CASE WHEN filled THEN 'Positive' ELSE lb.sentiment END AS sentiment, "
                 "CASE WHEN filled THEN 0.5 ELSE lb.sent_score END AS sent_score, "
                 f"CASE WHEN filled THEN {q(FILLED_CATEGORY)} ELSE coalesce(w.categories, 'General') END "
                 "AS categories FROM snapshots s JOIN labeled lb ON s.rid = lb.review_id "
                 "LEFT JOIN wcats w ON s.rid = w.review_id")
# the same scores whatever the ids are: blank, missing and repeated ones
SQL["sentiment_score_join"] = (
    "SELECT CASE WHEN CAST(review_id AS BIGINT) % 7 = 0 THEN '' WHEN CAST(review_id AS BIGINT) % 11 = 0 THEN NULL "
    "ELSE CAST(CAST(review_id AS BIGINT) % 50 AS VARCHAR) END AS review_id, sent_sum, sent_hits, sent_score, score_e4, sentiment FROM enriched")
SQL["truncate_text"] = ("SELECT review_id, substring(text, 1, 500) AS text_500, substring(text, 1, 600) AS text_600, "
                        "substring(text, 1, 180) AS text_180, CASE WHEN length(owner_reply) > 250 THEN "
                        "substring(owner_reply, 1, 250) || '...' ELSE owner_reply END AS reply_250 FROM reviews")

# ----------------------------------------------------------------- analysis
SQL["dataset_totals"] = ("SELECT count(*) AS total_reviews, count(DISTINCT store) AS n_stores, "
                         + cnt_if("month_year IS NOT NULL") + " AS dated_reviews, "
                         "string_agg(DISTINCT year, ',' ORDER BY year) AS years, min(year) AS first_year, "
                         "max(year) AS last_year FROM enriched")
SQL["store_kpis"] = (
    "SELECT store, count(*) AS total, avg(rating) AS avg_rating, " + cnt_if("rating = 5") + " AS five_star, "
    + pct(cnt_if("sentiment = 'Positive'"), "count(*)") + " AS pct_positive, "
    + pct(cnt_if("sentiment = 'Negative'"), "count(*)") + " AS pct_negative, "
    + pct(cnt_if("has_reply"), "count(*)") + " AS pct_replied FROM enriched GROUP BY store")
SQL["store_comparison"] = (
    "SELECT store, count(*) AS total, avg(rating) AS avg_rating, "
    + ", ".join(cnt_if(f"rating = {s}") + f" AS star_{s}" for s in STARS) + ", "
    + pct(cnt_if("sentiment = 'Positive'"), "count(*)") + " AS pct_positive, "
    + pct(cnt_if("sentiment = 'Negative'"), "count(*)") + " AS pct_negative, "
    + pct(cnt_if("sentiment = 'Neutral'"), "count(*)") + " AS pct_neutral, "
    + pct(cnt_if("has_reply"), "count(*)") + " AS pct_replied FROM enriched GROUP BY store")
_grp = ("SELECT grouping(store) = 1 AS is_all, CASE WHEN grouping(store) = 1 THEN NULL ELSE store END AS store, "
        "count(*) AS rows, count(rating) AS rated FROM enriched GROUP BY ROLLUP (store)")
SQL["rating_distribution"] = (
    f"SELECT g.is_all, g.store, g.rated, s.stars, count(e.review_id) AS cnt, "
    f"{pct('count(e.review_id)', 'g.rated')} AS pct "
    f"FROM ({_grp}) g CROSS JOIN (VALUES (5), (4), (3), (2), (1)) s(stars) "
    f"LEFT JOIN enriched e ON e.rating = s.stars AND (g.is_all OR e.store = g.store) "
    f"GROUP BY g.is_all, g.store, g.rated, s.stars")
SQL["rating_matrix"] = (
    "SELECT s.stars, " + ", ".join(f"count(e.review_id) FILTER (WHERE e.store = {q(st)}) AS {st}" for st in STORES)
    + ", count(e.review_id) AS all_stores FROM (VALUES (5), (4), (3), (2), (1)) s(stars) "
    "LEFT JOIN enriched e ON e.rating = s.stars GROUP BY s.stars")
SQL["sentiment_stats"] = (
    "SELECT g.is_all, g.store, l.sentiment, count(e.review_id) AS cnt, "
    f"{pct('count(e.review_id)', 'g.rows')} AS pct, avg(e.rating) AS avg_rating, "
    "CASE WHEN count(e.review_id) > 0 THEN CAST(sum(e.score_e4) AS DOUBLE) / (count(e.review_id) * CAST(10000 AS DOUBLE)) END AS avg_score, "
    "min(e.rating) AS min_rating, max(e.rating) AS max_rating "
    f"FROM ({_grp}) g CROSS JOIN (VALUES ('Positive'), ('Negative'), ('Neutral'), ('No Text')) l(sentiment) "
    "LEFT JOIN enriched e ON e.sentiment = l.sentiment AND (g.is_all OR e.store = g.store) "
    "GROUP BY g.is_all, g.store, g.rows, l.sentiment")
SQL["sentiment_share"] = (
    "SELECT l.sentiment, count(e.review_id) AS cnt FROM (VALUES ('Positive'), ('Negative'), ('Neutral')) l(sentiment) "
    "LEFT JOIN enriched e ON e.sentiment = l.sentiment GROUP BY l.sentiment")
SQL["category_totals"] = (
    f"SELECT category, cnt, {_rank('cnt DESC, category')} AS rank FROM "
    "(SELECT category, count(*) AS cnt FROM ecat GROUP BY category)")
SQL["category_metrics"] = (
    "SELECT category, count(*) AS total, avg(rating) AS avg_rating, "
    + pct(cnt_if("sentiment = 'Positive'"), "count(*)") + " AS pct_positive, "
    + pct(cnt_if("sentiment = 'Negative'"), "count(*)") + " AS pct_negative, "
    + store_counts() + " FROM ecat GROUP BY category")
SQL["yearly_summary"] = (
    "SELECT year, " + store_counts() + ", count(*) AS total, avg(rating) AS avg_rating, "
    + pct(cnt_if("sentiment = 'Positive'"), "count(*)") + " AS pct_positive, "
    + pct(cnt_if("sentiment = 'Negative'"), "count(*)") + " AS pct_negative "
    "FROM enriched WHERE month IS NOT NULL GROUP BY year")
SQL["monthly_detail"] = (
    "SELECT strftime(month, '%Y-%m') AS month_year, strftime(month, '%b %Y') AS month_label, "
    "strftime(month, '%Y') AS year, " + store_counts() + ", count(*) AS total, avg(rating) AS avg_rating, "
    + ", ".join(cnt_if(f"rating = {s}") + f" AS star_{s}" for s in STARS) + ", "
    + pct(cnt_if("sentiment = 'Positive'"), "count(*)") + " AS pct_positive, "
    + pct(cnt_if("sentiment = 'Negative'"), "count(*)") + " AS pct_negative "
    "FROM enriched WHERE month IS NOT NULL GROUP BY month")
SQL["monthly_volume"] = (
    "SELECT strftime(m.month, '%Y-%m') AS month_year, s.store, count(e.review_id) AS cnt "
    "FROM (SELECT DISTINCT month FROM enriched WHERE month IS NOT NULL) m CROSS JOIN cstore s "
    "LEFT JOIN enriched e ON e.month = m.month AND e.store = s.store GROUP BY m.month, s.store")
SQL["monthly_avg_rating"] = ("SELECT strftime(month, '%Y-%m') AS month_year, avg(rating) AS avg_rating "
                             "FROM enriched WHERE month IS NOT NULL GROUP BY month")

_notable_cols = "rank, review_id, store, rating, sentiment, substring(text, 1, 500) AS text, date_raw, author, likes"
_crit_order = "likes DESC NULLS LAST, review_id, store"
SQL["notable_critical"] = (
    f"SELECT {_notable_cols} FROM (SELECT *, {_rank(_crit_order)} AS rank FROM enriched "
    "WHERE has_text AND rating IN (1, 2)) WHERE rank <= 15")
SQL["notable_critical_by_store"] = (
    f"SELECT {_notable_cols} FROM (SELECT *, {_rank(_crit_order, 'store')} AS rank FROM enriched "
    "WHERE has_text AND rating IN (1, 2)) WHERE rank <= 10")
SQL["notable_most_liked"] = (
    f"SELECT {_notable_cols} FROM (SELECT *, {_rank(_crit_order)} AS rank FROM enriched) WHERE rank <= 15")
_seeded = "md5('1' || review_id), review_id, store"
SQL["notable_best_sample"] = (
    f"SELECT {_notable_cols} FROM (SELECT *, {_rank(_seeded)} AS rank FROM enriched "
    "WHERE has_text AND rating = 5) WHERE rank <= 15")
SQL["top_words"] = (
    "SELECT section_kind, section, rank, word, cnt FROM ("
    f"SELECT *, {_rank('cnt DESC, word', 'section_kind, section')} AS rank FROM ("
    "SELECT section_kind, section, word, count(*) AS cnt FROM ("
    "SELECT 'sentiment' AS section_kind, sentiment AS section, word FROM tw "
    "WHERE sentiment IN ('Positive', 'Negative', 'Neutral') "
    "UNION ALL SELECT 'store', store, word FROM tw) GROUP BY ALL)) WHERE rank <= 25")

# ----------------------------------------------------------------- weekly
SQL["new_reviews"] = "SELECT snapshot_date, review_id, store, rating, sentiment, categories, has_reply FROM newe"
SQL["snapshot_new"] = "SELECT snapshot_date, prev_date, review_id, store, rating FROM j2"
SQL["weekly_overall"] = (
    "SELECT count(*) AS total, " + cnt_if("rating <= 2") + " AS critical, " + cnt_if("rating = 3") + " AS low, "
    + cnt_if("rating >= 4") + " AS good, " + cnt_if("sentiment = 'Positive'") + " AS positive, "
    + cnt_if("sentiment = 'Negative'") + " AS negative, " + cnt_if("sentiment = 'Neutral'") + " AS neutral, "
    + cnt_if("sentiment = 'No Text'") + " AS no_text, " + cnt_if("has_reply") + " AS with_reply, "
    + cnt_if("NOT has_reply") + " AS without_reply, avg(rating) AS avg_rating FROM newe")
SQL["weekly_by_store"] = (
    "SELECT s.store, count(n.review_id) AS total, count(n.review_id) FILTER (WHERE n.rating <= 2) AS critical, "
    "avg(n.rating) AS avg_rating, count(n.review_id) FILTER (WHERE n.sentiment = 'Positive') AS positive, "
    "count(n.review_id) FILTER (WHERE n.sentiment = 'Negative') AS negative, "
    f"count(n.review_id) >= {SNAPSHOT_CAP} AS at_cap "
    "FROM cstore s LEFT JOIN newe n ON n.store = s.store GROUP BY s.store")
SQL["weekly_store_bands"] = (
    "SELECT s.store, count(n.review_id) AS total, count(n.review_id) FILTER (WHERE n.rating <= 2) AS critical, "
    "count(n.review_id) FILTER (WHERE n.rating = 3) AS needs_attention, "
    "count(n.review_id) FILTER (WHERE n.rating >= 4) AS positive_4_5, CAST(0 AS BIGINT) AS needs_attention_ref, "
    "count(n.review_id) - count(n.review_id) FILTER (WHERE n.rating <= 2) AS positive_ref "
    "FROM cstore s LEFT JOIN newe n ON n.store = s.store GROUP BY s.store")
SQL["weekly_star_dist"] = (
    "SELECT stars, repeat('★', stars) AS star_label, cnt, pct, repeat('█', CAST(floor(pct / 5) AS INTEGER)) AS bar "
    "FROM (SELECT s.stars, count(n.review_id) AS cnt, "
    f"{pct('count(n.review_id)', '(SELECT count(*) FROM newe)')} AS pct "
    "FROM (VALUES (5), (4), (3), (2), (1)) s(stars) LEFT JOIN newe n ON n.rating = s.stars GROUP BY s.stars)")
SQL["weekly_topics"] = (
    f"SELECT category, cnt, {pct('cnt', '(SELECT count(*) FROM newe)')} AS pct, {_rank('cnt DESC, category')} AS rank "
    "FROM (SELECT category, count(*) AS cnt FROM ("
    "SELECT h.category FROM newe n JOIN wcathit h ON n.rid = h.review_id WHERE NOT n.filled "
    f"UNION ALL SELECT {q(FILLED_CATEGORY)} FROM newe WHERE filled "
    "UNION ALL SELECT 'General' FROM newe n WHERE NOT n.filled AND NOT EXISTS (SELECT 1 FROM wcathit h WHERE h.review_id = n.rid)"
    ") GROUP BY category)")

_r_or3 = "coalesce(CASE WHEN rating <> 0 THEN rating END, 3)"
_sent = "CASE WHEN j.filled THEN 'Positive' ELSE lb.sentiment END"
_r_or5 = "coalesce(CASE WHEN rating <> 0 THEN rating END, 5)"
_list_cols = "rank, review_id, store, rating, sentiment, substring(text, 1, {n}) AS text, date_raw, author, categories, has_reply"
_triage = f"(coalesce(sentiment, '') <> 'Negative') ASC, {_r_or3} DESC, review_id, store"
SQL["triage_list"] = (
    f"SELECT {_list_cols.format(n=500)} FROM (SELECT *, {_rank(_triage, kind="BIGINT")} AS rank FROM newe)")
SQL["critical_list"] = (
    f"SELECT {_list_cols.format(n=600)} FROM (SELECT *, {_rank('rating, review_id, store', kind="BIGINT")} AS rank FROM newe "
    f"WHERE {_r_or5} <= 2)")
_unans = f"(({_r_or5} <= 3 OR coalesce(sentiment, '') = 'Negative') AND NOT has_reply)"
SQL["unanswered"] = f"SELECT review_id, store, rating, sentiment, has_reply FROM newe WHERE {_unans}"
SQL["flagged_reviews"] = (
    f"SELECT {_list_cols.format(n=600)} FROM (SELECT *, {_rank(_r_or5 + ', review_id', kind="BIGINT")} AS rank FROM ("
    f"SELECT * FROM newe WHERE {_r_or5} <= 2 OR {_unans} "
    "QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY store DESC) = 1))")
SQL["alerts"] = (
    f"SELECT rank, review_id, store, rating, has_reply, needs_reply FROM (SELECT *, NOT has_reply AS needs_reply, "
    f"{_rank('(NOT has_reply) DESC, rating, review_id, store', kind="BIGINT")} AS rank FROM newe WHERE {_r_or5} <= 2)")
_sums = (
    "count(j.rid) AS new, count(j.rid) FILTER (WHERE j.rating <= 2) AS critical, "
    "count(j.rid) FILTER (WHERE j.rating = 3) AS low, count(j.rid) FILTER (WHERE j.rating >= 4) AS good, "
    f"sum(j.rating) AS rsum, count(j.rating) AS rated, count(j.rid) FILTER (WHERE {_sent} = 'Positive') AS positive, "
    f"count(j.rid) FILTER (WHERE {_sent} = 'Negative') AS negative, "
    f"count(j.rid) FILTER (WHERE NOT {nonblank('j.owner_reply')}) AS without_reply ")
_trend_grid = (
    f"SELECT d.snapshot_date, s.store, {_sums}"
    "FROM sdates d CROSS JOIN cstore s LEFT JOIN j2 j ON j.snapshot_date = d.snapshot_date AND j.store = s.store "
    "LEFT JOIN labeled lb ON lb.review_id = j.rid GROUP BY d.snapshot_date, s.store")
_trend_all = (
    f"SELECT d.snapshot_date, {_sums} FROM sdates d LEFT JOIN j2 j ON j.snapshot_date = d.snapshot_date "
    "LEFT JOIN labeled lb ON lb.review_id = j.rid GROUP BY d.snapshot_date")
SQL["snapshot_trends"] = (
    f"SELECT snapshot_date, store, new, critical, CASE WHEN rated > 0 THEN rsum / rated END AS avg_rating "
    f"FROM ({_trend_grid}) WHERE (SELECT count(*) FROM sdates) >= 2")
SQL["snapshot_trends_wide"] = (
    "SELECT snapshot_date, " + ", ".join(
        f"max(new) FILTER (WHERE store = {q(s)}) AS {s}_new, max(critical) FILTER (WHERE store = {q(s)}) AS {s}_critical, "
        f"max(CASE WHEN rated > 0 THEN rsum / rated END) FILTER (WHERE store = {q(s)}) AS {s}_avg" for s in STORES)
    + f" FROM ({_trend_grid}) WHERE (SELECT count(*) FROM sdates) >= 2 GROUP BY snapshot_date")
_wow_long = (
    "SELECT snapshot_date, false AS is_all, store, m.metric, m.higher, CASE m.metric WHEN 'new' THEN CAST(new AS DOUBLE) "
    "WHEN 'critical' THEN CAST(critical AS DOUBLE) WHEN 'avg_rating' THEN CASE WHEN rated > 0 THEN rsum / rated END "
    f"ELSE {pct('negative', 'new')} END AS value "
    f"FROM ({_trend_grid}) CROSS JOIN (VALUES ('new', true), ('critical', false), ('avg_rating', true), "
    "('pct_negative', false)) m(metric, higher) UNION ALL "
    "SELECT snapshot_date, true, NULL, m.metric, m.higher, CAST(CASE m.metric WHEN 'new' THEN new WHEN 'critical' THEN critical "
    "WHEN 'low' THEN low WHEN 'good' THEN good WHEN 'positive' THEN positive WHEN 'negative' THEN negative ELSE without_reply END AS DOUBLE) "
    f"FROM ({_trend_all}) CROSS JOIN (VALUES ('new', true), ('critical', false), ('low', false), ('good', true), ('positive', true), "
    "('negative', false), ('without_reply', false)) m(metric, higher)")
SQL["week_over_week"] = (
    "SELECT snapshot_date, is_all, store, metric, value, prev_value, value - prev_value AS delta, "
    "CASE WHEN value - prev_value IS NULL THEN NULL WHEN value - prev_value > 0 THEN 'up' "
    "WHEN value - prev_value < 0 THEN 'down' ELSE 'unchanged' END AS direction, "
    "CASE WHEN value - prev_value IS NULL OR value - prev_value = 0 THEN NULL ELSE (value - prev_value > 0) = higher END AS is_good "
    f"FROM (SELECT *, lag(value) OVER (PARTITION BY is_all, store, metric ORDER BY snapshot_date) AS prev_value FROM ({_wow_long}))")
SQL["cumulative_rating"] = (
    "SELECT snapshot_date, store, CASE WHEN rated > 0 THEN rsum / rated END AS week_avg, "
    "CASE WHEN sum(rated) OVER w > 0 THEN sum(coalesce(rsum, 0)) OVER w / sum(rated) OVER w END AS cum_avg "
    f"FROM ({_trend_grid}) WINDOW w AS (PARTITION BY store ORDER BY snapshot_date "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_run_rows = (
    "SELECT c.*, p.prev_date, CASE WHEN c.filled THEN 'Positive' ELSE lb.sentiment END AS sentiment, "
    "CASE WHEN c.filled THEN 0.5 ELSE lb.sent_score END AS sent_score, "
    f"CASE WHEN c.filled THEN {q(FILLED_CATEGORY)} ELSE coalesce(w.categories, 'General') END AS categories "
    "FROM snapshots c JOIN sprev p ON c.snapshot_date = p.snapshot_date "
    "JOIN labeled lb ON lb.review_id = c.rid LEFT JOIN wcats w ON w.review_id = c.rid WHERE p.prev_date IS NOT NULL AND NOT EXISTS ("
    "SELECT 1 FROM snapshots x WHERE x.snapshot_date = p.prev_date AND coalesce(x.review_id, '') = coalesce(c.review_id, ''))")
SQL["weekly_run"] = (
    "SELECT snapshot_date AS as_of, prev_date, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE {cond}) AS {name}" for name, cond in [
        ("critical", "rating <= 2"), ("low", "rating = 3"), ("good", "rating >= 4"),
        ("positive", "sentiment = 'Positive'"), ("negative", "sentiment = 'Negative'"),
        ("neutral", "sentiment = 'Neutral'"), ("no_text", "sentiment = 'No Text'"),
        ("with_reply", nonblank('owner_reply')), ("without_reply", "NOT " + nonblank('owner_reply'))])
    + f", avg(rating) AS avg_rating FROM ({_run_rows}) GROUP BY snapshot_date, prev_date")
SQL["weekly_run_new_rows"] = (
    "SELECT snapshot_date AS as_of, prev_date, review_id, store, rating, sentiment, sent_score, categories, "
    f"{nonblank('owner_reply')} AS has_reply FROM ({_run_rows})")
SQL["weekly_run_by_store"] = (
    "SELECT snapshot_date AS as_of, prev_date, store, count(*) AS total, count(*) FILTER (WHERE rating <= 2) AS critical, "
    "avg(rating) AS avg_rating, count(*) FILTER (WHERE sentiment = 'Positive') AS positive, "
    f"count(*) FILTER (WHERE sentiment = 'Negative') AS negative FROM ({_run_rows}) GROUP BY snapshot_date, prev_date, store")
SQL["star_bar"] = (
    "SELECT stars, repeat('★', stars) AS star_label, cnt, pct, repeat('█', CAST(floor(pct / 5) AS INTEGER)) AS bar, "
    "repeat('█', CAST(floor(pct / 4) AS INTEGER)) AS bar_print FROM ("
    + SQL["rating_distribution"] + ") WHERE is_all")
SQL["write_report"] = " UNION ALL ".join(
    f"SELECT {q(sheet)} AS report, {q(name)} AS result, count(*) AS rows FROM ({SQL[name]})"
    for sheet, names in REPORT_SHEETS.items() for name in names)

# token table for the word counts (only used by top_words)
_TW = (f"tw AS (SELECT e.store, e.sentiment, t.w AS word FROM enriched e, "
       f"unnest(regexp_extract_all(lower(e.text), '[a-z]{{3,}}')) AS t(w) "
       f"WHERE e.has_text AND t.w NOT IN ({_stops}))")


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, body in SQL.items():
        if k in ("top_words", "write_report"):
            out[k] = "WITH " + PRELUDE.strip() + ",\n" + _TW + ",\n__q AS (\n" + body + "\n)\nSELECT * FROM __q"
        else:
            out[k] = with_prelude(body)
    return out
