"""Registered queries of the operators: ``opN_<name>(spark, sf_dir)`` over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import cap_filters, licenses, minhash

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; it is read by the driver and sent along with the tasks."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_texts(spark))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import warc
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import url_filter
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import lm_score
    return lm_score.lm_scores(table(spark, sf_dir, "documents")).documents


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import packing
    with open(tokenizer_file(TOKENIZER), encoding="utf-8") as f:
        return packing.pack_documents(table(spark, sf_dir, "documents"), f.read())


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import quality_knn
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from revlens.llm import bpe
    with open(tokenizer_file(RANKS), "rb") as f:
        return bpe.digests(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import quality_rules
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import collocations
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import token_alignment
    with open(tokenizer_file(TOKENIZER), encoding="utf-8") as a, open(tokenizer_file(PIECE_TOKENIZER), "rb") as b:
        return token_alignment.alignments(table(spark, sf_dir, "documents"), a.read(), b.read())


def op13_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revlens.llm import binary_packing
    with open(tokenizer_file(WORD_TOKENIZER), encoding="utf-8") as f:
        return binary_packing.pack_documents(table(spark, sf_dir, "documents"), f.read())


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_warc, op3_url_filter, op4_deleted_interpolation, op5_best_fit_packing, op6_quality_rules, op7_minhash,
    op8_quality_knn, op9_bpe, op10_cap_filters, op11_collocations, op12_token_alignment, op13_binary_packing)}

#: Base 32 of a SHA-1 in hex: eight blocks of 20 bits, four letters each.
_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)
    FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (html)
"""

#: Words of a text, and the shingles of a document as strings (words hold no blank).
_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r(x, y) AS (SELECT id, id FROM nodes UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS id, min(y) AS component_id FROM r GROUP BY x)"""

_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD.format('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {{n}} THEN [array_to_string(ws[i:i + {{n}} - 1], ' ') FOR i IN range(1, len(ws) - {{n}} + 2)]
                                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {{t}} * (a.n + b.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""".format(n=minhash.WORDS, t=minhash.THRESHOLD)

_OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
k AS (SELECT vec_id, e, list_inner_product(e, e) AS s FROM v
      WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM k a JOIN k b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
          WHERE list_inner_product(a.e, b.e) / sqrt(a.s * b.s) >= {cap_filters.THRESHOLD}),
nodes AS (SELECT vec_id AS id FROM embeddings),{_REACH},
m AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT v.vec_id, coalesce(m.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN m ON m.x = v.vec_id
"""


def _op6() -> str:
    """The quality rules: base figures by lists, references by medians, distances by sums over cells."""
    from revlens.llm import quality_rules as qr
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": "[.,]", "mark": "[!?;:''\"()-]",
               "symbol": r"[#*$%&|<>+=@\[\]\\^_`{}~/]", "beyond_ascii": r"[^\x00-\x7F]"}
    count = lambda c: f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))"
    cells = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS cell, {count(c)} AS n FROM d" for k, c in classes.items())
    known = ", ".join(f"('{lang}', '{w}')" for lang, words in qr.COMMON_WORDS.items() for w in words)
    plain = f"regexp_replace({_FOLD.format('w')}, '[.,!?;:''\"()#*$%&|<>-]+$', '')"
    # Jensen-Shannon distance of the rows of h (doc_id, cell, n) from the references r (lang, cell, ref)
    distance = """SELECT h.doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist FROM (
      SELECT h.doc_id, CAST(h.n AS DOUBLE) / greatest(1, sum(h.n) OVER (PARTITION BY h.doc_id)) AS p,
        r.ref / sum(r.ref) OVER (PARTITION BY h.doc_id) AS q FROM {h} h JOIN b USING (doc_id) JOIN {r} r ON r.lang = b.lang AND r.cell = h.cell) h
      GROUP BY h.doc_id"""
    share = "quantile_cont(floor(CAST(h.n AS DOUBLE) * 1000 / {}), 0.5)"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format('text')} AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 3) AS o(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT doc_id, lang, text, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
        {count('[#*$%&|<>]')} AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        len(ws) < {qr.MIN_WORDS} OR coalesce(rep.n, 0) * 100 > len(ws) * {qr.MAX_REPEAT_PERCENT} AS base_failed
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
hc0 AS ({cells}),
hc AS (SELECT * FROM hc0 UNION ALL SELECT doc_id, 'control', any_value(length(text)) - sum(n) FROM hc0 JOIN d USING (doc_id) GROUP BY doc_id),
rc AS (SELECT lang, cell, {share.format('length(b.text)')} AS ref FROM hc h JOIN b USING (doc_id) WHERE NOT base_failed GROUP BY lang, cell),
known(lang, cell) AS (VALUES {known}),
seen AS (SELECT doc_id, {plain} AS w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
hw0 AS (SELECT b.doc_id, k.cell, coalesce(seen.n, 0) AS n FROM b JOIN known k ON k.lang = b.lang LEFT JOIN seen ON seen.doc_id = b.doc_id AND seen.w = k.cell),
hw AS (SELECT * FROM hw0 UNION ALL SELECT doc_id, '', any_value(n_words) - sum(n) FROM hw0 JOIN b USING (doc_id) GROUP BY doc_id),
rw0 AS (SELECT lang, cell, {share.format('n_words')} AS ref FROM hw0 h JOIN b USING (doc_id) WHERE NOT base_failed GROUP BY lang, cell),
rw AS (SELECT * FROM rw0 UNION ALL SELECT lang, '', greatest(0, 1000 - sum(ref)) FROM rw0 GROUP BY lang),
dc AS ({distance.format(h='hc', r='rc')}),
dw AS ({distance.format(h='hw', r='rw')})
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(dc.dist, 0) > {qr.MAX_CLASS_DISTANCE} AND length(b.text) >= {qr.MIN_CHARS_JUDGED}
    OR coalesce(dw.dist, 0) > {qr.MAX_WORD_DISTANCE} AND n_words >= {qr.MIN_WORDS_JUDGED}) AS kept
FROM b LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id)
"""


def _op11() -> str:
    """Phrase collocations: every n-gram counted on its own, all cuts joined, the longer ones that cover a phrase by position."""
    gram = lambda m: "SELECT lang, " + " || ' ' || ".join(f"ws[i + {k}]" for k in range(m)) + \
        f" AS phrase, {m} AS words FROM (SELECT lang, ws, unnest(range(1, len(ws) - {m} + 2)) AS i FROM w)"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, phrase, words, count(*) AS f FROM ({" UNION ALL ".join(gram(m) for m in range(1, 5))}) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS x FROM g WHERE words > 1 AND f >= 30),
k AS (SELECT lang, phrase, a, k, array_to_string(x[1:k], ' ') AS head, array_to_string(x[k + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, l.f AS l, r.f AS r, CAST((2000000 * CAST(k.a AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score
      FROM k JOIN g l ON l.lang = k.lang AND l.phrase = k.head JOIN g r ON r.lang = k.lang AND r.phrase = k.rest
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1),
cover AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN c b ON b.lang = s.lang AND 100 * b.a >= 80 * s.a
            AND len(string_split(s.phrase, ' ')) < b.words AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank, s.phrase, a, l, r, n, score
FROM s JOIN t USING (lang) WHERE NOT EXISTS (SELECT 1 FROM cover v WHERE v.lang = s.lang AND v.phrase = s.phrase)
QUALIFY rank <= 2000
"""


#: SQL cannot train, tokenise or learn weights: the other queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.oracle_sql(), "op2_warc": _OP2, "op6_quality_rules": _op6(),
                              "op7_minhash": _OP7, "op10_cap_filters": _OP10, "op11_collocations": _op11()}
