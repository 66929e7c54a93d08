"""Licence scans by canonical digest (operator 1, DataFrame functions only).

A text is brought to a canonical form: copyright lines go, letters are
lower-cased, everything but letters and digits separates words, and
equivalent spellings become one.  Its SHA-256 is looked up among the digests
of known licences by a hash join, so only entire texts match: a licence
within a longer text does not.  Two kinds of texts of a document are looked
up: the whole document, and each of its lines against short notices such as
"Licensed under the Apache License, Version 2.0.".

Defined results: a null or empty text, or one of separators and copyright
lines only, has no words; its digest is null and it matches nothing.  Every
row is one result row, also with a null or repeated key; rows that agree in
key and text share their notices.  Other columns are not read.
Known texts that are null, empty or the same after all (several ids for one
digest) count under the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import salted_left_join

# Spellings that licence matching guidelines hold equivalent; the second stands for both.
EQUIVALENTS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"),
    ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"),
]
# Lines that only state a copyright: a marker and a year or name, or the reservation of rights.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n©]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}\n]*[0-9]{4}|©|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
SEPARATORS = r"[^\p{L}\p{N}]+"


# ---------------------------------------------------------------- known texts

_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
          "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
          "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
          "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
          "substantial portions of the Software.\n\n")
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
          "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
          "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                   "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                   "following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                   "the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n")
_NO_ENDORSEMENT = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                   "from this software without specific prior written permission.\n\n")
_CONTRIBUTORS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
                 "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
                 "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
                 "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
                 "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
                 "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Whole licence texts by SPDX id, without title and copyright line.
TEXTS = {
    "MIT": _GRANT + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC,
    "BSD-2-Clause": _REDISTRIBUTION + _CONTRIBUTORS,
    "BSD-3-Clause": _REDISTRIBUTION + _NO_ENDORSEMENT + _CONTRIBUTORS,
}
#: Titles under which a whole text may stand.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License",
          "BSD-3-Clause": "BSD 3-Clause License"}
#: Digests of longer whole texts by SPDX id, in the wording of Debian's common-licenses: with title, with http or https in all
#: links, with and without the part after the terms (Apache-2.0, GPL), and Apache-2.0 also with its appendix filled in.
DIGESTS = {
    "Apache-2.0": ["549d687d2eac9867ac7ae27252846a4f54c0699f24a41489db3da26b1d6e5540",
                   "317a99ee85f22bfb10af27f4d60e2ceadeec469cf6e715bdfd57fdc6ce51ba68",
                   "8119d65c52d522e7b934817d2acd0661da12200ca5c3c635c0d1638d7f482c3f",
                   "93efa507673d0ba5d573df4ca138d9b10106f9f66a3a63b9a0b5e694c9e04d72",
                   "8ccd7e2a87a615f12cc6b52b15625795b28c6d737d01b85bd89a974aaaf94ae8",
                   "28c248de7107bfab66935a67c5bc727d2fdcf8b63323e678c81dc0fd9c652072"],
    "GPL-2.0": ["64a86f1d3531a8b5c1d2f564c01882c63b58c93fbfb517279bfaa9a261cb1796",
                "b6d9bbc37df0f1f9eeaf989865222e8e8149d2661426763e656d1b7b18a8d9da"],
    "GPL-3.0": ["1762992c0f76994ca6cd4de78ffa1345f8e322e1a230f87cf23660dac7bf8314",
                "fbf4c7854913caaf09c170805455959454d9447e36e4d6495f74d232da3fc175",
                "0146dac78c87756d210fd3b26508bf1a3c85bb775a7a1fd6d471f4201103d236"],
    "LGPL-3.0": ["572947626844a56d29ace510237040204d4085696621f319533ca366aa897913"],
    "MPL-2.0": ["085a00a7d5f35fd39ee7b08052486f5758ccc298a989a6393e2ce3ead8160650",
                "46738f25034c2eb15203b7488e7a33141480a41a2cc5c0c1c6da836cc587fb21"],
    "CC0-1.0": ["5caa6b96e2c9f66e9ca02d726096312a8662a9c4fea6446ff24fee66902e58dc"],
}
#: Names in short notices by SPDX id.
NAMES = {
    "MIT": ["MIT", "MIT License"], "ISC": ["ISC", "ISC License"], "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License"], "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License"],
    "GPL-2.0": ["GPL-2.0", "GPLv2", "GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GPL-3.0", "GPLv3", "GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["LGPL-3.0", "LGPLv3", "GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["AGPL-3.0", "AGPLv3", "GNU Affero General Public License, version 3"], "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0"], "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "CC BY-NC 4.0"], "CC-BY-ND-4.0": ["CC-BY-ND-4.0", "CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"], "CC-BY-NC-ND-4.0": ["CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"],
}
FORMS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}",
         "This work is licensed under the {}", "This project is licensed under the {}", "License: {}", "SPDX-License-Identifier: {}"]


def known_rows() -> list[tuple[str, str, str]]:
    """(licence id, kind, text) of all known texts: whole licences with and without title, and notices by form and name."""
    rows = [(k, "text", t) for k, t in TEXTS.items()] + [(k, "text", f"{TITLES[k]}\n\n{t}") for k, t in TEXTS.items()]
    return rows + [(k, "notice", form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS]


def known_texts(spark: SparkSession) -> DataFrame:
    """The known texts as a table whose size Spark knows."""
    rows = [(*map(_quoted, r), "CAST(NULL AS STRING)") for r in known_rows()]
    rows += [(_quoted(k), "'text'", "CAST(NULL AS STRING)", _quoted(d)) for k, ds in DIGESTS.items() for d in ds]
    values = ", ".join("(" + ", ".join(r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS k(licence, kind, text, digest)")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------- canonical form and scan

def canonical(text: Column) -> Column:
    """The canonical form of a text: its words, each between two blanks; empty without words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(COPYRIGHT_LINE), F.lit(""))
    t = F.regexp_replace(F.concat(F.lit(" "), F.lower(t), F.lit(" ")), F.lit(SEPARATORS), F.lit("  "))
    for old, new in EQUIVALENTS:  # words stand between two blanks each, so neighbours do not share one
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(t)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form in hex; empty for a text without words."""
    c = canonical(text)
    return F.coalesce(F.sha2(F.nullif(c, F.lit("")), 256), F.lit(""))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, digest, licence (of the whole text, or null), notices (licences of lines that are notices, sorted).

    ``known`` has licence, kind and text; its column digest, if there is one, stands for the text where it is not null.
    """
    given = [F.col("digest")] if "digest" in known.columns else []
    known = known.select("licence", "kind", F.coalesce(*given, digest(F.col("text"))).alias("digest")).filter("digest != ''") \
        .groupBy("kind", "digest").agg(F.min("licence").alias("licence"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    texts = known.filter("kind = 'text'").select("digest", "licence")
    whole = salted_left_join(rows.select("key", "hash", digest(F.col("text")).alias("digest")), texts, ["digest"], F.col("key"))
    # Lines: only the matching ones leave the join, so what is gathered by document is small.
    lines = rows.select("key", "hash", F.explode(F.split("text", "\n")).alias("line")) \
        .select("key", "hash", digest(F.col("line")).alias("line_digest"))
    notices = known.filter("kind = 'notice'").select(F.col("digest").alias("line_digest"), "licence")
    found = salted_left_join(lines, notices, ["line_digest"], F.xxhash64("key", "hash")).filter("licence is not null") \
        .groupBy(F.col("key").alias("_key"), F.col("hash").alias("_hash")).agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    out = whole.join(found, F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash")), "left")
    return out.select(F.col("key").alias(key), F.nullif("digest", F.lit("")).alias("digest"), "licence", F.array_join("notices", ",").alias("notices"))


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(t: str) -> str:
        t = f"regexp_replace(coalesce({t}, ''), {quote(COPYRIGHT_LINE)}, '', 'g')"
        t = f"regexp_replace(' ' || lower({t}) || ' ', {quote(SEPARATORS)}, '  ', 'g')"
        for old, new in EQUIVALENTS:
            a, b = (quote(f" {x.replace(' ', '  ')} ") for x in (old, new))
            t = f"replace({t}, {a}, {b})"
        return f"trim({t})"

    values = ",\n".join(f"({quote(a)}, {quote(b)}, {quote(t)})" for a, b, t in known_rows())
    return f"""
WITH known AS (SELECT kind, sha256({form('text')}) AS digest, min(licence) AS licence FROM (VALUES {values}) AS k(licence, kind, text) GROUP BY 1, 2),
d AS (SELECT doc_id, text, nullif({form('text')}, '') AS c FROM documents),
l AS (SELECT doc_id, sha256({form('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS notices
      FROM (SELECT DISTINCT l.doc_id, k.licence FROM l JOIN known k ON k.kind = 'notice' AND k.digest = l.digest) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c IS NOT NULL THEN sha256(c) END AS digest, k.licence, n.notices
FROM d LEFT JOIN known k ON k.kind = 'text' AND k.digest = sha256(c) LEFT JOIN n ON n.doc_id = d.doc_id
"""
