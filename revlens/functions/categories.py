"""Multi-label keyword tagging (P8) as a higher-order expression.

A category matches when any of its keywords is a substring of the
lower-cased text (``whole_word=True`` requires word boundaries).  Matches
keep dictionary order; no match, NULL or blank text gives ['General'].
All keywords are found in one pass by one pattern, a tree of their letters;
what was found is bound once through a one-element lambda so it is not
recomputed per category.  No join, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.schema import ANALYSIS_CATEGORIES, GENERAL_CATEGORY


_FIRST = 5  # first letters that are told apart at a time


def _tree(keywords) -> dict:
    """Keywords by their letters; "" marks the end of one."""
    root: dict = {}
    for k in keywords:
        node = root
        for letter in k:
            node = node.setdefault(letter, {})
        node[""] = {}
    return root


def _pattern(node: dict) -> str:
    """A pattern for the longest keyword of a tree."""
    ways = [re.escape(c) + _pattern(n) for c, n in sorted(node.items()) if c]
    if not ways:
        return ""
    return f"(?:{'|'.join(ways)})?" if "" in node else ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def keyword_pattern(keywords) -> str:
    """Matches, without consuming a letter, wherever a keyword begins; group 1 is the longest that begins there."""
    tree = _tree(keywords)
    firsts = sorted(tree)
    parts = [firsts[i:i + _FIRST] for i in range(0, len(firsts), _FIRST)]
    return "(?=(" + "|".join(f"(?=[{''.join(map(re.escape, p))}]){_pattern({c: tree[c] for c in p})}" for p in parts) + "))"


def category_list(text, categories=ANALYSIS_CATEGORIES, whole_word: bool = False, lowered: bool = False) -> Column:
    """ARRAY<STRING> of matched categories in dictionary order.

    ``lowered=True`` when ``text`` is already lower-cased (shared with the
    sentiment tokens, so the text is lower-cased once per row).
    """
    text = F.col(text) if isinstance(text, str) else text
    general = F.array(F.lit(GENERAL_CATEGORY))
    if whole_word:
        # one literal pattern per category: compiled once, evaluated in codegen
        low = text if lowered else F.lower(text)
        hits = F.array(*[
            F.when(low.rlike(r"\b(?:" + "|".join(r"\Q" + k.lower() + r"\E" for k in kws) + r")\b"), F.lit(name))
            for name, kws in categories
        ])
        names = F.filter(hits, lambda x: x.isNotNull())
        return F.element_at(F.transform(F.array(names), lambda m: F.when(F.size(m) > 0, m).otherwise(general)), 1)

    every = sorted({k.lower() for _, kws in categories for k in kws} - {""})
    # a keyword inside a longer one that was found there is found as well
    holding = [(name, [f for f in every if any(k.lower() in f for k in kws)], "" in kws) for name, kws in categories]
    low = text if lowered else F.lower(text)
    found = F.regexp_extract_all(low, F.lit(keyword_pattern(every)), 1) if every else F.array().cast("array<string>")

    def tag(found):
        hits = [F.when(low.isNotNull() if always else F.arrays_overlap(found, F.array(*map(F.lit, held))), F.lit(name))
                for name, held, always in holding if held or always]
        names = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")
        # bind the match list once more so the emptiness test does not re-run it
        return F.element_at(F.transform(F.array(names), lambda m: F.when(F.size(m) > 0, m).otherwise(general)), 1)

    return F.coalesce(F.element_at(F.transform(F.array(F.array_distinct(found)), tag), 1), general)


def joined(categories_col, sep: str = ", ") -> Column:
    return F.array_join(categories_col, sep)


def split_joined(joined_col, sep: str = ", ") -> Column:
    """Legacy joined string back to an array; parts stripped, blank -> General."""
    c = F.col(joined_col) if isinstance(joined_col, str) else joined_col
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(sep)), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: p != "")
    general = F.array(F.lit(GENERAL_CATEGORY))
    return F.element_at(F.transform(F.array(parts), lambda m: F.when(F.size(m) > 0, m).otherwise(general)), 1)
