"""URL filter: rule lists and gradient-boosted trees on lexical features (operator 3, DataFrame functions only).

A URL that a rule fits has that rule's verdict.  All others are judged by
boosted trees.  They are trained from labelled URLs, for which the query
takes those that the rules decide, and see only the text of a URL: lengths,
depth, share of digits, entropy, parameters, and what the labelled sample
says about the host's last label (how often it occurs, how often blocked).

Training is a series of small aggregations.  Features are cut into at most
``BINS`` bins at quantiles of a bounded sample (``MAX_TRAIN`` labelled URLs
with the smallest hash); a level of a tree is one grouped sum of gradients
by node, feature and bin, of which only these sums (a few hundred numbers)
come to the driver.  Gradients are summed as integers, so the trees do not
depend on the order of rows.  Scoring is one projection over all URLs and a
broadcast of the statistics by last label, which has at most as many rows
as the sample.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by its features like others.  Every row is
judged, also with a null or repeated key.  Without labelled URLs every URL
is allowed; with labels of one kind only, all get that verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import materialize

MAX_TRAIN = 20_000
BINS, ROUNDS, DEPTH = 16, 12, 2
RATE, RIDGE, LEAST = 0.3, 1.0, 20  # learning rate, ridge on leaf weights, rows in a leaf
PRIOR_ROWS = 20.0  # rows of the overall share that a last label's share starts from
UNIT = 1_000_000  # gradients are summed in millionths
#: (verdict, rule): the rule's host is up to its first slash, its path from there on.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


# ---------------------------------------------------------------- parts of a URL and rules

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to a query or fragment)."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, whole, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits host and path, as (length, rule, verdict); null if none fits."""
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(*found, none) if found else none


# ---------------------------------------------------------------- features

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "hyphens", "digits", "entropy", "parameters", "suffix_rows", "suffix_blocked"]


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the lexical features of its column ``url`` (with host and path beside it) and the host's last label."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    # Entropy of the characters in thousandths of a bit, from the count of each distinct one.
    share = lambda c: (n - F.length(F.replace(u, c))) / n
    bits = F.aggregate(F.filter(F.array_sort(F.array_distinct(F.split(u, ""))), lambda c: c != ""), F.lit(0.0),
                       lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    dots = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what)))
    return df.withColumns({
        "length": n, "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "labels": F.when(F.col("host") == "", 0).otherwise(dots(F.col("host"), ".") + 1), "hyphens": dots(F.col("host"), "-"),
        "digits": F.when(n > 0, F.floor((n - F.length(F.regexp_replace(u, "[0-9]", ""))) * 1000 / n)).otherwise(0),
        "entropy": F.round(bits * 1000),
        "parameters": F.when(query == "", 0).otherwise(dots(query, "&") + 1),
        "suffix": F.substring_index("host", ".", -1),
    }).withColumns({c: F.col(c).cast("int") for c in FEATURES[:9]})


def _share(blocked: Column, n: Column, prior: float) -> Column:
    """Share of blocked rows in thousandths, drawn towards the overall share."""
    return F.round((blocked + prior * PRIOR_ROWS) * 1000 / (n + PRIOR_ROWS)).cast("int")


# ---------------------------------------------------------------- boosting

@dataclass
class Node:
    """A leaf's weight, or a split: feature <= cut goes left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


@dataclass
class Model:
    """Trees on FEATURES, their start, and the table (suffix, n, blocked) of the sample."""

    start: float
    prior: float
    suffixes: DataFrame | None
    trees: list[Node] = field(default_factory=list)


def tree_value(node: Node, columns: list[Column]) -> Column:
    if node.left is None:
        return F.lit(node.value)
    return F.when(columns[node.feature] <= node.cut, tree_value(node.left, columns)).otherwise(tree_value(node.right, columns))


def margin(model: Model, columns: list[Column]) -> Column:
    total = F.lit(model.start)
    for t in model.trees:
        total = total + tree_value(t, columns)
    return total


def best_split(sums: dict[tuple[int, int], tuple[int, int, int]], cuts: list[list[float]]) -> tuple[int, int] | None:
    """The (feature, bin) after which a split gains most, from sums (gradient, curvature, rows) by feature and bin; None if none gains."""
    gain_of = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    best, most = None, 1e-9
    for f, own in enumerate(cuts):
        cells = [sums.get((f, b), (0, 0, 0)) for b in range(len(own) + 1)]
        g, h, n = (sum(c[i] for c in cells) for i in range(3))
        lg = lh = ln = 0
        for b in range(len(own)):
            lg, lh, ln = lg + cells[b][0], lh + cells[b][1], ln + cells[b][2]
            if ln >= LEAST and n - ln >= LEAST:
                gain = gain_of(lg, lh) + gain_of(g - lg, h - lh) - gain_of(g, h)
                if gain > most:
                    best, most = (f, b), gain
    return best


def _weight(sums: dict, f: int, bins: range) -> float:
    g, h = (sum(sums.get((f, b), (0, 0, 0))[i] for b in bins) for i in (0, 1))
    return -RATE * g / (h + RIDGE * UNIT)


def train(labelled: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Train on rows (url, host, path, blocked 0/1), ``most`` of them at most."""
    rows = labelled.filter(F.col("blocked").isin(0, 1)).orderBy(F.xxhash64("url"), "url", "blocked").limit(most)
    rows = materialize(lexical(rows).drop("host", "path", "url"), "url-sample")
    total, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    prior = blocked / total if total else 0.0
    if not 0 < prior < 1:
        return Model(-10.0 if prior < 0.5 else 10.0, prior, None)
    stats = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    # A training row's share is that of the other rows, so it does not tell its own label.
    rows = rows.join(F.broadcast(stats), "suffix").withColumn("suffix_rows", F.col("n").cast("int")) \
        .withColumn("suffix_blocked", _share(F.col("b") - F.col("blocked"), F.col("n") - 1, prior))
    inner = [i / BINS for i in range(1, BINS)]
    quantiles = rows.agg(*(F.percentile(c, F.array(*map(F.lit, inner))).alias(c) for c in FEATURES)).first()
    cuts = [sorted(set(quantiles[c])) for c in FEATURES]
    bin_of = lambda c, own: sum(((F.col(c) > x).cast("int") for x in own), F.lit(0))
    rows = materialize(rows.select("blocked", *(bin_of(c, own).alias(f"b{i}") for i, (c, own) in enumerate(zip(FEATURES, cuts)))), "url-bins")
    model = Model(math.log(prior / (1 - prior)), prior, materialize(stats.select("suffix", "n", "b"), "url-suffixes"))
    binned = Model(model.start, prior, None)  # the same trees on bins
    columns = [F.col(f"b{i}") for i in range(len(FEATURES))]
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-margin(binned, columns)))
        graded = rows.withColumn("p", p).withColumns({
            "g": F.round((F.col("p") - F.col("blocked")) * UNIT).cast("long"),
            "h": F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long")})
        raw, small = Node(), Node()
        leaves = [(raw, small, F.lit(True))]
        for _ in range(DEPTH):
            node = F.coalesce(*(F.when(where, F.lit(i)) for i, (_, _, where) in enumerate(leaves)))
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), c.alias("bin")) for i, c in enumerate(columns)))).alias("cell")
            found = graded.select(node.alias("node"), "g", "h", cells).filter("node is not null") \
                .groupBy("node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
            grown = []
            for i, (a, b, where) in enumerate(leaves):
                sums = {(r["cell"]["f"], r["cell"]["bin"]): (r["g"], r["h"], r["n"]) for r in found if r["node"] == i}
                split = best_split(sums, cuts)
                if split is None:
                    continue
                f, cut = split
                sides = (_weight(sums, f, range(cut + 1)), _weight(sums, f, range(cut + 1, len(cuts[f]) + 1)))
                for node_, at in ((a, cuts[f][cut]), (b, cut)):
                    node_.feature, node_.cut, node_.left, node_.right = f, at, Node(sides[0]), Node(sides[1])
                grown += [(a.left, b.left, where & (columns[f] <= cut)), (a.right, b.right, where & (columns[f] > cut))]
            leaves = grown
            if not leaves:
                break
        if raw.left is None:
            break
        model.trees.append(raw)
        binned.trees.append(small)
    return model


# ---------------------------------------------------------------- filter

def judge(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (url, host, path, ...) with blocked_probability by the trees."""
    rows = lexical(urls)
    if model.suffixes is not None:
        rows = rows.join(F.broadcast(model.suffixes), "suffix", "left")  # no more rows than the sample
        n, b = (F.coalesce(c, F.lit(0)) for c in ("n", "b"))
        rows = rows.withColumn("suffix_rows", n.cast("int")).withColumn("suffix_blocked", _share(b, n, model.prior))
    return rows.withColumn("blocked_probability", 1 / (1 + F.exp(-margin(model, [F.col(c) for c in FEATURES]))))


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES,
               labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, blocked_probability) of every row.

    ``labelled`` has columns url and blocked (0/1); without it the URLs that
    the rules decide are the labelled ones.
    """
    parted = lambda df: df.withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")))))
    rows = parted(pages.select(F.col(key).alias("key"), F.col(url).alias("url"))) \
        .withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.filter("match is not null").select("url", "host", "path", (F.col("match.verdict") == "block").cast("int").alias("blocked"))
    else:
        known = parted(labelled.select("url", F.col("blocked").cast("int").alias("blocked")))
    out = judge(rows, train(known))
    verdict = F.coalesce("match.verdict", F.when(F.col("blocked_probability") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "blocked_probability")
