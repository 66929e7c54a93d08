"""Language-model scores by deleted interpolation (operator 4).

The model mixes three estimates of a token after its predecessor,

    P(w | v) = a_b * c(v w) / c(v)  +  m_b * c(w) / N  +  z_b / (V + 1),

with weights that depend on the bucket b of the context's frequency c(v)
(by powers of two).  The weights are learned by expectation-maximisation:
counts from which a tenth of the training documents is deleted predict the
tokens of that tenth.  The model itself counts all training documents.

How the counts travel.  No task holds the model, and no row is sent per
token.  Documents are tokenised once into *batches* of some ``BATCH``
tokens, written as numbered words and a list of word hashes.  Then

1. a batch asks for the distinct words and word pairs that it holds: for
   each of ``parts`` ranges of the hashes it sends one sorted list with its
   own counts;
2. a part sums the counts of all batches and answers each list with a list
   of totals in the same order;
3. a batch and its answers meet, and every document of it is scored.

A frequent word is one entry a batch, so there are no hot keys, and a part
holds about ``PART`` entries whatever the size of the corpus.

Memory of a Python worker.  Sorting and arithmetic on the tokens of a batch
run over a range of the hashes or over ``SLICE`` tokens at a time, numbers of
words and pairs have 32 bits, and a worker opens one row at a time: besides
a batch's tokens it holds small arrays only.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end of
the text.  Words and pairs are known by 64-bit hashes.

Defined results: a null or empty text is its end token.  Every row is a
document of its own, also with a null key (counted as the empty text: held
out) or a repeated one.  Without training documents N and V are 0 and every
token has probability 1.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import GOLDEN, U, held_fold, mix, word_groups
from revlens.session import materialize

FOLDS = 10  # fold 0 is held out from all learning, fold 1 is deleted to learn the weights
BATCH, PART = 1_500_000, 1_000_000
SLICE = 1 << 17  # tokens computed with at a time
TASK_PARTS = 4  # parts a task: as many tasks, and files, as the input needs
BUCKETS = 48
STEP = 0.05  # width, in decimal logarithms, of the cells in which held-out tokens are counted
START, END = U(0x5354415254), U(0x454E44)  # stand for the start and the end among the word hashes
WORDS, PAIRS = 0, 1


def packed(x: np.ndarray) -> bytes:
    """An integer array in few bytes: byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.array(planes.T, order="C").view(kind).reshape(-1)


def slices(n: int) -> list[slice]:
    return [slice(s, min(n, s + SLICE)) for s in range(0, n, SLICE)]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and the place of each hash among them; a sixteenth of the hashes' range at a time."""
    top, place = np.empty(len(hashes), np.uint8), np.empty(len(hashes), np.uint32)
    for s in slices(len(hashes)):
        top[s] = hashes[s] >> U(60)
    found, n = [], 0
    for k in range(16):
        at = np.flatnonzero(top == k)
        own, inverse = np.unique(hashes[at], return_inverse=True)
        place[at] = inverse + n
        found.append(own)
        n += len(own)
    return np.concatenate(found), place


def one_by_one(table: pa.RecordBatch | pa.Table):
    """The rows as dicts, one at a time: their binary columns are large."""
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


# ---------------------------------------------------------------- batches

def batches_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenised documents, a row per batch; a batch holds documents of one role: 0 held out, 1 deleted, 2 others."""
    rows = docs.select(F.col(key).alias("key"), F.least(held_fold(F.col(key), FOLDS), F.lit(2)).cast("int").alias("role"),
                       F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(record_batches):
        task, made = TaskContext.get().partitionId(), 0
        open_keys, open_words, open_counts = defaultdict(list), defaultdict(list), defaultdict(list)

        def close(role):
            nonlocal made
            n = np.concatenate(open_counts.pop(role))
            words, ids = distinct(np.concatenate(open_words.pop(role)))
            rank = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")  # frequent words get small numbers
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank), dtype=np.uint32)
            for s in slices(len(ids)):
                ids[s] = place[ids[s]]
            keys = pa.concat_arrays(open_keys.pop(role))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([role], pa.int32()), pa.array([len(ids) + len(n)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                 *(pa.array([packed(x)], pa.binary()) for x in (n.astype(np.uint32), words[rank], ids))],
                ["batch", "role", "tokens", "keys", "counts", "words", "ids"])

        for b in record_batches:
            roles = np.asarray(b.column("role"))
            for first, end, counts, hashes in word_groups(b.column("text")):
                own, of = roles[first:end], np.repeat(np.arange(end - first), counts)
                for role in np.unique(own).tolist():
                    mine = np.flatnonzero(own == role)
                    open_keys[role].append(b.column("key").take(pa.array(first + mine)))
                    open_words[role].append(hashes[(own == role)[of]])
                    open_counts[role].append(counts[mine])
                    if sum(map(len, open_words[role])) + sum(map(len, open_counts[role])) >= BATCH:
                        yield close(role)
        for role in sorted(open_words):
            yield close(role)

    return rows.mapInArrow(run, f"batch long, role int, tokens long, keys array<{kind}>, counts binary, words binary, ids binary")


@dataclass
class Batch:
    """One batch: n tokens per document; number of each token's word and of its predecessor's; sorted keys of its words and pairs.

    ``word`` and ``pair`` give the place of each token's word and pair in the sorted keys; ``before`` the place of its
    predecessor's word.  The predecessor of a first token is the start, which occurs as often as the end.
    """

    n: np.ndarray
    words: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray


def opened(counts: bytes, words: bytes, ids: bytes) -> Batch:
    n, hashes, ids = unpacked(counts, np.uint32).astype(np.int64), unpacked(words, np.uint64), unpacked(ids, np.uint32)
    hashes = np.append(hashes, END)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    ends = np.cumsum(n + 1) - 1
    token = np.empty(len(ids) + len(n), np.uint32)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    for s in slices(len(ids)):
        ids[s] = place[ids[s]]
    token[inner], token[ends] = ids, place[-1]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    first = np.zeros(len(token), bool)
    first[ends - n] = True
    before[first] = place[-1]
    keys, pair_hash = hashes[order], np.empty(len(token), U)
    with np.errstate(over="ignore"):
        for s in slices(len(token)):
            left = np.where(first[s], START, keys[before[s]])
            pair_hash[s] = mix(left * U(0xD1342543DE82EF95) + keys[token[s]] + GOLDEN)
    del ids, inner, first
    return Batch(n + 1, keys, token, before, *distinct(pair_hash))


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the hashes begins among the sorted keys, and the end."""
    edges = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, U)), [len(keys)])).astype(np.int64)


# ---------------------------------------------------------------- counting

def requests(batches: DataFrame, parts: int) -> DataFrame:
    """What the batches hold of every part: sorted keys and the batch's counts."""
    def run(record_batches):
        for b in record_batches:
            for r in one_by_one(b):
                x = opened(r["counts"], r["words"], r["ids"])
                for kind, keys, place in ((WORDS, x.words, x.word), (PAIRS, x.pairs, x.pair)):
                    c, at = np.bincount(place, minlength=len(keys)).astype(np.uint32), _ranges(keys, parts)
                    on = np.flatnonzero(np.diff(at))
                    for s in range(0, len(on), 1000):
                        cut = [(at[p], at[p + 1]) for p in on[s:s + 1000]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(cut), pa.int32()), pa.array(on[s:s + 1000], pa.int32()),
                             pa.array([r["batch"]] * len(cut), pa.int64()), pa.array([r["role"]] * len(cut), pa.int32()),
                             pa.array([packed(np.diff(keys[i:j], prepend=U(0))) for i, j in cut], pa.binary()),
                             pa.array([packed(c[i:j]) for i, j in cut], pa.binary())],
                            ["kind", "part", "batch", "role", "keys", "counts"])

    return batches.select("batch", "role", "counts", "words", "ids").mapInArrow(
        run, "kind int, part int, batch long, role int, keys binary, counts binary")


_ANSWER = "kind int, part int, batch long, role int, total binary, rest binary, n long, v long, n_rest long, v_rest long"


def _answer(table: pa.Table) -> pa.Table:
    """Totals over all training documents, and over those that are not deleted, for each list; then a row (batch -1) with N and V."""
    rows = table.select(["kind", "part", "batch", "role"]).to_pylist()
    counts = [unpacked(x.as_py(), np.uint32) for x in table.column("counts")]
    at = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
    keys = np.empty(at[-1], U)
    with np.errstate(over="ignore"):
        for x, s, e in zip(table.column("keys"), at, at[1:]):
            keys[s:e] = np.cumsum(unpacked(x.as_py(), np.uint64), dtype=U)
    found, place = distinct(keys)
    del keys
    total, rest = np.zeros(len(found), U), np.zeros(len(found), U)
    for r, c, s, e in zip(rows, counts, at, at[1:]):  # a list has a key once
        for sums, least in ((total, 1), (rest, 2)):
            if r["role"] >= least:
                sums[place[s:e]] += c
    out = []
    for r, s, e in zip(rows, at, at[1:]):
        own = place[s:e]
        out.append(r | {"total": packed(total[own]), "rest": packed(rest[own]) if r["role"] == 1 else None})
    out.append({"kind": rows[0]["kind"], "part": rows[0]["part"], "batch": -1, "role": -1, "n": int(total.sum()),
                "v": int((total > 0).sum()), "n_rest": int(rest.sum()), "v_rest": int((rest > 0).sum())})
    fields = [("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("role", pa.int32()), ("total", pa.binary()),
              ("rest", pa.binary()), *((c, pa.int64()) for c in ("n", "v", "n_rest", "v_rest"))]
    return pa.Table.from_pylist(out, pa.schema(fields))


def _totals(answers: pa.Table, field: str) -> tuple[np.ndarray, np.ndarray]:
    """A batch's totals of its words and of its pairs, in the order of their sorted keys."""
    rows = sorted(answers.select(["kind", "part", field]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    return tuple(np.concatenate([unpacked(r[field], np.uint64) for r in rows if r["kind"] == k]).astype(np.float64)
                 for k in (WORDS, PAIRS))


# ---------------------------------------------------------------- mixture weights

@dataclass
class Size:
    n: int
    v: int


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of the binary logarithm of its count."""
    return np.minimum(np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0), BUCKETS - 1).astype(np.int64)


def estimates(x: Batch, words: np.ndarray, pairs: np.ndarray, size: Size, s: slice = slice(None)) -> tuple[np.ndarray, ...]:
    """Per token of a slice: bucket of its context and the pair and word estimates."""
    context = words[x.before[s]]
    return bucket(context), pairs[x.pair[s]] / np.maximum(context, 1), words[x.word[s]] / max(size.n, 1)


def _cells(size: Size):
    """Held-out tokens of a deleted batch, counted by bucket and cells of both estimates."""
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        codes, counts = [], []
        for r in one_by_one(batch.select(["counts", "words", "ids"])):
            x = opened(r["counts"], r["words"], r["ids"])
            totals = _totals(answers, "rest")
            for s in slices(len(x.word)):
                b, p2, p1 = estimates(x, *totals, size, s)
                with np.errstate(divide="ignore"):
                    q2, q1 = (np.where(p > 0, np.rint(-np.log10(p) / STEP), -1).astype(np.int64) for p in (p2, p1))
                code, n = np.unique((b << 32) + ((q2 + 1) << 16) + q1 + 1, return_counts=True)  # estimates are over 2^-64
                codes.append(code)
                counts.append(n)
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, place, np.concatenate(counts))
        cells = code >> 32, (code >> 16 & 0xFFFF) - 1, (code & 0xFFFF) - 1, n
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("bucket", "pair", "word", "n"), cells)})
    return run


def weights(cells: list[tuple[int, int, int, int]], size: Size, rounds: int = 200) -> np.ndarray:
    """Weights (pair, word, uniform) by bucket, by expectation-maximisation on cells (bucket, pair, word, tokens).

    A bucket without held-out tokens has the weights of the next lower one.
    """
    out, last = np.zeros((BUCKETS, 3)), np.array([0.0, 0.5, 0.5])
    by = defaultdict(list)
    for c in cells:
        by[c[0]].append(c)
    for b in range(BUCKETS):
        if by[b]:
            x = np.array(sorted(by[b]), np.float64)
            p = np.column_stack([np.where(x[:, k] >= 0, 10.0 ** (-STEP * x[:, k]), 0) for k in (1, 2)] + [np.full(len(x), 1 / (size.v + 1))])
            w = np.full(3, 1 / 3) if b else np.array([0, 0.5, 0.5])
            for _ in range(rounds):
                share = p * w
                new = (x[:, 3:] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / x[:, 3].sum()
                done = np.abs(new - w).max() < 1e-9
                w = new
                if done:
                    break
            last = np.maximum(w, [0, 1e-6, 1e-6])  # no token is impossible
        out[b] = last / last.sum()
    return out


# ---------------------------------------------------------------- scores

def _scored(size: Size, mixture: np.ndarray):
    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for i, r in enumerate(one_by_one(batch.select(["role", "counts", "words", "ids"]))):
            x = opened(r["counts"], r["words"], r["ids"])
            words, pairs = _totals(answers, "total")
            base = np.log10((words + 0.1) / (size.n + 0.1 * (size.v + 1)))

            def score(s):
                b, p2, p1 = estimates(x, words, pairs, size, s)
                w = mixture[b]
                return np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (size.v + 1))

            def summed(values, kind=np.float64):
                out = np.empty(len(x.word), kind)
                for s in slices(len(out)):
                    out[s] = values(s)
                return pa.array(np.add.reduceat(out, np.cumsum(x.n) - x.n))

            by_word = summed(lambda s: base[x.word[s]])
            cols = [x.n, summed(lambda s: words[x.word[s]] > 0, np.int64), by_word, summed(score) if size.n else by_word]
            keys = batch.column("keys").slice(i, 1).combine_chunks()
            parts.append(pa.table([keys.flatten(), pa.array([r["role"] == 0] * len(x.n)), *(pa.array(c) for c in cols)],
                                  names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(parts)
    return run


@dataclass
class Scores:
    """Per document scores, and what was learned for them."""

    documents: DataFrame
    size: Size
    weights: np.ndarray


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Scores:
    batches = materialize(batches_of(docs, key, text), "lm-batches")
    tokens = batches.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-tokens // PART))
    tasks = -(-parts // TASK_PARTS)
    asked = requests(batches, parts).repartition(tasks, "kind", "part")
    answers = materialize(asked.groupBy("kind", "part").applyInArrow(_answer, _ANSWER), "lm-answers")
    s = answers.filter(f"batch = -1 and kind = {WORDS}").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n_rest", "v_rest"))).first()
    size, rest = Size(s[0], s[1]), Size(s[2], s[3])
    by_batch = lambda rows: rows.repartition(tasks, "batch").groupBy("batch")
    cells = by_batch(batches.filter("role = 1")) \
        .cogroup(by_batch(answers.filter("batch >= 0 and role = 1").select("batch", "kind", "part", "rest"))) \
        .applyInArrow(_cells(rest), "bucket long, pair long, word long, n long")
    # The cells are bounded by the logarithms' range, not by the corpus.
    mixture = weights([tuple(r) for r in cells.groupBy("bucket", "pair", "word").agg(F.sum("n")).collect()], rest)
    kind = docs.schema[key].dataType.simpleString()
    mine = answers.filter("batch >= 0").select("batch", "kind", "part", "total")
    scored = by_batch(batches).cogroup(by_batch(mine)).applyInArrow(
        _scored(size, mixture), f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"),
                        "base_score", "score")
    return Scores(out, size, mixture)
