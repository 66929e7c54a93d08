"""Best-fit packing of tokenised documents into fixed-length sequences (operator 5).

Pattern packing by non-negative least squares:

1. documents become pieces of at most ``size`` tokens; the histogram of
   piece lengths has ``size`` cells however many documents there are;
2. patterns of up to ``DEPTH`` lengths on a grid that fill a sequence are
   enumerated; non-negative least squares fits how often each is used to
   the histogram; the counts are rounded;
3. each pattern takes remaining lengths of its grid cells that fill a
   sequence exactly; what is left is fitted again, ``ROUNDS`` times;
4. the residual pieces are packed best-fit decreasing, together with those
   of as few patterns as it takes to need no more sequences than best-fit
   decreasing alone would.

All of it works on lengths with counts, never on single documents: the plan
has a bounded number of rows, and pieces of equal length are
interchangeable.  A piece's place follows from its rank among the pieces of
its length, which is counted in parts, so a length that a third of all
pieces share is no single task's work.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import text_bytes
from revlens.session import materialize

SIZE = 2048
DEPTH = 3
GRID = 128  # cells of the length grid
ROUNDS = 3  # fits, each to what the one before has left
RELEASED = (0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1)  # shares of the patterns that are given back, in the order tried
RANK_ROWS = 1_000  # pieces ranked in one part, about
PART_BLOCK = 1_024  # parts whose counts are summed together
MAX_ROWS = 500


# ---------------------------------------------------------------- tokens

@lru_cache(maxsize=2)
def _tokenizer(model: str):
    """(tokenizers.Tokenizer, tiktoken encoders of the same vocabulary or None, strings of its special tokens).

    A plain byte-level BPE gives the same ids in tiktoken, seven times
    faster; any other kind of model is run by ``tokenizers`` itself.  The
    second encoder is for texts whose white space stands alone: there its
    pattern needs no look-ahead, which is slow.
    """
    import tiktoken
    from tokenizers import Tokenizer
    spec = json.loads(model)
    tok, special = Tokenizer.from_str(model), [t["content"] for t in spec.get("added_tokens", [])]
    pre, bpe = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (bpe.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
             and pre.get("use_regex", True) and not spec.get("normalizer") and not bpe.get("dropout")
             and not bpe.get("ignore_merges") and not bpe.get("byte_fallback"))
    if not plain:
        return tok, None, special
    # The byte-level alphabet (printable bytes stand for themselves, the others from 256 on) and the pre-token pattern.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in set(own))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(alphabet[c] for c in t): n for t, n in bpe["vocab"].items() if t not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in bpe["merges"]]
    ids = [bpe["vocab"]["".join(m.split(" "))] for m in merged]
    if ids != sorted(ids):  # ids do not give the order of merges
        return tok, None, special
    return tok, tuple(tiktoken.Encoding("vocab", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                      for p in (pattern, pattern.replace(r"|\s+(?!\S)", ""))), special


def lone_spaces(texts: pa.Array) -> np.ndarray:
    """Which texts surely have no two white-space characters side by side (none beyond ASCII at all)."""
    data, off = text_bytes(texts)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    beyond = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # first bytes of the white space beyond ASCII
    found = np.concatenate(([0], np.cumsum((space & np.append(space[1:], False)) | beyond)))
    return found[off[1:]] == found[off[:-1]]


def token_ids(model: str, text: str | None, lone: bool = False) -> np.ndarray:
    """The ids that ``tokenizers`` gives for a text (no special tokens added); ``lone`` as in ``lone_spaces``."""
    tok, fast, special = _tokenizer(model)
    if not text:
        return np.zeros(0, np.uint32)
    if fast is None or any(s in text for s in special):
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast[lone].encode_ordinary(text), np.uint32)  # its encode_to_numpy also looks for special tokens


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first of a longer document may be shorter than ``size``."""
    first = n if n <= size else (n % size or size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, model: str, size: int = SIZE, end_id: int = 0, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32 (and ids).

    A document is its ids, then ``end_id``; a null or empty text is the end
    alone.  Every input row gives its own pieces, also if its key repeats.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, MAX_ROWS):
                part, out = b.slice(at, MAX_ROWS), defaultdict(list)
                for r, (t, lone) in enumerate(zip(part.column(1).to_pylist(), lone_spaces(part.column(1)).tolist())):
                    ids = np.append(token_ids(model, t, lone), np.uint32(end_id)).astype("<u4")
                    for p, (s, n) in enumerate(piece_bounds(len(ids), size)):
                        own = ids[s: s + n]
                        for c, v in zip(("row", "piece", "start", "length", "crc"), (r, p, s, n, zlib.crc32(own.tobytes()))):
                            out[c].append(v)
                        if with_ids:
                            out["ids"].append(own.astype(np.int32))
                cols = [part.column(0).take(pa.array(out["row"], pa.int32())), pa.array(out["piece"], pa.int32()),
                        *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc"))]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["key", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    extra = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long{extra}") \
        .withColumnRenamed("key", key)


# ---------------------------------------------------------------- plan over the histogram

def patterns(cells: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``depth`` grid lengths that add up to ``cells``."""
    if depth == 1:
        return [(cells,)]
    out = []

    def grow(left: int, most: int, head: tuple[int, ...]) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(head)) >= left:
                    grow(left - x, x, (*head, x))

    grow(cells, cells, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 4_000) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used, gram, rhs = np.zeros(n), np.zeros(n, bool), a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0)))
    for _ in range(rounds):
        slope = rhs - gram @ x
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if not slope[j] > tol:
            break
        used[j] = True
        while True:
            on = np.flatnonzero(used)
            s = np.linalg.lstsq(gram[np.ix_(on, on)], rhs[on], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            low = s <= 0
            step = (x[on][low] / (x[on][low] - s[low])).min()
            x[on] += step * (s - x[on])
            x[on[(x[on] <= 1e-12)]] = 0
            used &= x > 0
            if not used.any():
                break
    return x


def plan(histogram: dict[int, int], size: int = SIZE, depth: int = DEPTH, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many times); uses every piece of the histogram once.

    Patterns first, then best-fit decreasing for what they leave.  Patterns
    can take short pieces that the rest would need to fill up: those with
    the shortest pieces are given back, ``RELEASED`` of them at a time, until
    the plan needs no more sequences than best-fit decreasing alone.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= size for n in left):
        raise ValueError("lengths must be between 1 and the sequence size")
    whole = left.pop(size, 0)
    plain = sum(c for _, c in best_fit({}, dict(left), size))
    made = fit_patterns(left, size, depth, grid)
    for share in RELEASED:
        kept, pool, back = dict(made), defaultdict(int, left), round(share * sum(made.values()))
        for p in made:
            for n in p:
                pool[n] -= made[p]
        for p in sorted(made, key=lambda p: (min(p), p)):
            k = min(back, kept[p])
            kept[p], back = kept[p] - k, back - k
            for n in p:
                pool[n] += k
        rest = best_fit({}, {n: c for n, c in pool.items() if c > 0}, size)
        if sum(kept.values()) + sum(c for _, c in rest) <= plain:
            break
    packed = defaultdict(int, {(size,): whole})
    for p, c in [*kept.items(), *rest]:
        packed[p] += c
    return [(p, c) for p, c in packed.items() if c > 0]


def fit_patterns(histogram: dict[int, int], size: int, depth: int, grid: int) -> dict[tuple[int, ...], int]:
    """Full sequences by patterns: repeat counts by non-negative least squares, rounded and realised; ``ROUNDS`` times on what is left."""
    left, made = dict(histogram), defaultdict(int)
    cell = -(-size // grid)
    cells = -(-size // cell)
    for _ in range(ROUNDS):
        by_cell = defaultdict(int)  # grid cell -> its pieces
        for n, c in left.items():
            by_cell[-(-n // cell)] += c
        shapes = [p for p in patterns(cells, depth) if all(c in by_cell for c in p)]
        if not shapes:
            break
        a = np.zeros((cells, len(shapes)))
        for j, p in enumerate(shapes):
            for c in p:
                a[c - 1, j] += 1
        times = np.round(nnls(a, np.array([by_cell.get(c, 0) for c in range(1, cells + 1)], float))).astype(np.int64)
        held = sorted(left)  # lengths of which pieces remain
        for j in np.argsort(-times, kind="stable"):
            r = int(times[j])
            while r > 0:
                take, k = _realise(shapes[j], left, held, cell, size)
                if not k:
                    break
                k = min(k, r)
                made[take] += k
                r -= k
                for n in take:
                    left[n] -= k
                    if left[n] == 0:
                        held.remove(n)
                        del left[n]
    return dict(made)


def _realise(shape: tuple[int, ...], left: dict[int, int], held: list[int], cell: int, size: int) -> tuple[tuple[int, ...], int]:
    """Lengths for a pattern that fill a sequence, and how often all of them last; 0 times if there are none.

    Each is one of its grid cell, longer ones first; the last one is what
    is then missing, whatever its cell.
    """
    def grow(i: int, take: tuple[int, ...], room: int) -> tuple[int, ...]:
        if i == len(shape) - 1:
            return (*take, room) if left.get(room, 0) > take.count(room) else ()
        at = bisect_right(held, min(room, shape[i] * cell)) - 1
        while at >= 0 and held[at] > (shape[i] - 1) * cell:
            n, at = held[at], at - 1
            if left[n] > take.count(n) and (got := grow(i + 1, (*take, n), room - n)):
                return got
        return ()

    take = tuple(sorted(grow(0, (), size), reverse=True))
    return take, min((left[n] // take.count(n) for n in set(take)), default=0)


def best_fit(bins: dict[tuple[int, ...], int], left: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths and counted bins: longest lengths first, each into the fullest bin that holds it."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for b, c in bins.items():
        room[size - sum(b)][b] = c
    spaces = sorted(room)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c > 0:
            at = bisect_left(spaces, n)
            if at == len(spaces):  # new sequences, each with as many copies as fit
                each = size // n
                full, rest = divmod(c, each)
                for b, k in (((n,) * each, full), ((n,) * rest, 1 if rest else 0)):
                    if k:
                        s = size - n * len(b)
                        if s not in room or not room[s]:
                            room[s] = {}
                            insort(spaces, s)
                        room[s][b] = room[s].get(b, 0) + k
                break
            s = spaces[at]
            b, k = next(iter(room[s].items()))
            use = min(c, k)
            c -= use
            if use == k:
                del room[s][b]
                if not room[s]:
                    del room[s]
                    spaces.pop(at)
            else:
                room[s][b] = k - use
            if s - n not in room:
                room[s - n] = {}
                insort(spaces, s - n)
            wider = (*b, n)
            room[s - n][wider] = room[s - n].get(wider, 0) + use
    return [(b, c) for held in room.values() for b, c in held.items()]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, runs of ranks: from ``rank0`` on, rank r lies in sequence ``seq0 + r - rank0`` at ``offset``."""
    rows, used, seq = [], defaultdict(int), 0
    for lengths, times in packed:
        at = 0
        for n in lengths:
            rows.append((n, used[n], seq, at))
            used[n] += times
            at += n
        seq += times
    return pd.DataFrame(rows, columns=["length", "rank0", "seq0", "offset"]).astype("int64") \
        .sort_values(["length", "rank0"], ignore_index=True)


# ---------------------------------------------------------------- placing

def pack(parts: DataFrame, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """``parts`` (a written table of pieces: key, piece, length, ...) with sequence_id and offset."""
    counts = parts.groupBy("length").count().collect()  # at most ``size`` rows
    hist = {r["length"]: r["count"] for r in counts}
    table = slots(plan(hist, size))
    # Rank within a length: parts by hash for the frequent lengths, then the parts' offsets, then a window within each part.
    shares = [x for n, c in sorted(hist.items()) if c > RANK_ROWS for x in (F.lit(n), F.lit(-(-c // RANK_ROWS)))]
    share = F.coalesce(F.create_map(*shares)[F.col("length")], F.lit(1)) if shares else F.lit(1)
    dealt = parts.withColumn("_part", F.pmod(F.xxhash64(key, "piece", "start"), share).cast("int"))
    # what lies ahead of a part: within its block of parts, and before the block
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_part") / PART_BLOCK))
    blocks = counts.groupBy("length", "_block").agg(F.sum("_n").alias("_n")) \
        .select("length", "_block", before(Window.partitionBy("length").orderBy("_block")).alias("_blocks"))
    ahead = counts.withColumn("_in", before(Window.partitionBy("length", "_block").orderBy("_part"))).join(blocks, ["length", "_block"]) \
        .select("length", "_part", (F.col("_in") + F.col("_blocks")).alias("_ahead"))
    within = Window.partitionBy("length", "_part").orderBy(key, "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(ahead, ["length", "_part"]) \
        .withColumn("_rank", F.col("_rank") + F.col("_ahead")).drop("_part", "_ahead")
    lengths, rank0, seq0, offset = (table[c].to_numpy() for c in ("length", "rank0", "seq0", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lo, hi = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
        r = rank.to_numpy()
        while True:  # binary search for the last run that begins at or before the rank, all rows at once
            wide = hi - lo > 1
            if not wide.any():
                break
            mid = (lo + hi) // 2
            up = wide & (rank0[np.minimum(mid, len(rank0) - 1)] <= r)
            lo, hi = np.where(up, mid, lo), np.where(wide & ~up, mid, hi)
        return pd.DataFrame({"sequence_id": seq0[lo] + r - rank0[lo], "offset": offset[lo]})

    return ranked.withColumn("_place", place("length", "_rank")).select("*", "_place.*").drop("_place", "_rank")


def pack_documents(docs: DataFrame, model: str, size: int = SIZE, key: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents.

    Returns per piece: key, piece, start, length, ids_crc32, sequence_id,
    offset (and the ids with ``with_ids``).  No documents give no rows.
    """
    parts = materialize(pieces(docs, model, size, key=key, text=text, with_ids=with_ids), "pack-pieces")
    packed = pack(parts, size, key)
    cols = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return packed.select(*cols)
