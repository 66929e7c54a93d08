"""Alignment of two tokenizers' ids over the same bytes (operator 12).

A text is encoded by a byte-level BPE (A) and a piece model (B).  The
cumulative byte ends of the tokens are keys of two dictionaries, end ->
number of tokens; the keys that both hold, found by hash-set intersection
and sorted, cut both id lists into groups.  Every A id of a group is linked
with every B id of it.

Corpus statistics follow in three steps:

1. a batch of documents is aligned and its links are written, per document
   the distinct id pairs with their number of links;
2. each batch names its distinct pairs with the number of its documents that
   hold them; sums over the batches give a pair's count, and the highest
   count of an A id marks its best pairs;
3. the counts go back to the batches that named the pairs, by a salted join,
   and every document sums over its links.

A frequent pair is one row per batch, never one per document.  A large
group is expanded by its distinct ids with multiplicities, not by
occurrences, so a text on which the tokenizers never agree stays small.

Defined results: texts that are null or empty, or that a tokenizer does not
give back byte for byte after one space, have no tokens: zeros and an empty
digest.  Special tokens' strings inside texts are plain text.  Every input
row is a document of its own, also when its key is null or repeated; other
columns are not read, whatever their names.  B cuts a very long text before
blanks, where no piece can span, to the same ids.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import salted_left_join
from revlens.llm.packing import _tokenizer as byte_tokenizer
from revlens.session import materialize

BATCH_ROWS = 4_000  # documents whose pairs are named together
BATCH_BYTES = 1 << 23  # and their text, about
SLICE_BYTES = 1 << 20  # text that is aligned at a time, about; a longer text stands alone
PART_CHARS = 1 << 20  # a longer text is given to B in parts
WIDE = 4_096  # links of a group from which it is expanded by distinct ids
BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable bytes stand for themselves, the others count on from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Tokenizer A: ids of a space and the text, and the bytes of each id."""

    def __init__(self, model: str):
        self.tok, self.fast, _ = byte_tokenizer(model)
        alphabet = byte_alphabet()
        vocab = json.loads(model)["model"]["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in alphabet for c in t):
                self.bytes[i] = bytes(alphabet[c] for c in t)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast[0].encode_ordinary(" " + text)
        self.tok.encode_special_tokens = True
        return self.tok.encode(" " + text, add_special_tokens=False).ids


    def gives_back(self, ids: list[int], data: bytes) -> bool:
        """Whether the ids' bytes are ``data``: a plain byte-level model changes nothing."""
        return self.fast is not None or b"".join(map(self.bytes.__getitem__, ids)) == data


class PieceTokens:
    """Tokenizer B: ids of the text (the model itself adds the space), and the bytes of each id."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        # no piece goes on behind a blank that follows other characters: texts may be cut there
        self.blank_leads = not any(BLANK in p.lstrip(BLANK) for p in names)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def parts(self, text: str, chars: int) -> list[str]:
        """The text cut at single blanks (dropped: the model adds one before each part); whole if the model changes it otherwise."""
        if not self.blank_leads or self.sp.normalize(text) != BLANK + text.replace(" ", BLANK):
            return [text]
        out, at = [], 0
        while len(text) - at > chars:
            cut = text.find(" ", at + chars)
            while cut > 0 and (text[cut - 1] in " " + BLANK or cut == at):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut + 1 == len(text):  # the model gives an empty part no blank
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def long_ids(self, text: str, chars: int) -> list[int]:
        return [i for part in self.ids(self.parts(text, chars)) for i in part]


@lru_cache(maxsize=2)
def _models(a: str, b: bytes) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a), PieceTokens(b)


def cuts(ids_a: np.ndarray, ids_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of A tokens and of B tokens up to each byte offset at which tokens of both end."""
    ends_a, ends_b = (dict(zip(np.cumsum(n[ids]).tolist(), range(1, len(ids) + 1))) for ids, n in ((ids_a, len_a), (ids_b, len_b)))
    common = sorted(ends_a.keys() & ends_b.keys())
    return list(map(ends_a.__getitem__, common)), list(map(ends_b.__getitem__, common))


def expand(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """Distinct (document, pair) keys of all groups, ascending, and their numbers of links.

    ``n_a``, ``n_b``: sizes of consecutive groups of the ids ``a`` and
    ``b``; ``doc``: a group's document.  Returns (document, a * base + b,
    links).
    """
    at_a, at_b, n = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    span = np.int64(base) * (int(a.max(initial=0)) + 1)
    small = np.flatnonzero(n <= WIDE)
    each = n[small]
    g, k = np.repeat(small, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    keys, links = np.unique(doc[g] * span + a[at_a[g] + k // n_b[g]] * base + b[at_b[g] + k % n_b[g]], return_counts=True)
    if len(small) < len(n):
        keys, links = [keys], [links]
        for g in np.flatnonzero(n > WIDE).tolist():
            xa, ca = np.unique(a[at_a[g]: at_a[g] + n_a[g]], return_counts=True)
            xb, cb = np.unique(b[at_b[g]: at_b[g] + n_b[g]], return_counts=True)
            keys.append((doc[g] * span + xa[:, None] * base + xb[None, :]).ravel())
            links.append((ca[:, None] * cb[None, :]).ravel())
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate(links))
        links = total
    return keys // span, keys % span, links.astype(np.int64)


def _digests(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ends: np.ndarray, names: list[str]) -> list[str]:
    """SHA-256 of the groups' written form; ``ends``: number of tokens of both kinds up to the end of each document."""
    code = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[np.cumsum(n_a) - 1] = 1
    last_b[np.cumsum(n_b) - 1] = 2
    code[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = a * 3 + last_a
    code[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = b * 3 + last_b
    out, at = [], 0
    for e in ends.tolist():
        written = "".join(map(names.__getitem__, code[at:e].tolist()))[:-1]
        out.append(hashlib.sha256(written.encode()).hexdigest() if e > at else "")
        at = e
    return out


FIELDS = "batch long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, links array<bigint>"


def align(docs: DataFrame, model_a: str, model_b: bytes, key: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Per document: batch, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs (a * size of B + b) with their links."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    fields = FIELDS.format(kind=rows.schema["key"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        A, B = _models(model_a, model_b)
        len_a, len_b = (np.array(list(map(len, x.bytes)), np.int64) for x in (A, B))
        base = len(len_b)
        names = [f"{i}{c}" for i in range(max(len(len_a), base)) for c in ",|;"]
        batch, held_rows, held_bytes = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            ahead = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), np.int64))))
            at = 0
            while at < b.num_rows:
                to = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(ahead, ahead[at] + SLICE_BYTES, "right")) - 1))
                size = int(ahead[to] - ahead[at])
                if held_rows and (held_rows + to - at > BATCH_ROWS or held_bytes + size > BATCH_BYTES):
                    batch, held_rows, held_bytes = batch + 1, 0, 0
                held_rows, held_bytes = held_rows + to - at, held_bytes + size
                texts = [t or "" for t in b.column(1).slice(at, to - at).to_pylist()]
                none = np.zeros(0, np.int64)
                ids, cut = [(none, none)] * len(texts), [(none, none)] * len(texts)
                for i, (t, ids_b) in enumerate(zip(texts, B.ids([t if len(t) <= part_chars else "" for t in texts]))):
                    if not t:
                        continue
                    if len(t) > part_chars:
                        ids_b = B.long_ids(t, part_chars)
                    ids_a, want = A.ids(t), (" " + t).encode()
                    if A.gives_back(ids_a, want) and b"".join(map(B.bytes.__getitem__, ids_b)) == want:
                        ids[i] = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
                        cut[i] = tuple(np.array(x, np.int64) for x in cuts(*ids[i], len_a, len_b))
                a, c = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
                count = lambda lists: np.array([len(x) for x in lists], np.int64)
                n_groups, n_a, n_b = count(x for x, _ in cut), count(x for x, _ in ids), count(y for _, y in ids)
                g_a, g_b = (np.concatenate([np.diff(x[k], prepend=0) for x in cut]) for k in (0, 1))
                doc = np.repeat(np.arange(len(texts)), n_groups)
                of, pairs, links = expand(a, c, g_a, g_b, doc, base)
                n_links = np.zeros(len(texts), np.int64)
                np.add.at(n_links, doc, g_a * g_b)
                offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(texts), batch), pa.int64()), b.column(0).slice(at, to - at),
                     *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                     pa.array(_digests(a, c, g_a, g_b, np.cumsum(n_a + n_b), names), pa.string()),
                     *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, links))],
                    ["batch", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])
                at = to

    return rows.mapInArrow(run, fields)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each batch (of its rows at hand) with the number of documents that hold them."""
    for b in batches:
        of = np.asarray(b.column(0))
        lists = b.column(1)
        offsets = np.asarray(lists.offsets)
        values = np.asarray(lists.values)
        for n in np.unique(of):
            rows = np.flatnonzero(of == n)
            pairs, docs = np.unique(values[offsets[rows[0]]: offsets[rows[-1] + 1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), n), pa.int64()), pa.array(pairs, pa.int64()),
                                              pa.array(docs, pa.int64())], ["batch", "pair", "docs"])


def pair_counts(links: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """(the pairs that batches name; per pair: count of documents and whether it is highest for its A id)."""
    named = links.select("batch", "pairs").mapInArrow(_named, "batch long, pair long, docs long")
    counts = named.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {base}"))
    counts = materialize(counts, "align-pairs")  # at most one row per pair of ids
    top = counts.groupBy("a").agg(F.max("count").alias("_top"))
    return named, counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the links of a batch's documents, from the counts of its pairs."""
    pairs, count, best = (np.asarray(right.column(c).combine_chunks()) for c in ("pair", "count", "best"))
    order = np.argsort(pairs)
    pairs, count, best = pairs[order], count[order], best[order].astype(np.int64)
    lists, links = left.column("pairs").combine_chunks(), left.column("links").combine_chunks()
    values = np.asarray(lists.flatten())
    at, n = np.searchsorted(pairs, values), np.asarray(links.flatten())
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    doc = np.repeat(np.arange(left.num_rows), sizes)
    out = {}
    for name, x in (("n_best", best), ("count_sum", count)):
        out[name] = np.zeros(left.num_rows, np.int64)
        if len(values):
            np.add.at(out[name], doc, n * x[at])
    return left.select(["key", "n_a", "n_b", "n_groups", "n_links"]) \
        .append_column("n_best", pa.array(out["n_best"])).append_column("count_sum", pa.array(out["count_sum"])) \
        .append_column("groups_sha256", left.column("groups_sha256"))


def alignments(docs: DataFrame, model_a: str, model_b: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    base = len(_models(model_a, model_b)[1].bytes)
    links = materialize(align(docs, model_a, model_b, key, text), "align-links")
    kind = links.schema["key"].dataType.simpleString()
    named, counts = pair_counts(links, base)
    known = salted_left_join(named.select("batch", "pair"), counts, ["pair"], F.col("batch"))
    out = links.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(
        _sums, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key)
