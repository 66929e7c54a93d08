"""Packing by power-of-two decomposition (operator 13).

A document of n tokens is cut into pieces whose lengths are the powers of
two that add up to n (none longer than a sequence), the longest first.
Pieces of equal length form a bucket, and every piece is a sequence of its
own: no sequence crosses documents, and none needs padding, since its length
is a power of two.

Sequences are numbered without gaps, bucket by bucket from the longest on,
so batches of one length are runs of numbers.  A task numbers its own pieces
of each length; what lies ahead of a task follows from the counts by length
and task, summed in blocks of tasks, so no step holds the numbers of all
tasks.

Tokenising.  A model that drops white space and lower-cases treats every
word alike wherever it stands.  Its distinct words are encoded once for a
group of documents (and remembered, up to ``KNOWN_WORDS``); a document's ids
are then gathered from them.  Texts that hold a special token's string, and
models of any other kind, go to the library as a whole.

Defined results: a null or empty text is its end id alone, a piece of one
token.  Every input row gives its own pieces, also when its key is null or
repeated.  Other columns are not read, whatever their names.  A very long
text is encoded in parts cut at white space, to the same ids.  An empty
table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialize

SIZE = 2048
END_ID = 1
GROUP_BYTES = 1 << 23  # texts encoded together, about; a longer one is cut into parts of this size
KNOWN_WORDS = 600_000  # words whose ids a Python worker remembers, over all of its tasks
TASK_BLOCK = 1024  # tasks whose counts are summed together

# The normaliser and pre-tokeniser for which words can be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: A run of these after an ASCII letter or digit ends a word and is a pre-token of its own.
_STOPS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


@lru_cache(maxsize=2)
def _tokenizer(model: str):
    """(tokenizer, whether its words can be encoded one by one, strings of its special tokens)."""
    from tokenizers import Tokenizer
    spec = json.loads(model)
    plain = all(spec.get(k) == v for k, v in WORDWISE.items()) and not spec.get("post_processor")
    special = [t["content"] for t in spec.get("added_tokens") or []]
    plain = plain and all(len(s.split()) == 1 and s == s.strip() and s[-1] not in _STOPS for s in special)
    return Tokenizer.from_str(model), plain, special


def _split_word(word: str) -> tuple[str, str]:
    """A word without the stops at its end, and those: only after an ASCII letter or digit, where a pre-token surely ends."""
    head = word.rstrip(_STOPS)
    if len(head) < len(word) and head and head[-1].isascii() and head[-1].isalnum():
        return head, word[len(head):]
    return word, ""


class WordEncoder:
    """Ids of texts by their distinct words; equal to the library's ids of the whole texts.

    Ids of words are held as bytes.  Beyond ``known`` words the older half is
    forgotten, except for words met again.
    """

    def __init__(self, model: str, known: int = KNOWN_WORDS):
        self.tok, self.plain, self.special = _tokenizer(model)
        self.known, self.older, self.limit = {"": b""}, {}, known // 2

    def _learn(self, words: list[str]) -> None:
        """Make the ids of distinct words known."""
        if len(self.known) > self.limit:
            self.known, self.older = {"": b""}, self.known
        new = []
        for w in words:
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        if new:
            enc = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
            of = np.array([-1 if x is None else x for x in enc.word_ids], np.int64)
            data, at = np.array(enc.ids, "<u4").tobytes(), 0
            for w, e in zip(new, (4 * np.searchsorted(of, np.arange(len(new)), "right")).tolist()):
                self.known[w] = data[at:e]
                at = e

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        parts = [_split_word(w) for w in words]
        missing = {x for p in parts for x in p if x not in self.known}
        if missing:
            self._learn([x for x in dict.fromkeys(chain.from_iterable(parts)) if x] if len(self.known) > self.limit else list(missing))
        known = self.known
        return [known[a] + known[b] if b else known[a] for a, b in parts]

    def group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each begins, and the end)."""
        texts = texts.fill_null("") if texts.null_count else texts
        folded = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for s in self.special if self.plain else [""]:
            odd |= np.asarray(pc.match_substring(folded, s.lower()))
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", folded))
        code = lists.flatten().dictionary_encode()
        each = self.words(code.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        codes = np.asarray(code.indices).astype(np.int64)
        n = size[codes]
        begin = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - begin[:-1], n) + np.arange(begin[-1])]
        bounds = begin[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        if not odd.any():
            return ids, bounds
        own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(odd):
            own[i] = np.array(self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))

    def long(self, text: str, part: int) -> np.ndarray:
        """Ids of a long text, encoded in parts that end at ASCII white space."""
        if not self.plain or any(s.lower() in text.lower() for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + part)
            while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
                end += 1
            out.append(self.group(pa.array([text[at:end]], pa.large_string()))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(maxsize=1)
def encoder(model: str) -> WordEncoder:
    """The encoder of a Python worker: what it has learnt serves the worker's next tasks."""
    return WordEncoder(model)


def binary_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: powers of two of at most ``size``, the longest first."""
    out, at, bit = [], 0, size
    while at < n:
        if n - at >= bit:
            out.append((at, bit))
            at += bit
        else:
            bit >>= 1
    return out


def pieces(docs: DataFrame, model: str, size: int = SIZE, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
           with_ids: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces of every document: key, start, length, ids_crc32, doc_tokens, and task and place, its number among the task's of its length."""
    if size < 1 or size & (size - 1):
        raise ValueError("the sequence size must be a power of two")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "place")

    def run(batches):
        enc, task, placed = encoder(model), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4")
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            bytes_of = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            ahead = np.concatenate(([0], np.cumsum(bytes_of)))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + group_bytes, "right")) - 1)
                if to == at + 1 and bytes_of[at] > group_bytes:
                    ids = enc.long(texts[at].as_py(), group_bytes)
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = enc.group(texts.slice(at, to - at))
                row, out, held = [], {c: [] for c in numbers}, []
                for r, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.concatenate((ids[x:y].astype("<u4"), end))
                    for s, n in binary_pieces(len(own), size):
                        row.append(at + r)
                        place = placed[n] = placed.get(n, -1) + 1
                        for c, v in zip(numbers, (s, n, zlib.crc32(own[s: s + n].data), len(own), place)):
                            out[c].append(v)
                        if with_ids:
                            held.append(own[s: s + n].astype(np.int32))
                cols = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(out[c], pa.int64()) for c in numbers),
                        pa.array(np.full(len(row), task), pa.int64())]
                names = ["key", *numbers, "task"]
                if with_ids:
                    cols, names = [*cols, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at = to

    extra = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, place long, task long{extra}") \
        .withColumnRenamed("key", key)


def number(parts: DataFrame) -> DataFrame:
    """A written table of pieces with sequence_id, bucket_rank (its number within its length) and offset.

    Counts by length and task are summed in blocks of ``TASK_BLOCK`` tasks:
    a window holds one block, or one row per length and block.
    """
    counts = parts.groupBy("length", "task").agg((F.max("place") + 1).alias("_n")) \
        .withColumn("_block", F.floor(F.col("task") / TASK_BLOCK))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_in", F.coalesce(F.sum("_n").over(before(
        Window.partitionBy("length", "_block").orderBy("task"))), F.lit(0)))
    blocks = counts.groupBy("length", "_block").agg(F.sum("_n").alias("_m"))
    # one row per length and block of tasks
    blocks = blocks.select(
        "length", "_block",
        F.coalesce(F.sum("_m").over(before(Window.partitionBy("length").orderBy("_block"))), F.lit(0)).alias("_bucket"),
        F.coalesce(F.sum("_m").over(before(Window.orderBy(F.desc("length"), "_block"))), F.lit(0)).alias("_all"))
    ahead = within.join(blocks, ["length", "_block"]).select(
        "length", "task", (F.col("_in") + F.col("_bucket")).alias("_rank0"), (F.col("_in") + F.col("_all")).alias("_seq0"))
    return parts.join(ahead, ["length", "task"]) \
        .withColumn("sequence_id", F.col("_seq0") + F.col("place")).withColumn("bucket_rank", F.col("_rank0") + F.col("place")) \
        .withColumn("offset", F.lit(0).cast("long")).drop("_seq0", "_rank0", "task", "place")


def pack_documents(docs: DataFrame, model: str, size: int = SIZE, end_id: int = END_ID, key: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: per piece key, start, length, ids_crc32, doc_tokens, sequence_id, bucket_rank, offset (and ids)."""
    parts = materialize(pieces(docs, model, size, end_id, key, text, with_ids), "binary-pieces")
    cols = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "bucket_rank", "offset"] + ["ids"] * with_ids
    return number(parts).select(*cols)


def write_buckets(packed: DataFrame, path: str, batch_tokens: int | None = None) -> None:
    """Sequences as one folder per length; with ``batch_tokens`` also ``batch``, so that every batch holds as many tokens at most."""
    if batch_tokens:
        each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
        packed = packed.withColumn("batch", F.floor(F.col("bucket_rank") / each).cast("long"))
    packed.write.partitionBy("length").parquet(path)
