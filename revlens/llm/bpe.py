"""Byte-level BPE encoding and decoding of whole texts (operator 9).

Overlapping chunk encoding.  A text of up to ``CHUNK`` characters is one
piece and is encoded where it lies.  A longer one is cut into chunks that
overlap by ``OVERLAP`` characters:

1. every chunk is pre-tokenised by itself, in parallel;
2. a chunk is stitched to the one before at the first place of their
   overlap where both have a pre-token boundary.  The scan depends on
   nothing left of its place, so from there on both scans agree;
3. the pieces between the seams are encoded in parallel and their ids put
   together in order.

The scan of a chunk near its end cannot see what follows, so its last
``MARGIN`` characters offer no seam.  A seam never follows white space,
since a run of white space is read differently at the end of a text.  If an
overlap has no common boundary, the rest of the document stays one piece:
the result never depends on where the chunks were cut.

Defined results: a null or empty text has no ids; every input row gives one
row, also when its key is null or repeated; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialize

CHUNK, OVERLAP, MARGIN = 65_536, 1_024, 8
MAX_ROWS = 500  # texts encoded before their ids are handed over


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoder of a ``.tiktoken`` file's content, without special tokens."""
    import tiktoken
    table = {base64.b64decode(t): int(n) for t, n in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def boundaries(text: str, pattern: str, start: int, end: int) -> list[int]:
    """Places in ``[start, end)`` of ``text`` where a pre-token starts and no white space stands before."""
    import regex
    return [m.start() for m in regex.compile(pattern).finditer(text)
            if start <= m.start() < end and m.start() > 0 and not text[m.start() - 1].isspace()]


def chunk_rows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(number, start, text with the overlap into the next chunk)."""
    for k, s in enumerate(range(0, max(1, len(text)), chunk)):
        yield k, s, text[s: s + chunk + overlap]


def _encode_rows(ranks: bytes, pattern: str) -> Callable:
    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            for at in range(0, b.num_rows, MAX_ROWS):
                key, text = b.column(0).slice(at, MAX_ROWS), b.column(1).slice(at, MAX_ROWS)
                ids = [enc.encode_ordinary(t) if t else [] for t in text.to_pylist()]
                yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])
    return run


def _cut(chunk: int, overlap: int) -> Callable:
    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                uid, n = (task << 40) + n, n + 1
                rows = list(chunk_rows(text.as_py(), chunk, overlap))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(rows), b.schema.field(0).type), pa.array([uid] * len(rows), pa.int64()),
                     *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string())))],
                    ["key", "uid", "k", "start", "text"])
    return run


def _pretokenise(pattern: str, chunk: int, overlap: int) -> Callable:
    def run(batches):
        for b in batches:
            lead, trail = [], []
            for k, s, t in zip(b.column("k").to_pylist(), b.column("start").to_pylist(), b.column("text").to_pylist()):
                found = boundaries(t, pattern, 0, len(t) - MARGIN)
                lead.append([s + p for p in found if p < overlap])
                trail.append([s + p for p in found if p >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lead, pa.list_(pa.int64())), pa.array(trail, pa.list_(pa.int64()))],
                [*b.schema.names, "lead", "trail"])
    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """(key, ids array<int>) of every row, as tiktoken's ``encode_ordinary`` gives for the whole text."""
    if not 2 * MARGIN <= overlap <= chunk:
        raise ValueError("the overlap must be at least twice MARGIN and at most a chunk")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    is_long = F.octet_length("text") > chunk
    short = rows.filter(~is_long).mapInArrow(_encode_rows(ranks, pattern), f"key {kind}, ids array<int>")
    chunks = rows.filter(is_long).mapInArrow(_cut(chunk, overlap), f"key {kind}, uid long, k int, start long, text string") \
        .repartition("uid", "k") \
        .mapInArrow(_pretokenise(pattern, chunk, overlap),
                    f"key {kind}, uid long, k int, start long, text string, lead array<bigint>, trail array<bigint>")
    chunks = materialize(chunks, "bpe-chunks")
    # Seams from the narrow columns: one row per chunk of one document in a window.
    w = Window.partitionBy("uid").orderBy("k")
    seam = F.array_min(F.array_intersect(F.lag("trail").over(w), "lead"))
    seams = chunks.select("uid", "k", F.when(F.col("k") > 0, seam).otherwise(F.lit(0)).alias("seam")) \
        .withColumn("sound", F.min(F.col("seam").isNotNull()).over(w)) \
        .withColumn("begin", F.when(F.col("sound"), F.col("seam"))) \
        .withColumn("end", F.lead("begin").over(w)) \
        .withColumn("piece", F.count("begin").over(w)).select("uid", "k", "begin", "end", "piece")
    # A chunk's own part: from its seam, or from its start within a piece, to the next seam or its end.
    own = chunks.select("key", "uid", "k", "start", "text").join(seams, ["uid", "k"]) \
        .withColumn("from", F.coalesce("begin", "start") - F.col("start")) \
        .withColumn("to", F.coalesce(F.col("end") - F.col("start"), F.lit(chunk).cast("long")))
    pieces = own.groupBy("uid", "piece").applyInArrow(
        _encode_piece(ranks, pattern), f"key {kind}, uid long, piece long, ids array<int>")
    whole = pieces.groupBy("uid").agg(
        F.first("key").alias("key"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.union(whole.select("key", "ids")).withColumnRenamed("key", key)


def _encode_piece(ranks: bytes, pattern: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["k", "text", "from", "to"]).to_pylist(), key=lambda r: r["k"])
        ids = encoding(ranks, pattern).encode_ordinary("".join(r["text"][r["from"]: r["to"]] for r in rows))
        return pa.table({"key": table.column("key")[:1], "uid": table.column("uid")[:1], "piece": table.column("piece")[:1],
                         "ids": pa.array([ids], pa.list_(pa.int32()))})
    return run


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of its ids as ``out``; null ids give null."""
    from pyspark.sql.types import BinaryType, StructType

    at = encoded.columns.index(ids)

    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            for s in range(0, b.num_rows, MAX_ROWS):
                part = b.slice(s, MAX_ROWS)
                data = [None if x is None else enc.decode_bytes(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(out, BinaryType()))


def digests(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256 (lower-case hex)."""
    enc = decode(encode(docs, ranks, pattern, key, text), ranks, pattern)
    return enc.select(
        F.col(key), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
