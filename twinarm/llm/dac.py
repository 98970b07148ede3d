"""Token-id files in directly addressable codes.

A file row ("shard") holds the ids of consecutive documents. Ids are cut into 8-bit chunks: level 0 has the low chunk of every id,
level k+1 the next chunk of those ids that need one; a bitmap per level says which continue, and a rank directory holds the ones
before every 512 bits, so any token is read with one byte access and one short popcount per level, without decoding others.

The container is a table (part, shard, base, tokens, docs, blob) written and read by Spark, hence on any store the cluster shares;
(part, shard) is the ascending order of doc_id, and base counts the tokens before the shard within its part.

Defined results: a null text is empty and holds the end id alone; rows of equal doc_id are kept, in order of a hash of their text;
a null doc_id comes first; an empty table writes no shards; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import scratch, temporary

MAGIC = b"TDAC1\0\0\0"
CHUNK_BITS, RANK_BITS = 8, 512
#: A shard closes after so many tokens, at the end of a document.
SHARD_TOKENS = 1 << 20

_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack_levels(ids: np.ndarray) -> bytes:
    """The levels of ids: for each, its length, bytes, continuation bitmap and rank directory."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> CHUNK_BITS) > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        blocks = _ONES[bits].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        ranks = (np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return b"".join(out)


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard as bytes."""
    valid = np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little").tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, struct.pack("<QQ", len(doc_ids), len(ids)), valid, keys, np.cumsum(counts).astype("<i8").tobytes(), pack_levels(ids)])


class Shard:
    """Read access to a shard's bytes; nothing is decoded until asked for."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token shard")
        n_docs, self.n_tokens = struct.unpack_from("<QQ", blob, 8)
        at = 24
        valid = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n_docs // 8), at), count=n_docs, bitorder="little")
        at += -(-n_docs // 8)
        keys = np.frombuffer(blob, "<i8", n_docs, at)
        self.doc_ids = [int(k) if v else None for k, v in zip(keys, valid)]
        self.ends = np.frombuffer(blob, "<i8", n_docs, at + 8 * n_docs)
        at += 16 * n_docs
        self.levels = []
        while at < len(blob):
            (n,) = struct.unpack_from("<Q", blob, at)
            n_bits = -(-(-(-n // 8)) // (RANK_BITS // 8)) * (RANK_BITS // 8)
            n_ranks = n_bits // (RANK_BITS // 8)
            at += 8
            self.levels.append((np.frombuffer(blob, np.uint8, n, at), np.frombuffer(blob, np.uint8, n_bits, at + n), np.frombuffer(blob, "<u4", n_ranks, at + n + n_bits)))
            at += n + n_bits + 4 * n_ranks

    def get(self, i: int) -> int:
        """Token i of the shard, by one access per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = _ONES[bits[block * (RANK_BITS // 8) : i >> 3]].sum(dtype=np.int64)
            i = int(ranks[block]) + int(before) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            own = chunk.astype(np.uint32)
            own[more] |= value << CHUNK_BITS
            value = own
        return value


_SHARDS = "part int, shard int, base bigint, tokens bigint, docs bigint, blob binary"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int) -> None:
    """Encode all texts with the tokenizer file and write the container to path, in ascending order of doc_id."""

    def shards(batches):
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer)
        keys, counts, ids, held = [], [], [], 0

        def close():
            blob = write_shard(keys, np.array(counts, np.int64), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "base": [base], "tokens": [held], "docs": [len(keys)], "blob": [blob]})

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                found, n = enc.encode(rows.column("text").to_pylist())
                a = 0
                for key, m in zip(rows.column("doc_id").to_pylist(), n.tolist()):
                    keys.append(key)
                    counts.append(m + 1)
                    ids += [found[a : a + m], np.array([end_id], np.uint32)]
                    a += m
                    held += m + 1
                    if held >= SHARD_TOKENS:
                        yield close()
                        shard, base = shard + 1, base + held
                        keys, counts, ids, held = [], [], [], 0
        if keys:
            yield close()

    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(shards, _SHARDS).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """The container, each shard with start: the tokens of all shards before it."""
    found = spark.read.schema(_SHARDS).parquet(path)
    # One row for each task that wrote; a running sum over them stays small however large the corpus is.
    parts = found.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("base")).drop("before")


_DIGEST = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def digest(container: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""

    def rows(batches):
        for batch in batches:
            for start, blob in zip(batch.column("start").to_pylist(), batch.column("blob")):
                s = Shard(blob.as_py())
                raw, ends = memoryview(s.decode().astype("<u4")).cast("B"), s.ends.tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(s.doc_ids, pa.int64()),
                    "start": pa.array([start + a for a in begins], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(begins, ends)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends)], pa.int64()),
                })

    return container.select("start", "blob").mapInArrow(rows, _DIGEST)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a new container in the shared folder and read its digest back."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, end_id)
    temporary(docs.sparkSession, path)
    return digest(read(docs.sparkSession, path))
