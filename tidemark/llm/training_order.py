"""Training order on disk: a keyed permutation gives every sequence its slot, range partitions write fixed-stride shards.

Documents, each followed by an end id, are one stream of ids, cut into sequences of equal length. A Feistel network
with cycle-walking permutes the sequence numbers, so slots need no shuffled list and can be reckoned back. A shard
holds the sequences of a range of slots, in order and at a fixed stride, and a reader goes on at any slot with a seek.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import token_counts
from tidemark.llm.bpe import AT_ONCE, tokenizer
from tidemark.llm.chunks import flat_bytes
from tidemark.llm.common import filesystem, fresh_dir, parallelism, publish, small_batches, table

#: Ids of byte_streams: UTF-8 bytes, and a byte that no UTF-8 text has as the end. Any text comes back from them.
END = 0xFF
LENGTH = 2048
KEY = 0x5EED
ROUNDS = 6
#: About so many shards, each within these bytes.
SHARDS, LEAST_BYTES, MOST_BYTES = 256, 1 << 20, 256 << 20


class Feistel:
    """A permutation of 0 .. n - 1 by a key; what the network puts outside the range walks on until it is inside."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big")) for i in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            a, b = (b ^ self._mix(a, k), a) if back else (b, a ^ self._mix(b, k))
        return (a << self.half) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        x = self._once(np.asarray(x).astype(np.uint64), keys, back)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    """Where everything lies; kept beside the shards, so that a reader needs nothing else."""

    tokens: int
    length: int
    per_shard: int
    key: int
    dtype: str
    end: int

    @property
    def sequences(self) -> int:
        return -(-self.tokens // self.length)

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize

    def permutation(self) -> Feistel:
        return Feistel(self.sequences, self.key)

    def shard_path(self, root: str, shard: int) -> str:
        return f"{root}/{shard // 1000:06d}/shard-{shard:09d}.bin"

    def filled(self, sequence: np.ndarray) -> np.ndarray:
        """Ids of a sequence that come from documents; only the last has fewer than all."""
        return np.minimum(self.length, self.tokens - sequence * self.length)


def layout(tokens: int, length: int = LENGTH, key: int = KEY, dtype: str = "u1", end: int = END, shards: int = SHARDS) -> Layout:
    stride = length * np.dtype(dtype).itemsize
    size = min(MOST_BYTES, max(LEAST_BYTES, tokens * np.dtype(dtype).itemsize // shards))
    return Layout(tokens, length, max(1, size // stride), key, dtype, end)


def _pieces(streams: DataFrame, plan: Layout, offsets: dict[int, tuple[int, int]]) -> DataFrame:
    """(shard, slot, at, data): the parts of each sequence that a partition of the stream holds, packed, since the shuffle's own compression sees little of a text at a time.

    streams has ids as bytes, end included.
    """
    width = np.dtype(plan.dtype).itemsize

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1).compress
        part = TaskContext.get().partitionId()
        at, told = offsets.get(part, (0, 0))
        stop, permutation = at + told, plan.permutation()
        for batch in small_batches(batches, 0):

            def cut(at, data):
                n = len(data) // width
                edges = np.unique(np.concatenate(([at], np.arange(-(-at // plan.length), -(-(at + n) // plan.length)) * plan.length, [at + n])))
                first, last = edges[:-1], edges[1:]
                sequence = first // plan.length
                slot = permutation.slot(sequence)
                parts = [pack(data[(a - at) * width : (b - at) * width]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(slot // plan.per_shard), pa.array(slot), pa.array((first - sequence * plan.length).astype(np.int32)), pa.array(parts, pa.binary())], names=["shard", "slot", "at", "data"])

            data = memoryview(flat_bytes(batch.column(0))[0])
            for first in range(0, len(data), 1 << 20):
                ids = data[first : first + (1 << 20)]
                yield cut(at, ids)
                at += len(ids) // width
        if at != stop:
            raise RuntimeError(f"partition {part} held {at - stop} ids more than when it was counted; read it from a written table instead")

    return streams.mapInArrow(run, "shard long, slot long, at int, data binary")


def _shards(pieces: DataFrame, plan: Layout, root: str) -> DataFrame:
    """Write the shards, one a task; (shard, first_slot, sequences, bytes) of each, once it has its name."""
    width = np.dtype(plan.dtype).itemsize
    last = plan.sequences - 1

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor().decompress
        attempt = TaskContext.get().taskAttemptId()
        files, base = filesystem(root)
        shard, f, done, temporary = -1, None, 0, ""

        def close():
            """Pad the last sequence of all, which may end early, and check that the shard is whole."""
            nonlocal done
            n = min(plan.per_shard, last + 1 - shard * plan.per_shard)
            if done < n * plan.stride and done % plan.stride:
                raise RuntimeError(f"shard {shard} lacks ids")
            f.close()
            if done != n * plan.stride:
                raise RuntimeError(f"shard {shard} has {done} of {n * plan.stride} bytes")
            final = plan.shard_path(base, shard)
            publish(files, temporary, final)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([shard * plan.per_shard]), pa.array([n]), pa.array([done])], names=["shard", "first_slot", "sequences", "bytes"])

        short = plan.permutation().slot(np.array([last]))[0] if last >= 0 else -1
        padding = np.full(plan.sequences * plan.length - plan.tokens, plan.end, plan.dtype).tobytes()
        for batch in small_batches(batches, 3):
            for s, slot, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if f:
                        yield close()
                    shard, done = s, 0
                    final = plan.shard_path(base, s)
                    files.create_dir(final.rpartition("/")[0], recursive=True)
                    temporary = f"{final}.{attempt}"
                    f = files.open_output_stream(temporary)
                if (slot - s * plan.per_shard) * plan.stride + at * width != done:
                    raise RuntimeError(f"slot {slot} of shard {s} does not follow what was written")
                data = unpack(data)
                f.write(data)
                done += len(data)
                if slot == short and at * width + len(data) + len(padding) == plan.stride:
                    f.write(padding)
                    done += len(padding)
        if f:
            yield close()

    shards = max(1, -(-plan.sequences // plan.per_shard))
    return pieces.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot", "at").mapInArrow(run, "shard long, first_slot long, sequences long, bytes long")


def materialise(streams: DataFrame, out: str, length: int = LENGTH, key: int = KEY, dtype: str = "u1", end: int = END, shards: int = SHARDS) -> Layout:
    """Write shards under out/shards and their list as the Parquet table out/manifest.

    streams has one column of bytes, each row the ids of a document and its end id. It must give the same partitions
    whenever it is run, as reads of files do; a partition that differs from when it was counted fails the job.
    """
    width = np.dtype(dtype).itemsize
    column = F.col(streams.columns[0])
    sizes = dict(streams.select((F.octet_length(column) / width).cast("long").alias("n"), F.spark_partition_id().alias("part")).groupBy("part").agg(F.sum("n")).collect())
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part] = (at, sizes[part])
        at += sizes[part]
    plan = layout(at, length, key, dtype, end, shards)
    _shards(_pieces(streams, plan, starts), plan, f"{out}/shards").write.parquet(f"{out}/manifest")
    return plan


def read_from(out: str, plan: Layout, slot: int = 0):
    """(slot, ids) in training order from any slot on: how a training job reads and, after a stop, resumes."""
    files, base = filesystem(f"{out}/shards")
    while slot < plan.sequences:
        shard = slot // plan.per_shard
        with files.open_input_file(plan.shard_path(base, shard)) as f:
            f.seek((slot - shard * plan.per_shard) * plan.stride)
            while slot < min((shard + 1) * plan.per_shard, plan.sequences):
                yield slot, np.frombuffer(f.read(plan.stride), plan.dtype)
                slot += 1


def read_all(spark: SparkSession, out: str, plan: Layout) -> DataFrame:
    """slot, sequence, shard, n_tokens, sha256 (of the stored ids, without padding) of every sequence, read back in one task per shard."""

    def run(batches):
        files, base = filesystem(f"{out}/shards")
        permutation = plan.permutation()
        for batch in batches:
            for shard, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slots = np.arange(first, first + n)
                sequences = permutation.sequence(slots)
                filled = plan.filled(sequences)
                width = plan.stride // plan.length
                with files.open_input_stream(plan.shard_path(base, shard)) as f:
                    digests = [hashlib.sha256(f.read(plan.stride)[: m * width]).hexdigest() for m in filled.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sequences), pa.array(np.full(n, shard)), pa.array(filled), pa.array(digests)], names=["slot", "sequence", "shard", "n_tokens", "sha256"])

    shards = spark.read.parquet(f"{out}/manifest").select("shard", "first_slot", "sequences")
    return shards.repartition(parallelism(spark), "shard").mapInArrow(run, "slot long, sequence long, shard long, n_tokens long, sha256 string")


def byte_streams(docs: DataFrame) -> DataFrame:
    """UTF-8 bytes as ids and the end id; null text is an empty document."""
    return docs.select(F.concat(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.lit(bytes([END]))).alias("ids"))


def token_streams(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of the byte-level BPE and the end id, two bytes each; null text is an empty document."""

    def run(batches):
        coder = tokenizer(path)
        for batch in small_batches(batches, 0, AT_ONCE):
            ids, at = coder.encode(batch.column(0))
            ids = np.insert(ids, at[1:], token_counts.END).astype(token_counts.DTYPE)
            ends = (at + np.arange(len(at))) * ids.itemsize
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())], names=["ids"])
        coder.rest()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "ids binary")


def order(docs: DataFrame, **how) -> DataFrame:
    """slot, sequence, shard, n_tokens, sha256 of every sequence of docs' token ids, read back from the shards.

    Only text is read; null text counts as an empty document, repeated rows are documents of their own, and documents
    of any length are taken whole. An empty table has no sequences. Texts are encoded once, into a table beside the
    shards, since the ids are read twice; both stay in the shared folder.
    """
    spark = docs.sparkSession
    out = fresh_dir(spark, "order")
    token_streams(docs).write.option("compression", "zstd").parquet(f"{out}/ids")
    plan = materialise(spark.read.parquet(f"{out}/ids"), out, dtype=token_counts.DTYPE, end=token_counts.END, **how)
    return read_all(spark, out, plan)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order(table(spark, sf_dir, "documents"))
