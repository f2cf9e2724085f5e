"""Token counts of documents in flat token files that have no index: a scan for end-of-document ids, block by block.

Blocks are read apart, wherever they begin. Each tells how many separators it holds, what stands before the first and
after the last, and the lengths between. A prefix scan over the blocks of a file then says at which document each
block begins and how many tokens the document open at its start already has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import AT_ONCE, tokenizer
from tidemark.llm.common import filesystem, fresh_dir, parallelism, publish, small_batches, table

#: The vocabulary file has 50,256 tokens and leaves this id free.
END = 50_256
DTYPE = "<u2"
BLOCK_BYTES = 4 << 20
#: Blocks whose prefix is reckoned in one task; the files' lengths of documents never pass a window.
STRETCH = 4096


def write_flat(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Each partition of docs becomes one file of token ids under out, END after each document, and `out/order` says in which order its documents went in."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = filesystem(out)
        files.create_dir(f"{root}/tokens", recursive=True)
        name = f"part-{context.partitionId():06d}.bin"
        temporary, coder, at = f"{root}/tokens/.{name}-{context.taskAttemptId()}", tokenizer(path), 0
        with files.open_output_stream(temporary) as f:
            for batch in small_batches(batches, 1, AT_ONCE):
                ids, ends = coder.encode(batch.column(1))
                f.write(np.insert(ids, ends[1:], END).astype(DTYPE).tobytes())
                n = batch.num_rows
                # a task whose file gets no name fails, and its rows are not kept
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), batch.column(0)], names=["file", "ordinal", "doc_id"])
                at += n
        publish(files, temporary, f"{root}/tokens/{name}")
        coder.rest()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(run, f"file string, ordinal long, doc_id {rows.schema['doc_id'].dataType.simpleString()}").write.parquet(f"{out}/order")


def scan_block(tokens: np.ndarray, end: int = END) -> tuple[int, int, int, np.ndarray]:
    """Separators in a block, tokens before the first (all, if none), tokens after the last, and the lengths between."""
    at = np.flatnonzero(tokens == end)
    if not len(at):
        return 0, len(tokens), len(tokens), at
    return len(at), int(at[0]), len(tokens) - 1 - int(at[-1]), np.diff(at) - 1


def _prefix(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Add `base`, the separators before a row, `carry`, the tokens of the document open at its start, and `opened`, whether any separator stands before."""
    order = Window.partitionBy(*by).orderBy(at)
    rows = rows.withColumn("run", F.sum((F.col("n") > 0).cast("long")).over(order))
    rows = rows.withColumn("after", F.sum("tail").over(Window.partitionBy(*by, "run").orderBy(at)))
    rows = rows.withColumn("carry", F.coalesce(F.lag("after").over(order), F.lit(0)))
    rows = rows.withColumn("base", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("opened", F.col("run") > (F.col("n") > 0).cast("long"))


def prefix_scan(blocks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(file, block, n, tail) to file, block, base, carry. Two levels, stretches of blocks and blocks within them, so no task has all blocks of a long file."""
    inner = _prefix(blocks.withColumn("stretch", F.floor(F.col("block") / stretch)), ["file", "stretch"], "block")
    whole = inner.groupBy("file", "stretch").agg(F.sum("n").alias("n"), F.max_by("after", "block").alias("tail"))
    outer = _prefix(whole, ["file"], "stretch").select("file", "stretch", F.col("base").alias("base0"), F.col("carry").alias("carry0"))
    carry = F.when(F.col("opened"), F.col("carry")).otherwise(F.col("carry0") + F.col("carry"))
    return inner.join(outer, ["file", "stretch"]).select("file", "block", (F.col("base0") + F.col("base")).alias("base"), carry.alias("carry"))


def scan_files(files: DataFrame, root: str, dtype: str = DTYPE, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, n_tokens of every document in flat files.

    files has file (a name under root) and bytes (its length). A document's tokens end at its separator, which is not
    counted; tokens after a file's last separator are one more document. A file without bytes has none. Separators may
    lie anywhere, also many in a row: empty documents.
    """
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width
    spark = files.sparkSession
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / block_bytes).cast("int"))).alias("block"))

    def run(batches):
        found, base = filesystem(root)
        for batch in batches:
            for name, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with found.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                n, head, tail, lengths = scan_block(np.frombuffer(data, dtype), end)
                last = (block + 1) * block_bytes >= size
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([last]), pa.array([lengths], pa.list_(pa.int64()))], names=["file", "block", "n", "head", "tail", "last", "lengths"])

    seen = blocks.repartition(parallelism(spark), "file", "block").mapInArrow(run, "file string, block int, n long, head long, tail long, last boolean, lengths array<bigint>")
    kept = fresh_dir(spark, "blocks")
    seen.write.parquet(kept)
    seen = spark.read.parquet(kept)
    seen = seen.join(prefix_scan(seen.select("file", "block", "n", "tail")), ["file", "block"])
    ended = F.when(F.col("n") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("lengths"))).otherwise(F.array().cast("array<bigint>"))
    left = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    rest = F.when(F.col("last") & (left > 0), F.array(left)).otherwise(F.array().cast("array<bigint>"))
    return seen.select("file", "base", F.posexplode(F.concat(ended, rest)).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")


def list_flat(spark: SparkSession, out: str) -> DataFrame:
    """file, bytes of the files that write_flat has left; looked up where the files are."""
    names = spark.read.parquet(f"{out}/order").select("file").distinct()

    def run(batches):
        found, base = filesystem(f"{out}/tokens")
        for batch in batches:
            sizes = [x.size for x in found.get_file_info([f"{base}/{n}" for n in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return names.mapInArrow(run, "file string, bytes long")


def count(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, file, ordinal of every row: docs are written as flat token files and these are scanned.

    Null text is an empty document of 0 tokens. doc_id may be null or repeated; each row is a document of its own.
    Texts are taken whole; an empty table has no rows; other columns are not read. The files stay in the shared
    folder, for the result reads them.
    """
    spark = docs.sparkSession
    out = fresh_dir(spark, "flat")
    write_flat(docs, out, path)
    counts = scan_files(list_flat(spark, out), f"{out}/tokens", block_bytes=block_bytes)
    return spark.read.parquet(f"{out}/order").join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))
