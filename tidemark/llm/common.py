"""What the operators share: the shared folder, checkpoints, files in it, and free column names."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all is one process (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    return _own_dir[app]


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which outlives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
    return df.checkpoint(eager=True)


#: Bytes of rows that a JVM hands to Python at once; its vectors for them, which double as they grow, lie outside the heap.
ARROW_BYTES = 4 << 20
_BYTES_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches by bytes: by default one may be of 64 MB, in every task at once."""
    spark = df.sparkSession
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES_A_BATCH))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(_BYTES_A_BATCH, str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df has not, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    """Tasks for a shuffle whose rows no exchange rule sizes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def filesystem(uri: str):
    """pyarrow file system and path of a URI; a plain path is a local one."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(column: str = "text"):
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def publish(files, temporary: str, final: str) -> None:
    """Give a finished file its name, in place of what another attempt of the task may have left there."""
    from pyarrow.fs import FileType

    try:
        files.move(temporary, final)
    except OSError:
        if files.get_file_info(final).type == FileType.NotFound:
            raise
        files.delete_file(final)
        files.move(temporary, final)


def trim() -> None:
    """Give memory that is no longer used back to the system: a worker waits long for its next task, with others beside it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if release:
        release(0)


def small_arrays(texts, most: int = 1 << 20):
    """Slices of an Arrow array of strings or bytes, of about `most` bytes each; one long text may be more. Python objects are then made of a slice at a time."""
    import numpy as np
    import pyarrow.compute as pc

    if len(texts):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)], strict=True):
            yield a, texts.slice(a, b - a)


def small_batches(batches, column: int, most: int = 1 << 20):
    """Slices of record batches by the bytes of one of their columns."""
    for batch in batches:
        for a, part in small_arrays(batch.column(column), most):
            yield batch.slice(a, len(part))
    trim()
