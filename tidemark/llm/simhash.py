"""SimHash near-duplicates: blocks of fingerprint pieces find close pairs, Hamming distance verifies them.

A fingerprint's 64 bits are cut into `pieces`; `distance` differing bits leave at least pieces - distance of
them equal, so two close fingerprints agree on some combination of that many pieces, a block. Rows of a block
are compared in one task, unless the block is hot (over `hot_block` different fingerprints); fingerprints of hot
blocks are linked through the points halfway between them, at a cost that is linear in their number.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import checkpoint, free_name, parallelism, small_batches, table
from tidemark.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
DISTANCE = 4
#: Pieces of a fingerprint, at least; more where blocks would otherwise hold over BLOCK fingerprints by chance.
PIECES = 6
BLOCK = 512
#: Parts that a class's fingerprints are dealt to when they are given its name.
SALTS = 16
#: Rows of a table of large classes that may be broadcast, about 2 MB; they are counted.
MOST_BROADCAST = 100_000
HOT_BLOCK = 8192
_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Of one text; A-Z lower-cased, words split at ASCII white space. No words give 0."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - shingle_words + 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, total, _AT_ONCE):
        to = min(at + _AT_ONCE, total)
        spans = zip(starts[at:to].tolist(), ends[at + shingle_words - 1 : to + shingle_words - 1].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `fp`, the fingerprint as a signed long, in one pass over whole texts."""

    rows_at = len(keys)

    def run(batches):
        for batch in small_batches(batches, rows_at):
            texts = batch.column(rows_at).to_pylist()
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])

    rows = docs.select(*keys, F.col(text).cast("binary").alias("__text"))
    schema = rows.drop("__text").schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


def pieces_for(n: int, distance: int = DISTANCE) -> int:
    """Fewest pieces for n different fingerprints, so that the work follows n: blocks that meet by chance stay small at every size."""
    pieces = max(PIECES, distance + 2)
    while pieces < 16 and n >> (64 * (pieces - distance) // pieces) > BLOCK:
        pieces += 1
    return pieces


def blocks(fps: DataFrame, pieces: int = PIECES, distance: int = DISTANCE) -> DataFrame:
    """(fp) to (block, fp): one row per combination of pieces - distance pieces."""
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    made = []
    for no, chosen in enumerate(combinations(range(pieces), pieces - distance)):
        key, bits = F.lit(no).cast("long"), 8
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            bits += width
            key = F.shiftleft(key, width).bitwiseOR(part[i])
        if bits > 63:
            made.append(F.xxhash64(key, *[part[i] for i in chosen]))  # equal pieces still meet; what else meets is verified
        else:
            made.append(key)
    return fps.select(F.explode(F.array(*made)).alias("block"), "fp")


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all close pairs of fp connect: at most len(fp) - 1 of them."""
    left = np.ones(len(fp), bool)
    ends: list[np.ndarray] = []
    hubs: list[np.ndarray] = []
    for i in range(len(fp)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            j = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fp[rest] ^ fp[j]) <= distance]
            if len(near):
                left[near] = False
                queue.extend(near.tolist())
                ends.append(fp[near])
                hubs.append(np.full(len(near), fp[j]))
    return (np.concatenate(ends), np.concatenate(hubs)) if ends else (fp[:0], fp[:0])


def links_of_sorted(key: np.ndarray, fp: np.ndarray, distance: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Runs up to `small` rows are compared at all offsets at once, longer ones give a forest."""
    edges = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
    sizes = ends - starts
    us, vs = [], []
    tiny = np.repeat(sizes <= small, sizes)
    at = np.flatnonzero(tiny[:-1] & (key[:-1] == key[1:])) if len(key) > 1 else np.zeros(0, np.int64)
    step = 1
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        us.append(fp[near])
        vs.append(fp[near + step])
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
    for k in np.flatnonzero(sizes > small):
        u, v = _forest(fp[starts[k] : ends[k]], distance)
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def _cold_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links of blocks that fit a task; rows come sorted by block, so a run crosses at most into the next batches."""

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            if len(key) < 1 << 16 or key[0] == key[-1]:
                continue
            cut = np.searchsorted(key, key[-1])
            yield _pairs(*links_of_sorted(key[:cut], fp[:cut], distance))
            key, fp = key[cut:], fp[cut:]
        if len(key):
            yield _pairs(*links_of_sorted(key, fp, distance))

    n = parallelism(rows.sparkSession)
    return rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "u long, v long")


def ball(fp: np.ndarray, radius: int) -> np.ndarray:
    """Every point within radius bits of each fingerprint, itself included, one row each."""
    out = fp[:, None]
    for r in range(1, radius + 1):
        masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(64), r)], np.uint64)
        out = np.concatenate((out, fp[:, None] ^ masks[None, :]), axis=1)
    return out


def _hot_links(hot: DataFrame, distance: int) -> DataFrame:
    """Close fingerprints share a point within half the distance of both; so each is linked to the least of every point it reaches.

    A point is reached by no more fingerprints than its own ball has, which bounds each group.
    """
    near, far = distance // 2, distance - distance // 2

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 256):
                part = fp[at : at + 256]
                points = ball(part, far)
                yield pa.RecordBatch.from_arrays([pa.array(points.ravel().view(np.int64)), pa.array(np.repeat(part, points.shape[1]).view(np.int64))], names=["point", "fp"])

    reached = hot.select("fp").distinct().mapInArrow(spread, "point long, fp long")
    # an odd distance: the hub is one of the nearer ones, so that no link is longer than the distance
    reached = reached.withColumn("near", F.bit_count(F.col("point").bitwiseXOR(F.col("fp"))) <= near)
    least = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("point"))
    return reached.select("fp", least.alias("hub")).where("hub is not null and fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, distance: int = DISTANCE, pieces: int | None = None, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) to (u, v) links with the components of all pairs at `distance` bits or fewer."""
    rows = blocks(fps, pieces or pieces_for(fps.count(), distance), distance)
    hot = checkpoint(rows.groupBy("block").count().where(F.col("count") > hot_block).select("block"))
    if hot.isEmpty():
        return _cold_links(rows, distance)
    return _cold_links(rows.join(hot, "block", "left_anti"), distance).unionByName(_hot_links(rows.join(hot, "block", "left_semi"), distance))


def classes(fps: DataFrame, distance: int = DISTANCE, pieces: int | None = None, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(fp, root) for every distinct fingerprint of fps; root is the least fingerprint reachable over links."""
    each = fps.select("fp").distinct()
    found = connected_components(links(each, distance, pieces, hot_block))
    return each.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, pieces: int | None = None, hot_block: int = HOT_BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs.

    Null text counts as empty, fingerprint zero, linked like any other. A row with a null doc_id joins its class but
    does not name it; a class of such rows only has a null component_id. Repeated rows each get their row; an empty
    table gives none. Texts of any length are hashed whole. Other columns are not read.
    """
    each = checkpoint(fingerprints(docs, ["doc_id"]))
    per = each.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = checkpoint(per.join(classes(per, distance, pieces, hot_block), "fp"))
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    # a class may hold a third of all fingerprints: its name goes to several tasks
    named = named.select("root", "component_id", F.explode(F.when(F.col("n") > SALTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"), "n")
    big = named.where("salt = 0").select("root", F.lit(True).alias("big"))
    few = F.broadcast if big.count() <= MOST_BROADCAST else lambda df: df
    salted = roots.join(few(big), "root", "left").withColumn("salt", F.when(F.col("big"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)))
    of_fp = salted.join(named.drop("n"), ["root", "salt"]).select("fp", "component_id")
    return each.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def marked_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of each whole row, and the name of its column."""
    mark = free_name(docs, "tm_row")
    return docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])), mark


def keep_first(docs: DataFrame, marked: DataFrame, mark: str, rooted: DataFrame) -> DataFrame:
    """The first row of each class; rooted has root and first (none, doc_id, row, n)."""
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = checkpoint(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"), F.col("first.n").alias("kept_n")))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(mark) == F.col("kept_row"))
    repeated = kept.where("kept_n > 1")
    if repeated.isEmpty():
        return marked.join(kept, same, "left_semi").select(*docs.columns)
    alone = marked.join(kept.where("kept_n = 1"), same, "left_semi")
    return alone.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates([mark])).select(*docs.columns)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each near-duplicate class, the one of smallest doc_id (null last); columns as given.

    Among rows that share that doc_id one stays, by the least hash of the whole row; equal rows are one document.
    """
    marked, mark = marked_rows(docs)
    each = fingerprints(marked.select("doc_id", "text", F.col(mark).alias("row")), ["doc_id", "row"])
    each = checkpoint(each.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("n")))
    per = each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("first"))
    return keep_first(docs, marked, mark, per.join(classes(per, **how), "fp"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
