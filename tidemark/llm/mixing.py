"""Mixing sources to target weights with exact quotas.

Each source's documents, in the order of a keyed hash, are one stream of words, cut into blocks of equal length. A
source's target is a quota of draws: whole passes over its blocks and, for the rest, as many blocks as a keyed
permutation puts first, the last one in part. A splitting tree deals the draws out: at each node the left half of the
shards gets a multivariate hypergeometric draw from the sources' quotas. A shard owns a range of each source's draws,
so no drawn block is in two, and a keyed hash gives the order inside it. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.chunks import gather
from tidemark.llm.common import bounded, checkpoint, table
from tidemark.llm.simhash import marked_rows

SEED = 20_240_229
WEIGHTS = (1, 2, 3)
CAP = 3
SHARDS = 64
BLOCK_WORDS = 1024
#: Where documents are taken whole: what the ends of blocks add or leave out is less the longer blocks are.
WHOLE_BLOCK_WORDS = 8192
ROUNDS = 6
#: numpy draws from fewer than 10 ** 9 items; more are dealt by several trees whose shares are added up.
MOST_DRAWS = 500_000_000
#: Words in a file of the mixed documents, about.
FILE_WORDS = 32_000_000
#: Tables with a row per source are broadcast up to so many rows, about 10 MB, and shuffled beyond.
MOST_BROADCAST = 100_000


def n_words(text: str):
    """Runs of characters other than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[Fraction]:
    """Shares of sum(sizes) by repeating weights; what is above cap times a size is shared again among the others."""
    left, open_, out = Fraction(sum(sizes)), list(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if unit * weights[i % len(weights)] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard (sources x shards). Rows sum to the quotas, and shards differ by one block at most."""
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, own = todo.pop()
        if hi - lo == 1:
            out[:, lo] = own
            continue
        mid, total = (lo + hi) // 2, int(own.sum())
        share = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, share, method="marginals") if total else own
        todo += [(lo, mid, left), (mid, hi, own - left)]
    return out


def deal(draws: np.ndarray, shards: int, seed: int = SEED, most: int = MOST_DRAWS) -> np.ndarray:
    """splitting_tree for any number of draws: beyond `most` of them, even parts of all quotas have a tree each."""
    parts = max(1, -(-int(draws.sum()) // most))
    return sum(splitting_tree(draws * (i + 1) // parts - draws * i // parts, shards, seed + i) for i in range(parts))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 puts x, each element with an n and a key of its own: a Feistel network that walks on while outside."""
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (x, n, key))
    out = np.zeros_like(x)
    todo = np.flatnonzero(n > 1)
    half = ((np.frexp((n - (n > 0)).astype(float))[1] + 1) // 2).clip(1).astype(np.uint64)
    at = x.copy()
    while len(todo):
        h = half[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        a, b = at[todo] >> h, at[todo] & mask
        for i in range(ROUNDS):
            z = (b + key[todo] + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((z ^ (z >> np.uint64(31))) & mask)
        at[todo] = (a << h) | b
        inside = at[todo] < n[todo]
        out[todo[inside]] = at[todo[inside]]
        todo = todo[~inside]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """A row per source in `sources`: source, no, source_size, target, quota (words to take) and ends of its shards' ranges of draws."""

    sources: DataFrame
    few: bool
    words: int
    shards: int
    block_words: int
    seed: int

    def beside(self, rows: DataFrame) -> DataFrame:
        """A table with a row per source, to be joined: broadcast if its rows are few, which is counted."""
        return F.broadcast(rows) if self.few else rows


def draws_of(size: int, quota: int, block_words: int) -> int:
    """Draws of a quota: blocks and the stub behind them in whole passes, blocks and a part in the rest."""
    if not size:
        return 0
    return quota // size * -(-size // block_words) + -(-(quota % size) // block_words)


def plan(sized: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Plan:
    """sized has source and size. One row per source comes to the driver, and goes back as a table, not in closures."""
    got = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [int(n) for _, n in got]
    wanted = targets(sizes)
    quotas = [round(t) for t in wanted]
    draws = np.array([draws_of(n, q, block_words) for n, q in zip(sizes, quotas, strict=True)], np.int64)
    ends = np.cumsum(deal(draws, shards, seed), axis=1).tolist() if len(draws) else []
    rows = [(s, i, n, float(t), q, e) for i, ((s, n), t, q, e) in enumerate(zip(got, wanted, quotas, ends, strict=True))]
    made = sized.sparkSession.createDataFrame(rows, "m_source string, no long, source_size long, target double, quota long, ends array<long>")
    return Plan(made, len(rows) <= MOST_BROADCAST, sum(sizes), shards, block_words, seed)


def _hash(seed: int, *of):
    """A place from 0 to 2**63 - 1 for a row; only rows equal in these columns share one, but for chance."""
    return F.xxhash64(F.lit(seed), *of).bitwiseAND((1 << 63) - 1)


def positions(sized: DataFrame, rows_per_bucket: int = 2048) -> DataFrame:
    """Add `start`, the words of the row's source that come before it in the order of `place`.

    A two-level prefix sum: totals of buckets of near places, then rows within a bucket; no task gets a whole source.
    """
    bits = max(0, min(22, (sized.count() // rows_per_bucket).bit_length()))
    rows = sized.withColumn("bucket", F.shiftright("place", 63 - bits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    totals = totals.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "offset")
    inner = Window.partitionBy("source", "bucket").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))
    return within.join(totals, same).withColumn("start", F.col("offset") + F.col("inner")).drop("b_source", "b_bucket", "bucket", "inner", "offset")


def draw(block_words: int, seed: int, no: np.ndarray, whole: np.ndarray, quota: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Spans that the mix takes of stretches of streams: (row, draw, block, first word, words) as arrays, cut at block ends.

    no, whole and quota are those of each row's source, start and size the stretch. In a pass of which the whole source
    is taken every block and the stub is drawn once; in the last pass the blocks that the permutation puts first.
    """
    full, stub, safe = whole // block_words, whole % block_words, np.maximum(whole, 1)
    passes, rest = np.where(whole > 0, quota // safe, 0), np.where(whole > 0, quota % safe, 0)
    units, most, left = full + (stub > 0), rest // block_words, rest % block_words
    key = (no.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed)
    has = np.flatnonzero(size > 0)
    first = start[has] // block_words
    n = (start[has] + size[has] - 1) // block_words - first + 1
    row, block = np.repeat(has, n), gather(np.arange(int((first + n).max(initial=0))), first, n)
    a, b = np.maximum(start[row], block * block_words), np.minimum(start[row] + size[row], (block + 1) * block_words)
    parts = []
    for k in range(int(passes.max(initial=0)) + 1):
        turn = key[row] + np.uint64((k + 1) * 0xD1B54A32D192ED03 % 2**64)
        at = np.flatnonzero(passes[row] > k)
        if len(at):
            r = row[at]
            parts.append((r, k * units[r] + permuted(block[at], units[r], turn[at]), block[at], (a - start[row])[at], (b - a)[at]))
        at = np.flatnonzero((passes[row] == k) & (rest[row] > 0))
        if len(at):
            r = row[at]
            rank = np.where(block[at] < full[r], permuted(np.minimum(block[at], np.maximum(full[r] - 1, 0)), full[r], turn[at]), full[r])
            to = np.where(rank < most[r], b[at], np.where(rank == most[r], np.minimum(b[at], block[at] * block_words + left[r]), 0))
            kept = to > a[at]
            r, at, rank, to = r[kept], at[kept], rank[kept], to[kept]
            parts.append((r, k * units[r] + rank, block[at], (a - start[row])[at], to - a[at]))
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def _planned(rows: DataFrame, p: Plan) -> DataFrame:
    return rows.join(p.beside(p.sources), F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source")


def _drawn(rows: DataFrame, p: Plan, carried: list[str], made, schema: str) -> DataFrame:
    """made(the carried columns, draw's arrays, start, size) for batches of rows that have a start in their source's stream."""

    block_words, seed = p.block_words, p.seed

    def run(batches):
        for batch in batches:
            no, whole, quota, start, size = (batch.column(i).to_numpy() for i in range(5))
            yield made(batch.columns[5:], draw(block_words, seed, no, whole, quota, start, size), start, size)

    return rows.select("no", "source_size", "quota", "start", "size", *carried).mapInArrow(run, schema)


def _shard(ends, at):
    """The shard whose range of a source's draws has draw number at."""
    return F.size(F.filter(ends, lambda e: e <= at))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "source", n_words("text").alias("size"), _hash(seed, "doc_id", "text").alias("place"))


def spans(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix word by word: doc_id, source_no, draw, shard, block, first_word, words of every span taken, and `place`, the order inside the shard."""
    sized = checkpoint(_sized(docs, seed))
    p = plan(sized, shards, block_words, seed)
    names = ["doc_id", "source_no", "draw", "block", "first_word", "words"]

    def made(carried, drawn, start, size):
        row, *rest = drawn
        ids, no = (c.take(pa.array(row)) for c in carried)
        return pa.RecordBatch.from_arrays([ids, no, *map(pa.array, rest)], names=names)

    rows = _drawn(_planned(positions(sized), p), p, ["id", F.col("no").alias("source_no")], made, f"doc_id {sized.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names[1:]))
    ends = p.beside(p.sources.select(F.col("no").alias("source_no"), "ends"))
    rows = rows.join(ends, "source_no").withColumn("shard", _shard("ends", F.col("draw"))).drop("ends")
    return rows.withColumn("place", F.xxhash64(F.lit(seed), "source_no", "draw"))


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_spans, shards (numbers of those that hold words of it, joined by commas) of every row.

    taken is the sum over the row's spans. Null text has size 0, a null source is a source, the last; size 0 takes
    nothing, as does a table without words. Each source's taken words sum to its target, rounded. Equal rows are rows
    of their own, in any order among them. doc_id may be null; texts of any length are counted whole and may have spans
    in several shards; an empty table has no rows; other columns are not read.
    """
    sized = checkpoint(_sized(docs, seed))
    p = plan(sized, shards, block_words, seed)

    def made(carried, drawn, start, size):
        row, at, _, _, n = drawn
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row, minlength=len(size))
        draws = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(at[order]))
        taken = np.bincount(row, weights=n, minlength=len(size)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*carried, pa.array(size), pa.array(taken), draws], names=["doc_id", "source_size", "target", "ends", "size", "taken", "draws"])

    schema = f"doc_id {sized.schema['id'].dataType.simpleString()}, source_size long, target double, ends array<long>, size long, taken long, draws array<long>"
    rows = _drawn(_planned(positions(sized), p), p, ["id", F.col("source_size").alias("of"), "target", "ends"], made, schema)
    held = F.array_sort(F.array_distinct(F.transform("draws", lambda x: _shard("ends", x))))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("long").alias("n_spans"), F.array_join(held.cast("array<string>"), ",").alias("shards"))


def apply(docs: DataFrame, shards: int = SHARDS, block_words: int = WHOLE_BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """docs as mixed, whole: a row for each time that the word in a document's middle is drawn. Columns and texts as given.

    A source's words so miss its quota by parts of the documents at the ends of drawn blocks only. Rows come out in
    the shards that the tree dealt them to (a range of files each) and in the local order of their draws.

    Null and empty texts have no words, so the mix takes none of them; very long ones are taken whole, and a null source
    is a source. Equal rows are taken as often as their copies are drawn, in all. An empty table stays empty.
    """
    marked, mark = marked_rows(bounded(docs))
    size = n_words("text").alias("each")
    rows = marked.select("source", F.col(mark).alias("id"), size).where("each > 0").groupBy("source", "id", "each").agg(F.count("*").alias("copies"))
    sized = checkpoint(rows.select("source", "id", "each", "copies", (F.col("each") * F.col("copies")).alias("size"), _hash(seed, "id").alias("place")))
    p = plan(sized, shards, block_words, seed)
    files = max(1, -(-p.words // (FILE_WORDS * shards)))

    def made(batches):
        for batch in batches:
            no, whole, quota, start, each, copies = (batch.column(i).to_numpy() for i in range(6))
            for at in range(0, int(copies.max(initial=0)), 1 << 16):
                few = np.clip(copies - at, 0, 1 << 16)
                r = np.repeat(np.arange(len(copies)), few)
                copy = np.arange(len(r)) - np.repeat(np.cumsum(few) - few, few) + at
                row, number, *_ = draw(block_words, seed, no[r], whole[r], quota[r], start[r] + copy * each[r] + each[r] // 2, np.ones(len(r), np.int64))
                of = pa.array(r[row])
                yield pa.RecordBatch.from_arrays([batch.column(6).take(of), batch.column(7).take(of), pa.array(no[r][row]), pa.array(number)], names=["id", "ends", "no", "draw"])

    drawn = _planned(positions(sized), p).select("no", "source_size", "quota", "start", "each", "copies", "id", "ends").mapInArrow(made, "id long, ends array<long>, no long, draw long")
    local = F.xxhash64(F.lit(seed), "no", "draw").bitwiseAND((1 << 63) - 1)
    file = _shard("ends", F.col("draw")) * files + F.floor(local / F.lit(2.0**63) * files)
    drawn = drawn.select(F.col("id").alias("m_id"), file.cast("int").alias("m_file"), local.alias("m_place"))
    once = checkpoint(sized.where("copies > 1").select(F.col("id").alias("o_id")))
    single, repeated = marked, None
    if not once.isEmpty():
        single = marked.join(once, F.col(mark) == F.col("o_id"), "left_anti")
        repeated = marked.join(once, F.col(mark) == F.col("o_id"), "left_semi").dropDuplicates([mark])
    rows = single if repeated is None else single.unionByName(repeated)
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = rows.alias("d").join(drawn.alias("m"), F.col(f"d.{mark}") == F.col("m.m_id"))
    placed = joined.repartitionById(shards * files, F.col("m.m_file")).sortWithinPartitions("m.m_place")
    return placed.select(*names)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
