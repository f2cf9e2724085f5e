"""Near copies by similarity: SimHash blocks find close texts, the Jaccard similarity of whole shingle sets verifies them.

It is the method of simhash.py at the width that a similarity of 0.8 asks for: a sketch has SKETCH_WORDS times 64 bits.
A table takes some bits of it as a key, texts of equal keys meet in a block, and the Hamming distance over the first
SCREEN_WORDS words says which of them are close. The tables are read as packed chunks, a task holding one part of one.

Texts of equal words are one from the start. Close texts of a block, and what is close to them in turn, are a cluster.
Clusters of all tables that share a text make a group. Up to there only names travel; then the shingles of each text go
to its group, which is searched whole, once: by one task if it is of bounded size, else every text is first held against
the group's least one, and what this leaves in more than one class is searched in tiles of bounded size. So the classes
are those of all verified pairs that meet, while large groups of near copies stay linear.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import flat_bytes
from tidemark.llm.common import bounded, checkpoint, free_name, parallelism, small_batches, trim
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import MOST_BROADCAST, SEED, keep_first, marked_rows

SHINGLE_WORDS = 5
#: Least similarity of a pair, as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
SKETCH_WORDS = 16
#: Bits of a sketch that differ, as a part, between two equally long sets at that similarity; pairs of unequal length differ in fewer.
APART = math.acos(2 * SIMILARITY[0] / sum(SIMILARITY)) / math.pi
#: Chance that a pair at that similarity meets in no table.
MISSED = 1e-5
#: Bits of a table's key, at least; more where blocks would otherwise hold over BLOCK texts by chance.
KEY_BITS, BLOCK = 12, 1024
#: Words of the sketch that are held against each other, and the bits that may differ: 29 do at that similarity, 96 of unrelated texts.
SCREEN_WORDS, SCREEN_BITS = 3, 56
#: Texts of a part of a table, about.
PART = 1 << 18
#: Shingles of a part of a block that is searched; a task holds two parts, however many texts the block has.
TILE_HASHES = 1 << 20
_AT_ONCE = 1 << 12
_SPREAD_ROWS = 1 << 13
_TEXT_BYTES = 2 << 20
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (1, SKETCH_WORDS), np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXED = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A row of a table: the key, the text's name and the words that are compared.
_ENTRY = np.dtype([("key", "<u4"), ("fp", "<i8"), *((f"w{i}", "<u8") for i in range(SCREEN_WORDS))])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins, the end last: A-Z lower-cased, runs of ASCII white space one space, none at the ends."""
    data, offsets = flat_bytes(texts)
    data = _LOWER[data]
    space = np.flatnonzero(data == 32)
    gone = space[(data[np.maximum(space - 1, 0)] == 32) & (space > 0)]
    gone = np.union1d(gone, np.intersect1d(space, offsets[:-1]))
    data, offsets = np.delete(data, gone), offsets - np.searchsorted(gone, offsets)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    gone = ends[data[ends] == 32]
    return np.delete(data, gone), offsets - np.searchsorted(gone, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of normal texts, and where each text's words begin, the end last. Each different word is hashed once."""
    import xxhash

    space = np.flatnonzero(data == 32)
    first = np.union1d(space + 1, offsets[:-1][np.diff(offsets) > 0])
    edges = np.append(first - np.searchsorted(space, first), len(data) - len(space))
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(np.delete(data, space))]).dictionary_encode()
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words.dictionary.to_pylist())), ">u8").astype(np.uint64)
    return hashes[words.indices.to_numpy()], np.searchsorted(first, offsets)


def shingle_sets(texts: pa.Array, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of each text's words, and the different hashes of its shingles, sorted. Fewer words are one shingle, no words have none."""
    import xxhash

    data, offsets = normal(texts)
    view = memoryview(data)
    whole = np.fromiter((xxhash.xxh64_intdigest(view[a:b], SEED) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)), np.uint64, len(texts))
    words, at = word_hashes(data, offsets)
    n = max(0, len(words) - shingle_words + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(shingle_words):
        mixed = (mixed ^ words[i : i + n]) * _MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
    sets = []
    for t, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        if b - a > shingle_words:
            found = np.sort(mixed[a : b - shingle_words + 1])
            sets.append(found[np.append(True, found[1:] != found[:-1])])
        else:
            sets.append(whole[t : t + (b > a)])
    return whole, sets


def _ones(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit, of an array of words; full adders leave a few rows of each power of two to be counted."""
    ones, power = np.zeros(64 * words.shape[1], np.int64), 1
    while True:
        carried = []
        while len(words) > 8:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            odd = a ^ b
            carried.append(a & b | odd & c)
            words = np.concatenate((odd ^ c, words[3 * k :]))
        ones += np.unpackbits(np.ascontiguousarray(words, ">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8) * np.int64(power)
        if not carried:
            return ones
        words, power = np.concatenate(carried), 2 * power


def sketch(found: np.ndarray) -> bytes | None:
    """The set's SimHash, big-endian: a bit is 1 if it is set in over half of the hashes drawn from the shingles. An empty set has none."""
    if not len(found):
        return None
    ones = np.zeros(64 * SKETCH_WORDS, np.int64)
    for at in range(0, len(found), _AT_ONCE):
        drawn = found[at : at + _AT_ONCE, None] ^ _DRAWN
        for m in _MIXED:
            drawn *= m
            drawn ^= drawn >> np.uint64(32)
        ones += _ones(drawn)
    return np.packbits(ones * 2 > len(found)).tobytes()


def key_bits_for(n: int) -> int:
    """Fewest bits of a key for n different texts, so that the work follows n."""
    bits = KEY_BITS
    while bits < 32 and n >> bits > BLOCK:
        bits += 1
    return bits


def tables_of(bits: int) -> np.ndarray:
    """Places in the sketch of the bits of each table's key; as long as they last, no two tables share one."""
    n = math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** bits)))
    draw, each = np.random.default_rng(SEED), 64 * SKETCH_WORDS // bits
    return np.concatenate([draw.permutation(64 * SKETCH_WORDS)[: each * bits].reshape(each, bits) for _ in range(-(-n // each))])[:n]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(arrays).view(np.int64)))


def _hashed(rows: DataFrame) -> DataFrame:
    """doc_id, row and text to doc_id, row, `fp` (a hash of the words) and `sketch`."""

    def run(batches):
        for batch in small_batches(batches, 2, _TEXT_BYTES):
            whole, sets = shingle_sets(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(whole.view(np.int64)), pa.array([sketch(s) for s in sets], pa.binary())], names=["doc_id", "row", "fp", "sketch"])

    return rows.mapInArrow(run, rows.select("doc_id", "row").schema.add("fp", "long").add("sketch", "binary"))


def _sets(rows: DataFrame) -> DataFrame:
    """block, fp and text to block, fp and `hashes`, the shingles."""

    def run(batches):
        for batch in small_batches(batches, 2, _TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(shingle_sets(batch.column(2))[1])], names=["block", "fp", "hashes"])

    return rows.mapInArrow(run, "block long, fp long, hashes array<bigint>")


def _spread(sketches: DataFrame, bits: int, parts: int) -> DataFrame:
    """fp and sketch to tab, part and `packed`, the entries of some texts in that part of that table."""

    def chunks(fp, words):
        lit = np.unpackbits(words, axis=1)
        entry = np.zeros(len(fp), _ENTRY)
        entry["fp"] = fp
        for i in range(SCREEN_WORDS):
            entry[f"w{i}"] = words[:, 8 * i : 8 * i + 8].copy().view(np.uint64)[:, 0]
        for t, places in enumerate(tables_of(bits)):
            entry["key"] = lit[:, places] @ (1 << np.arange(bits, dtype=np.uint32))
            part = entry["key"] % parts
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            packed = [x.tobytes() for x in np.split(entry[order], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t, np.int32)), pa.array(found.astype(np.int32)), pa.array(packed, pa.binary())], names=["tab", "part", "packed"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= _SPREAD_ROWS:
                yield from chunks(*of(held))
                held, n = [], 0
        if n:
            yield from chunks(*of(held))

    def of(held):
        every = pa.Table.from_batches(held).combine_chunks()
        words = b"".join(every.column(1).to_pylist())
        return every.column(0).to_numpy(), np.frombuffer(words, np.uint8).reshape(-1, 8 * SKETCH_WORDS)

    return sketches.mapInArrow(run, "tab int, part int, packed binary")


def _near(entry: np.ndarray, other: np.ndarray) -> np.ndarray:
    apart = sum(np.bitwise_count(entry[f"w{i}"] ^ other[f"w{i}"]) for i in range(SCREEN_WORDS))
    return apart <= SCREEN_BITS


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of n places, the least that each is connected to by the links."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, u, before[v])
        np.minimum.at(least, v, before[u])
        least = least[least]
        if (least == before).all():
            return least


def clusters(entries: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a part of a table sorted by key: places that are close to another of their block, and the least place of each one's cluster.

    Blocks of up to `small` texts are compared at all offsets at once; in larger ones what is close to a text is taken out
    with it, so that a large group of near copies costs in proportion.
    """
    n, key = len(entries), entries["key"]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [n]))
    sizes = np.diff(edges)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    rows = {f: entries[f][at] for f in entries.dtype.names}
    step = 1
    while step < len(at):
        same = rows["key"][:-step] == rows["key"][step:]
        if not same.any():
            break
        apart = sum(np.bitwise_count(rows[f"w{i}"][:-step] ^ rows[f"w{i}"][step:]) for i in range(SCREEN_WORDS))
        near = np.flatnonzero(same & (apart <= SCREEN_BITS))
        us.append(at[near])
        vs.append(at[near + step])
        step += 1
    for k in np.flatnonzero(sizes > small).tolist():
        left = np.arange(edges[k], edges[k + 1])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                j = queue.pop()
                close = _near(entries[left], entries[j])
                if close.any():
                    us.append(np.full(np.count_nonzero(close), j))
                    vs.append(left[close])
                    queue.extend(left[close].tolist())
                    left = left[~close]
    u, v = np.concatenate(us), np.concatenate(vs)
    least = _joined(n, u, v)
    places = np.union1d(u, v)
    return places, least[places]


def _members(sketches: DataFrame) -> DataFrame:
    """Different fp with their sketches to different (fp, hub): the texts of all tables' clusters of two or more, but the least, and the least."""
    spark = sketches.sparkSession
    texts = sketches.count()
    bits, parts = key_bits_for(texts), max(1, texts // PART)
    small = max(256, 2 * texts >> bits)

    def found(held):
        entries = np.concatenate(held)
        entries = entries[np.lexsort((entries["fp"], entries["key"]))]  # the least fp of a cluster comes first
        places, least = clusters(entries, small)
        places, least = places[places != least], least[places != least]
        return pa.RecordBatch.from_arrays([pa.array(entries["fp"][places]), pa.array(entries["fp"][least])], names=["fp", "hub"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for *key, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if held:
                        yield found(held)
                    now, held = key, []
                held.append(np.frombuffer(packed, _ENTRY))
        if held:
            yield found(held)
        trim()

    rows = _spread(sketches, bits, parts).repartition(parallelism(spark), "tab", "part").sortWithinPartitions("tab", "part")
    return rows.mapInArrow(run, "fp long, hub long").distinct()


def links_of_block(root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of verified pairs that connect what all verified pairs connect, where equal roots are connected already."""
    p, q = SIMILARITY
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    seen, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, left, out = np.zeros(len(seen), bool), np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        queue = np.flatnonzero(root == root[i]).tolist()
        left[queue] = False
        while queue and left.any():
            j, rest = queue.pop(), np.flatnonzero(left)
            mine = flat[starts[j] : ends[j]]
            mark[mine] = True
            if len(rest) * 8 < len(sets):
                both = np.array([np.count_nonzero(mark[flat[starts[k] : ends[k]]]) for k in rest.tolist()])
            else:
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[rest]
            mark[mine] = False
            for k in rest[q * both >= p * (sizes[rest] + sizes[j] - both)].tolist():
                out.append((k, j))
                if left[k]:
                    more = np.flatnonzero(left & (root == root[k]))
                    left[more] = False
                    queue.extend(more.tolist())
    return out


def _tiles(rows: DataFrame) -> DataFrame:
    """block, fp, root, hashes to the same with `a` and `b`, so that any two texts of a block meet in a tile (block, a, b).

    A block is cut by a hash into parts of about TILE_HASHES shingles (`parts` of them, counted here if rows doesn't say);
    a tile holds two of them, or all of a small block.
    """
    cut = rows if "parts" in rows.columns else rows.join(checkpoint(_parts(rows)), "block")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    met = cut.select("block", "fp", "root", "hashes", "parts", "part", other).where("other != part or parts = 1")
    return met.select("block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "fp", "root", "hashes")


def _parts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.ceil(F.sum(F.size("hashes")) / TILE_HASHES).alias("parts"))


def _searched(rows: DataFrame) -> DataFrame:
    """block, fp, root, hashes to links (u, v); a task holds one tile of a block at a time."""

    def links(held):
        fp, root = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        return [(int(fp[a]), int(fp[b])) for a, b in links_of_block(root, [x[2] for x in held])]

    def run(batches):
        tile, held = None, []

        def made():
            u, v = zip(*found, strict=True) if (found := links(held)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            *keys, fps, roots, hashes = batch.columns
            for k, (*key, fp, root) in enumerate(zip(*(c.to_pylist() for c in (*keys, fps, roots)), strict=True)):
                if key != tile:
                    if held:
                        yield made()
                    tile, held = key, []
                held.append((fp, root, hashes[k].values.to_numpy()))
        if held:
            yield made()

    n = parallelism(rows.sparkSession)
    return _tiles(rows).repartition(n, "block", "a", "b").sortWithinPartitions("block", "a", "b").mapInArrow(run, "u long, v long")


def _named(links: DataFrame) -> DataFrame:
    """(u, v) to (node, root) of what the links of each partition connect, root the least; roots themselves are left out.

    A task holds its links, fewer than the texts whose shingles came to it.
    """

    def run(batches):
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if len(batch)]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
            least = nodes[_joined(len(nodes), at[: len(u)], at[len(u) :])]
            other = least != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(least[other])], names=["node", "root"])

    return links.mapInArrow(run, "node long, root long")


def _large_classes(rows: DataFrame) -> DataFrame:
    """block, fp, hashes, parts of groups of many parts to (node, root). Each text is held against the group's least one; groups that this leaves open are searched."""
    p, q = SIMILARITY
    least = rows.where("fp = block").select("block", F.col("hashes").alias("first"))
    both = F.size(F.array_intersect("hashes", "first"))
    near = q * both >= p * (F.size("hashes") + F.size("first") - both)
    rooted = checkpoint(rows.join(least, "block").select("block", "fp", F.when(near, F.col("block")).otherwise(F.col("fp")).alias("root")))
    open_ = checkpoint(rooted.groupBy("block").agg(F.max(F.col("root") != F.col("block")).alias("open")).where("open").select("block"))
    stars = rooted.where("fp != block and root = block")
    found = stars.join(open_, "block", "left_anti").select(F.col("fp").alias("node"), "root")
    if open_.isEmpty():
        return found
    links = _searched(rows.join(open_, "block", "left_semi").join(rooted.select("fp", "root"), "fp"))
    return found.unionByName(connected_components(stars.join(open_, "block", "left_semi").select(F.col("fp").alias("u"), F.col("root").alias("v")).unionByName(links)))


def classes(sets: DataFrame) -> DataFrame:
    """block, fp, hashes of groups to (node, root) of texts that verified links connect with another; root is the least fp reachable.

    A group of one part is one task's, and so are its classes. Only larger ones need components of links of many tasks.
    """
    large = checkpoint(_parts(sets).where("parts > 1"))
    none = large.isEmpty()
    small = sets if none else sets.join(large, "block", "left_anti")
    found = _named(_searched(small.select("block", "fp", F.col("fp").alias("root"), "hashes", F.lit(1).cast("long").alias("parts"))))
    return checkpoint(found if none else found.unionByName(_large_classes(sets.join(large, "block"))))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate class, the one of smallest doc_id (null last); columns as given.

    Classes are what pairs of five-word shingle similarity of 0.8 or more connect. Null text and text without words
    are one text. Among rows that share that doc_id one stays, by the least hash of the whole row; equal rows are one.
    """
    marked, mark = marked_rows(bounded(docs))
    hashed = checkpoint(_hashed(marked.select("doc_id", F.col(mark).alias("row"), F.col("text").cast("binary").alias("text"))))
    each = hashed.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("n"))
    per = checkpoint(each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("first")))
    sketches = checkpoint(hashed.where("sketch is not null").select("fp", "sketch").dropDuplicates(["fp"]))
    groups = connected_components(_members(sketches).select(F.col("fp").alias("u"), F.col("hub").alias("v"))).select(F.col("node").alias("fp"), F.col("root").alias("block"))
    named = per.join(groups, "fp").select("block", F.col("fp").alias(fp := free_name(marked, "tm_fp")), F.col("first.doc_id").alias("of_id"), F.col("first.row").alias("of_row"))
    texts = marked.select(F.col("doc_id").alias("at_id"), F.col(mark).alias("at_row"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(named, F.col("at_id").eqNullSafe(F.col("of_id")) & (F.col("at_row") == F.col("of_row")))
    found = classes(checkpoint(_sets(texts.select("block", F.col(fp).alias("fp"), "text")).dropDuplicates(["fp"])))
    rooted = per.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    return keep_first(docs, marked, mark, rooted)
