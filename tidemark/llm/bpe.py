"""Byte-level BPE in padded numpy matrices, by a rank file in tiktoken's format.

Pieces of similar length share a matrix of part ids. In each round every row merges its leftmost pair of least
rank, so each live row loses one column and the matrix is compacted to one column less; finished rows leave it.
Ranks of pairs come from an open-addressing hash table. Pieces over `LONGEST` bytes are first cut where no token has
the two bytes side by side, which no merge can cross; what is longer still is a row of its own, in which a round merges
all pairs of the least rank, leftmost first, as one after the other would.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.chunks import Chunks, flat_bytes, gather
from tidemark.llm.common import bounded, sha256, small_batches, table, trim

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WIDTHS = (6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
LONGEST = WIDTHS[-1]
ROWS = 8192
NONE = np.iinfo(np.int32).max
#: Bytes of text that are encoded at once; one long text may be more.
AT_ONCE = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids; linear probing in a table at most a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(rank))))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ranks[slot[won]] = key[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, NONE where there is no such pair or an id is -1 (padding), for such keys are negative and not in the table."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


#: Kinds of bytes: letters, digits, and signs but the apostrophe, which may begin an ending of its own; 0 for the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[b for b in range(33, 127) if not _KIND[b] and b != 39]] = 3
#: First bytes whose two-byte characters are all letters, but for those two of 0xC3.
_LEADS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1)
_NO_LETTERS = (0x97, 0xB7)


def kinds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte of chunks, and which chunks are plain: their matches of the pattern are the runs of a kind.

    These have bytes of known kinds only, behind one white space or none; a blank goes with what follows, other white
    space is a match of its own.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(np.isin(data, _LEADS))
    lead = lead[lead + 1 < len(data)]
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail < 0xC0) & ~((data[lead] == 0xC3) & np.isin(tail, _NO_LETTERS))]
    kind[lead] = kind[lead + 1] = 1
    first = offsets[:-1]
    space = np.isin(data[first], (9, 10, 11, 12, 13, 32)) & (np.diff(offsets) > 1)
    kind[first[space]] = 4
    plain = np.minimum.reduceat(kind, first) > 0
    blank = first[space & (data[first] == 32)]
    kind[blank] = kind[blank + 1]
    return kind, plain


class Tokenizer:
    """path is a rank file; texts are split by public_tokenizers.PATTERN, no match of which goes on behind white space."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        top = max(ranks.values()) + 1
        bytes_of: list[bytes] = [b""] * top
        for token, i in ranks.items():
            bytes_of[i] = token
        self.bytes_of = pa.array(bytes_of, pa.large_binary())
        self.tokens, self.token_ids = pa.array(list(ranks), pa.large_binary()), np.fromiter(ranks.values(), np.int32, len(ranks))
        self.digits = pa.array([b",%d" % i for i in range(top)], pa.large_binary())
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = np.array([(l, r, i) for token, i in ranks.items() for k in range(1, len(token)) if (l := ranks.get(token[:k])) is not None and (r := ranks.get(token[k:])) is not None], np.int32).T
        self.pairs = PairTable(*found)
        #: Ids that can be part of a pair of lower rank, which is then merged before others of the id's own rank.
        self.restless = np.zeros(top, bool)
        self.restless[np.maximum(found[0], found[1])[found[2] < np.maximum(found[0], found[1])]] = True
        flat = np.frombuffer(b"".join(ranks), np.uint8)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(np.fromiter(map(len, ranks), np.int64, len(ranks))) - 1] = False
        at = np.flatnonzero(inside)
        self.adjacent = np.zeros((256, 256), bool)
        self.adjacent[flat[at], flat[at + 1]] = True
        self.chunks = Chunks(self._learn)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Part ids, one piece a row, padded at the right with -1, to token ids padded alike."""
        out = np.full(ids.shape, -1, np.int32)
        rows = np.arange(len(ids))
        flat = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = flat.reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                out[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = best
            kept = np.ones(ids.shape, bool)
            kept[each, at + 1] = False
            ids = ids[kept].reshape(len(rows), -1)
            ranks = ranks[kept].reshape(len(rows), -1)
            after = np.minimum(at + 1, ids.shape[1] - 1)
            ranks[each, at] = np.where(at + 1 < ids.shape[1], self.pairs.find(best, ids[each, after]), NONE)
            prior = np.flatnonzero(at > 0)
            ranks[prior, at[prior] - 1] = self.pairs.find(ids[prior, at[prior] - 1], best[prior])
        return out

    def merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """One row of any length. A round takes all pairs of the least rank, up to the first whose merge makes a pair of a lower rank."""
        ranks = np.append(self.pairs.find(ids[:-1], ids[1:]), np.int32(NONE))
        while (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                opens = np.append(True, np.diff(at) != 1)
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
            if self.restless[best]:
                before = np.where(at > 0, ids[at - 1], -1)
                before[1:][np.diff(at) == 2] = best
                behind = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                lower = np.minimum(self.pairs.find(before, np.full_like(before, best)), self.pairs.find(np.full_like(behind, best), behind)) < best
                if lower.any():
                    at = at[: lower.argmax() + 1]
            ids[at] = best
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, ranks = ids[kept], ranks[kept]
            at -= np.arange(len(at))
            changed = np.concatenate((at[at > 0] - 1, at[at < len(ids) - 1]))
            ranks[changed] = self.pairs.find(ids[changed], ids[changed + 1])
            ranks[-1] = NONE
        return ids

    def _parts(self, data: np.ndarray, first: int, n: int) -> list[int]:
        """Ends of the parts of a long piece that no merge can join: no token has the bytes on both sides of a cut side by side."""
        b = data[first : first + n]
        return [*(np.flatnonzero(~self.adjacent[b[:-1], b[1:]]) + first + 1).tolist(), first + n]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces (large binary) in a row, and how many each has; a piece that is itself a token takes no merges."""
        data, offsets = flat_bytes(pieces)
        whole = pc.fill_null(pc.index_in(pieces, value_set=self.tokens), -1).to_numpy()
        known = np.flatnonzero(whole >= 0)
        of = np.flatnonzero(whole < 0)
        first, lengths = offsets[of], np.diff(offsets)[of]
        if len(long := np.flatnonzero(lengths > LONGEST)):
            ends = [self._parts(data, int(first[k]), int(lengths[k])) for k in long]
            starts = [[int(first[k]), *e[:-1]] for k, e in zip(long, ends, strict=True)]
            more = np.repeat(of[long], list(map(len, ends)))
            first, lengths = np.delete(first, long), np.delete(lengths, long)
            first, of = np.concatenate((first, *starts)).astype(np.int64), np.concatenate((np.delete(of, long), more))
            lengths = np.concatenate((lengths, *ends)).astype(np.int64)
            lengths[-len(more) :] -= first[-len(more) :]
        order, place, parts, sizes = [known], [offsets[known]], [self.token_ids[whole[known]]], [np.ones(len(known), np.int64)]
        for narrower, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            group = np.flatnonzero((lengths > narrower) & (lengths <= width))
            for at in range(0, len(group), ROWS):
                part = group[at : at + ROWS]
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < lengths[part][:, None]] = self.byte_id[gather(data, first[part], lengths[part])]
                merged = self.merge_rows(ids)
                kept = merged >= 0
                order.append(of[part])
                place.append(first[part])
                parts.append(merged[kept])
                sizes.append(kept.sum(axis=1))
        for k in np.flatnonzero(lengths > LONGEST).tolist():
            merged = self.merge_wide(self.byte_id[data[first[k] : first[k] + lengths[k]]])
            order.append(of[k : k + 1])
            place.append(first[k : k + 1])
            parts.append(merged)
            sizes.append(np.array([len(merged)]))
        order, place, parts, sizes = map(np.concatenate, (order, place, parts, sizes))
        by_place = np.argsort(place)
        flat = gather(parts, (np.cumsum(sizes) - sizes)[by_place], sizes[by_place])
        return flat, np.bincount(order, weights=sizes, minlength=len(pieces)).astype(np.int64)

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of common letters, digits and signs are split all at once, the others by the pattern, one by one."""
        data, offsets = np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([0, *map(len, chunks)])
        kind, plain = kinds(data, offsets)
        others = [self.pattern.findall(chunks[k].decode("utf-8", "replace")) for k in np.flatnonzero(~plain).tolist()]
        spelt = [p.encode() for p in chain.from_iterable(others)]
        opens = np.append(True, kind[1:] != kind[:-1])
        opens[offsets[:-1]] = True
        n_plain = np.diff(offsets) * plain
        at, bytes_of = gather(opens, offsets[:-1], n_plain), gather(data, offsets[:-1], n_plain)
        edges = np.concatenate((np.flatnonzero(at), len(bytes_of) + np.cumsum([0, *map(len, spelt)])))
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.concatenate((bytes_of, np.frombuffer(b"".join(spelt), np.uint8))))]).dictionary_encode()
        flat, n = self.encode_pieces(coded.dictionary)
        of, counts = coded.indices.to_numpy(), np.zeros(len(chunks), np.int64)
        counts[plain] = np.diff(np.append(0, np.cumsum(at))[np.append(0, np.cumsum(n_plain))])[plain]
        counts[~plain] = list(map(len, others))
        after, split = np.cumsum(counts), int(counts[plain].sum())
        order = np.empty(int(counts.sum()), np.int64)
        for mine, pieces in ((plain, of[:split]), (~plain, of[split:])):
            order[gather(np.arange(len(order)), (after - counts)[mine], counts[mine])] = pieces
        return gather(flat, (np.cumsum(n) - n)[order], n[order]), np.diff(np.append(0, np.cumsum(n[order]))[np.append(0, after)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of whole texts (UTF-8, binary) in a row, as encode_ordinary of the tiktoken library gives them, and where each text's begin, the end last.

        Null is the empty text. Bytes that are not UTF-8 count as U+FFFD, as Python's decoding with "replace" has it.
        """
        return self.chunks.numbers(texts)

    def rest(self) -> None:
        """Forget chunks, at the end of a task."""
        self.chunks.clear()
        trim()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
        return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return bytes(self.spell(np.array(ids, np.int32), np.array([0, len(ids)]))[0])

    def _spelled(self, words: pa.Array, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """words[i] for all ids, joined per text."""
        got = words.take(pa.array(ids))
        _, offsets, data = got.buffers()
        edges = np.frombuffer(offsets, np.int64)[at].tolist() if len(got) else [0] * len(at)
        view = memoryview(data) if data else memoryview(b"")
        return [view[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def spell(self, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """The bytes that ids stand for, per text."""
        return self._spelled(self.bytes_of, ids, at)

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """Decimal ids joined by commas, per text."""
        return [x[1:] for x in self._spelled(self.digits, ids, at)]


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(path or public_tokenizers.path(VOCABULARY))


def encode(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """keys and `ids`, the token ids of the whole text; null text has none."""

    def run(batches):
        coder = tokenizer(path)
        for batch in small_batches(batches, len(keys), AT_ONCE):
            ids, at = coder.encode(batch.column(len(keys)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=[*batch.schema.names[:-1], "ids"])

    rows = docs.select(*keys, F.col(text).cast("binary").alias("__text"))
    return rows.mapInArrow(run, rows.drop("__text").schema.add("ids", ArrayType(IntegerType())))


def decode(tokens: DataFrame, keys: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """keys and `bytes`, what the ids stand for; null ids give empty bytes."""

    def run(batches):
        coder = tokenizer(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            made = coder.spell(lists.flatten().to_numpy().astype(np.int32), np.append(0, np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(bytes, made), pa.binary())], names=[*batch.schema.names[:-1], "bytes"])

    rows = tokens.select(*keys, F.col(ids).alias("__ids"))
    return rows.mapInArrow(run, rows.drop("__ids").schema.add("bytes", "binary"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes decoded from the ids) of every row.

    Null text is the empty text, which has no tokens and the digests of nothing. Equal rows give equal rows, an empty
    table none; doc_id may be null; other columns are not read. Texts of any length are taken whole; bytes that are
    not UTF-8 count as U+FFFD.
    """

    def run(batches):
        coder = tokenizer(path)
        for batch in small_batches(batches, 1, AT_ONCE):
            ids, at = coder.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(map(sha256, coder.decimals(ids, at)), pa.string()), pa.array(map(sha256, coder.spell(ids, at)), pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.rest()

    rows = bounded(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
