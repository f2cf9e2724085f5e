"""Toxicity by a weighted finite-state pattern grammar whose word weights are learned from labels.

Words become classes (insult, threat, target, negation, report, break, other) through a lexicon. A transducer that reads
a clause from its end tells each attack what follows it; transducers for reported speech, negation, targets, insults and
threats, composed into one machine, then read it from its start and put the weight of every attack on a channel: plain,
aimed at somebody, negated or reported. A logistic curve over the channels gives the score, so a word counts by its clause.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.chunks import Chunks
from tidemark.llm.common import bounded, checkpoint, small_arrays, small_batches, table

#: Labelled rows that the classifier is fitted on, the ones of least hash; the only bounded sample here.
MOST_LABELS = 20_000
THRESHOLD = 0.7
PREFIXES = range(3, 8)
#: Bytes of text that are scored at once; one long text may be more.
AT_ONCE = 4 << 20

NEGATIONS = frozenset("not no never nobody none cannot isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say told tells called calls wrote writes quoted claims claimed reported allegedly accused sagte sagt schrieb nannte behauptet dit disait écrit appelle prétend dijo dice escribió llamó afirma".split())
TARGETS = frozenset("you your yours yourself u ur they them their he him she her du dich dir dein deine euch ihr tu te toi vous ton ta tes votre vos usted ustedes ti tus vosotros".split())
THREATS = frozenset("kill hurt destroy murder shoot stab burn hang beat töten umbringen schlagen erschießen tuer frapper égorger brûler matar golpear quemar".split())
INSULTS = frozenset("idiot idiots idiotic moron morons stupid dumb imbecile scum trash garbage loser losers worthless pathetic disgusting clown fool vermin bastard dummkopf arschloch trottel abschaum connard crétin ordure imbécile estúpido basura escoria".split())
SEED_INSULT, SEED_THREAT = 4.0, 3.0

_BREAKS = ".!?;:,\n\"“”«»()|"
_SPLIT = "\0"
_TOKEN = re.compile(rf"[^\W\d_]+|[{_BREAKS}{_SPLIT}]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
ATTACKS = (INSULT, THREAT)
PLAIN, AIMED, NEGATED, REPORTED = range(4)
#: What follows in the clause: nothing, words without a target, a target within NEAR_WORDS, a later one.
LAST, NO_TARGET, NEAR, LATER = range(4)
NEAR_WORDS = 2
_SEEN = "target before"


@dataclass(frozen=True)
class Transducer:
    """step(state, symbol) gives the next state, the symbol put out and a factor on its weight. A symbol is a class, what follows it, and the marks set so far."""

    start: int
    step: object


def _mark(symbol: tuple, mark, classes: tuple = ATTACKS) -> tuple:
    return (*symbol, mark) if symbol[0] in classes else symbol


#: Read from the end of the clause: state 0 is the end, 1 no target, 2 and 3 a target one and two words on, 4 a later one.
LOOKAHEAD = Transducer(0, lambda s, x: (2 if x[0] == TARGET else (1, 1, 3, 4, 4)[s], (x[0], (LAST, NO_TARGET, NEAR, NEAR, LATER)[s]), 1.0))
#: After a verb of saying, what follows in the clause is somebody else's.
REPORTED_SPEECH = Transducer(0, lambda s, x: (1 if x[0] == REPORT else s, _mark(x, REPORTED) if s else x, 1.0))
#: A negation reaches over the next four words.
NEGATING = Transducer(0, lambda s, x: (4 if x[0] == NEGATION else max(0, s - 1), _mark(x, NEGATED) if s else x, 1.0))
#: Whether a target stands before.
TARGETING = Transducer(0, lambda s, x: (1 if x[0] == TARGET else s, _mark(x, _SEEN) if s else x, 1.0))
#: An insult is aimed by a target anywhere in the clause; the second and later ones add less.
INSULTING = Transducer(0, lambda s, x: (s, x, 1.0) if x[0] != INSULT else (min(2, s + 1), _mark(x, AIMED) if _SEEN in x or x[1] in (NEAR, LATER) else x, (1.0, 0.7, 0.5)[s]))
#: A threat is aimed by a target soon after it, or by one before it if it is the last word; without, it is mostly none.
THREATENING = Transducer(0, lambda s, x: (s, x, 1.0) if x[0] != THREAT else (min(2, s + 1), _mark(x, AIMED), (1.0, 0.7, 0.5)[s]) if x[1] == NEAR or (x[1] == LAST and _SEEN in x) else (min(2, s + 1), x, (0.2, 0.14, 0.1)[s]))
PARTS = (REPORTED_SPEECH, NEGATING, TARGETING, INSULTING, THREATENING)


def channel_of(symbol: tuple) -> int:
    """Of a symbol with all its marks; -1 if it is no attack."""
    marks = symbol[2:]
    return -1 if symbol[0] not in ATTACKS else next((c for c in (REPORTED, NEGATED, AIMED) if c in marks), PLAIN)


def compose(*parts: Transducer) -> dict[tuple[int, int, int], tuple[int, int, float]]:
    """(state, class, what follows) to (next state, channel or -1, factor) for the parts run one into the next; state 0 starts a clause."""
    number, todo, out = {tuple(p.start for p in parts): 0}, [tuple(p.start for p in parts)], {}
    while todo:
        state = todo.pop()
        for c in CLASSES:
            for follows in range(4):
                symbol, factor, after = (c, follows), 1.0, []
                for p, s in zip(parts, state, strict=True):
                    s, symbol, f = p.step(s, symbol)
                    after.append(s)
                    factor *= f
                after = tuple(after)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                out[number[state], c, follows] = (number[after], channel_of(symbol), factor)
    return out


GRAMMAR = compose(*PARTS)


def walk(clause: list[int]) -> list[tuple[int, float]]:
    """Channel and factor of each attack of a clause, given as classes."""
    follows, state = [0] * len(clause), LOOKAHEAD.start
    for i in range(len(clause) - 1, -1, -1):
        state, (_, follows[i]), _ = LOOKAHEAD.step(state, (clause[i],))
    out, state = [], 0
    for c, f in zip(clause, follows, strict=True):
        state, channel, factor = GRAMMAR[state, c, f]
        if channel >= 0:
            out.append((channel, factor))
    return out


def features_of(word: str) -> list[str]:
    """The word and its beginnings, by which inflected and compound forms are known."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Lexicon(Chunks):
    """Words of chunks as numbers: a class, or for an attack _FIRST and its place among the attacks known so far.

    Learned weights add to the lists above; a word that has one and is in no list of attacks is an insult.
    """

    _FIRST = 16
    #: Attacks kept from one batch of texts to the next.
    _MOST = 50_000

    def __init__(self, weights: dict[str, float]):
        fixed = {w: c for c, words in ((TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (INSULT, INSULTS)) for w in words} | dict.fromkeys(_BREAKS, BREAK)
        self.fixed, self.fixed_class = pa.array(list(fixed), pa.large_string()), np.fromiter(fixed.values(), np.int32, len(fixed))
        self.learned = []
        for k in (0, *PREFIXES):
            mine = {f.removesuffix("*"): w for f, w in weights.items() if (len(f) - 1 == k and f[-1] == "*" if k else f[-1:] != "*")}
            if mine:
                self.learned.append((k, pa.array(list(mine), pa.large_string()), np.array(list(mine.values()))))
        super().__init__(self._numbers)
        self.kind, self.weight, self.known = np.zeros(0, np.int32), np.zeros(0), {}

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self._MOST:
            self.clear()
            self.kind, self.weight, self.known = np.zeros(0, np.int32), np.zeros(0), {}
        return super().numbers(texts)

    def _numbers(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(_SPLIT.encode().join([c.replace(b"\0", b"\1") for c in chunks]).decode("utf-8", "replace").lower())
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        number = self.classify(coded.dictionary)[coded.indices.to_numpy()]
        ends = np.flatnonzero(number < 0)
        return number[number >= 0], np.diff(np.concatenate(([-1], ends, [len(number)]))) - 1

    def classify(self, words: pa.Array) -> np.ndarray:
        """Numbers of different words; -1 for what stands between chunks."""
        place = pc.fill_null(pc.index_in(words, value_set=self.fixed), -1).to_numpy()
        number = np.where(place >= 0, self.fixed_class[place], OTHER).astype(np.int32)
        weight, length = np.zeros(len(words)), pc.utf8_length(words).to_numpy()
        for k, beginnings, weights in self.learned:
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, 0, k) if k else words, value_set=beginnings), -1).to_numpy()
            weight = np.maximum(weight, np.where((at >= 0) & ((length > k) if k else True), weights[at], 0.0))
        number[(weight > 0) & (number == OTHER)] = INSULT
        weight = np.maximum(weight, np.where(place < 0, 0.0, np.where(number == INSULT, SEED_INSULT, SEED_THREAT)))
        attacks = np.flatnonzero((number == INSULT) | (number == THREAT))
        spelt = words.take(pa.array(attacks)).to_pylist()
        fresh = np.array([k for k, w in enumerate(spelt) if w not in self.known], np.int64)
        self.known.update((spelt[k], len(self.kind) + j) for j, k in enumerate(fresh.tolist()))
        self.kind, self.weight = np.append(self.kind, number[attacks[fresh]]), np.append(self.weight, weight[attacks[fresh]])
        number[attacks] = np.fromiter((self._FIRST + self.known[w] for w in spelt), np.int32, len(spelt))
        number[pc.equal(words, _SPLIT).to_numpy(zero_copy_only=False)] = -1
        return number


N_FEATURES = 9
#: What the fit is drawn to where labels say little: an attack that is not aimed counts little.
PRIOR = np.array([0.4, 1.6, 0.2, 0.2, 0.6, 0.3, 0.5, 0.3, 0.0])


def describe(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: channel sums, the strongest hit, number of different hits, weight for the length, share of attacked clauses, length."""
    codes, at = lexicon.numbers(texts)
    n, docs = np.diff(at), len(at) - 1
    doc = np.repeat(np.arange(docs), n)
    stop = codes == BREAK
    clauses = 1 + np.bincount(doc[stop], minlength=docs)
    hit = np.flatnonzero(codes >= Lexicon._FIRST)
    opens = np.zeros(len(codes), bool)
    opens[at[:-1][n > 0]] = True
    opens[1:] |= stop[:-1]
    edges = np.append(np.flatnonzero(opens), len(codes))
    attacked = np.unique(np.searchsorted(edges, hit, side="right") - 1)
    entry = codes[hit] - Lexicon._FIRST
    classes = codes.copy()
    classes[hit] = lexicon.kind[entry]
    found = []
    for a, b in zip(edges[attacked].tolist(), edges[attacked + 1].tolist(), strict=True):
        found += walk(classes[a : b - 1 if stop[b - 1] else b].tolist())
    channel, factor = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found])
    weight, of = lexicon.weight[entry] * factor, doc[hit]
    sums = np.bincount(of * 4 + channel, weights=weight, minlength=4 * docs).reshape(docs, 4)
    strongest = np.zeros(docs)
    np.maximum.at(strongest, of, weight)
    different = np.bincount(np.unique(np.stack((of, entry)), axis=1)[0], minlength=docs)
    attacked = np.bincount(doc[edges[attacked]], minlength=docs)
    return np.column_stack((np.log1p(sums), strongest / 4, np.log1p(different), sums.sum(axis=1) / np.sqrt(n + 20), 10 * attacked / (clauses + 10), np.log1p(n) / 4))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    coefficients: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.coefficients + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def log_odds(a: int, b: int, toxic: int, clean: int) -> float:
    return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))


def evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Twice the log likelihood ratio against independence, negative for a sign of clean text."""
    if min(a, b, toxic, clean, toxic - a, clean - b) < 0 or not toxic or not clean:
        return 0.0
    n = toxic + clean
    cells = ((a, (a + b) * toxic), (b, (a + b) * clean), (toxic - a, (n - a - b) * toxic), (clean - b, (n - a - b) * clean))
    g = 2 * sum(o * math.log(o * n / e) for o, e in cells if o)
    return g if a * clean > b * toxic else -g


def lexicon_weights(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float, left_out: int | None = None) -> dict[str, float]:
    """Log odds of the features with evidence of at least `least`; left_out is the label of a document to be discounted."""
    t, c = left_out == 1, left_out == 0
    out = {}
    for f, a, b in counts:
        args = (a - t, max(0, b - c), toxic - t, clean - c)
        if a - t >= 2 and evidence(*args) >= least and (w := log_odds(*args)) > 2:
            out[f] = w
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps, drawn to PRIOR."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    prior = np.append(PRIOR, 0.0)
    penalty = np.append(np.full(N_FEATURES, ridge), 0.01)
    b = np.append(PRIOR * 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        grad = z.T @ (y - p) - penalty * (b - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        b = b + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], mean, scale, float(b[-1])


def remainder(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def _evidence_sql(a, b, toxic: int, clean: int):
    """evidence() as a column, for signs of toxic text."""
    n = toxic + clean
    term = lambda o, e: F.when(o > 0, o * F.log(o * F.lit(float(n)) / e)).otherwise(0.0)
    return 2 * (term(a, (a + b) * toxic) + term(b, (a + b) * clean) + term(toxic - a, (n - a - b) * toxic) + term(clean - b, (n - a - b) * clean))


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model:
    """Learn from labelled rows whose remainder is not 1: at most most_labels doc_ids, by least hash.

    Only doc_id and toxic of labels are read, and only texts of docs. Null ids and labels are left out; an id labelled
    both ways is toxic, and of texts that share an id one is taken, so the sample's size bounds all that is learned.
    Each training document's own words are discounted when its features are computed. Without both labels, the lists
    alone count.
    """
    sample = labels.where("toxic is not null and doc_id is not null").where(remainder() != 1).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    texts = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = checkpoint(texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("y", F.col("text").cast("binary").alias("text")))
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in small_batches(batches, 1):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for w in set(_TOKEN.findall(text.decode("utf-8", "replace").lower())):
                    if w[0].isalpha():
                        own.update(features_of(w))
                for f in own:
                    seen.setdefault(f, [0, 0])[1 - y] += 1
                if len(seen) > 100_000:
                    yield _counts(seen)
                    seen = {}
        yield _counts(seen)

    counted = texts.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 3")
    counted = checkpoint(counted)
    least = 2 * math.log(max(2, counted.count()))
    a, b = F.col("a"), F.col("b")
    likely = counted.where(a >= 2).where(a * clean > b * toxic).where(_evidence_sql(a, b, toxic, clean) >= least - 2)
    counts = [(r["feature"], r["a"], r["b"]) for r in likely.orderBy("feature").collect()] if toxic and clean else []
    weights = {y: lexicon_weights(counts, toxic, clean, least, y) for y in (None, 0, 1)}

    def features(batches):
        own = {y: Lexicon(weights[y]) for y in (0, 1)}
        for batch in small_batches(batches, 1, AT_ONCE):
            for y in (0, 1):
                mine = batch.filter(pc.equal(batch.column(0), y))
                if mine.num_rows:
                    yield pa.RecordBatch.from_arrays([mine.column(0), pa.array(list(describe(mine.column(1), own[y])), pa.list_(pa.float64()))], names=["y", "x"])

    got = texts.mapInArrow(features, "y int, x array<double>").collect()
    if not toxic or not clean:
        return Model(weights[None], PRIOR, np.zeros(N_FEATURES), np.ones(N_FEATURES), -4.0)
    got.sort(key=lambda r: (r["y"], r["x"]))
    return Model(weights[None], *fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)))


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["feature", "a", "b"])


def scorer(model: Model):
    """A column function from whole texts to scores; null counts as empty."""
    kept: list[Lexicon] = []

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Lexicon(model.weights))
        texts = texts.cast(pa.large_binary())
        x = np.concatenate([np.zeros((0, N_FEATURES)), *(describe(part, kept[0]) for _, part in small_arrays(texts, AT_ONCE))])
        return pa.array(model.scores(x))

    return score


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null text is the empty text, which gets a score too; very long texts are read whole. A null doc_id is not held out.
    Equal texts score alike; an empty table gives no rows. Of docs only doc_id and text are read, doc_id only for held_out.
    """
    toxic = scorer(train(docs, labels))
    rows = docs.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), toxic("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least the threshold; columns and texts as given.

    Null and empty texts are scored as the empty text, very long ones whole; repeated rows stay or go together, and an
    empty table stays empty.
    """
    return docs.where(scorer(train(docs, labels))("text") < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
