"""Toxic passages by maximum-scoring segment search.

Training. Features are words and word beginnings of some lengths. Their counts in toxic and clean
training documents, with Dirichlet priors in proportion to the counts overall, give log-odds
(Monroe, Colaresi and Quinn 2008) and a standard error. A feature scores its log-odds less
Z_LEAST errors, or zero where that leaves under ODDS_LEAST. A word scores the largest of its features' scores, less a
small drift, so that random text scores below zero on average.

Search. One linear scan finds every maximal-scoring segment (Ruzzo and Tompa 1999): disjoint
passages of words with the highest total scores.

Calibration. The best segment of a clean text of n words follows an extreme-value law,
P(S >= x) = 1 - exp(-K n e^(-lambda x)) (Karlin and Altschul 1990). lambda solves
sum p(s) e^(lambda s) = 1 over clean words' scores, K follows from the clean training texts'
best segments. A document's segments are aggregated by their bits, lambda S - ln(K n), and the
sum of the significant ones goes through a logistic curve fitted on the training documents.

Training takes labelled documents whose crc32(id as text) mod 5 is not 0, of these the SAMPLE
with the smallest hashes of their ids. They are written once and read three times: executors count
features (one shuffle by feature), then word scores and best segments, then evidence. The driver gets
scores of significant features, at most MOST_FEATURES, and some numbers for each sampled document.
Scoring reads the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: Labelled documents that training reads at most.
SAMPLE = 8_000
#: Features that a model scores at most, the most telling ones; it bounds what is broadcast.
MOST_FEATURES = 200_000
#: Prior counts of a feature: so many, and this share of its count overall.
PRIOR_LEAST, PRIOR_SHARE = 0.5, 0.01
#: Standard errors taken off; the least log-odds left; what each word loses; the largest score.
Z_LEAST, ODDS_LEAST, DRIFT, MOST_SCORE = 3.0, 1.4, 0.02, 8.0
SIGNIFICANT = 1.0  # bits, in nats: segments above this count


def features(word: str) -> list[str]:
    """A word as itself and as its beginnings, marked with a bar."""
    return [word, *(f"{word[:k]}|" for k in BEGINNINGS if len(word) >= k)]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a list of scores, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, total before, total at the end
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            begin, left = i, total
            total += s
            end, right = i + 1, total
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= left:
                    j -= 1
                if j < 0 or found[j][3] >= right:
                    found.append((begin, end, left, right))
                    break
                begin, left = found[j][0], found[j][2]
                del found[j:]
        else:
            total += s
    return [(a, b, r - le) for a, b, le, r in found]


@dataclass
class Model:
    """scores: by feature; lambda_, k: of the extreme-value law; slope, offset: of the logistic curve."""

    scores: dict[str, float]
    lambda_: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = -1.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = [s for f in features(word) if (s := self.scores.get(f))]
            best = max(found, default=0.0)
            got = self.known[word] = (best or min(found, default=0.0)) - DRIFT
        return got

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(words, maximal segments by word positions), runs without a positive word taken at once."""
        words = WORD.findall((text or "").lower())
        each = list(map(self.word_score, words))
        row = np.array(each, dtype=np.float64)
        hits = np.flatnonzero(row > 0)
        if not len(hits):
            return len(words), []
        totals = np.concatenate([[0.0], np.cumsum(row)])
        folded: list[float] = []
        at: list[int] = []
        last = -1
        for h in hits.tolist():
            if h > last + 1:
                folded.append(float(totals[h] - totals[last + 1]))
                at.append(last + 1)
            folded.append(each[h])
            at.append(h)
            last = h
        return len(words), [(at[a], at[b - 1] + 1, s) for a, b, s in segments(folded)]

    def bits(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        base = math.log(max(self.k * n, 1e-9))
        return [self.lambda_ * s - base for _, _, s in found]

    def evidence(self, text: str | None) -> float:
        n, found = self.passages(text)
        got = self.bits(n, found)
        return math.log1p(sum(b for b in got if b > SIGNIFICANT)) if got else 0.0

    def score(self, text: str | None) -> float:
        """Between 0 and 1; a text without words scores as one without evidence."""
        x = self.slope * self.evidence(text) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def feature_counts(rows: DataFrame) -> DataFrame:
    """(f, toxic, clean): how many of the rows (t, y) of each label hold each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 0):
                found: tuple[Counter, Counter] = Counter(), Counter()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[label].update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
                every = list(found[0] | found[1])
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([found[y][f] for f in every], pa.int64()) for y in (1, 0)]], names=["f", "toxic", "clean"])

    return rows.mapInArrow(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(f, s): scores of the features (f, toxic, clean) that differ significantly, from counts of documents."""
    n = F.col("toxic") + F.col("clean")
    prior = F.lit(PRIOR_LEAST) + F.lit(PRIOR_SHARE) * n
    rows = counts.where(n >= 3).select("f", prior.alias("p"), (F.col("toxic") + prior).alias("a"), (F.col("clean") + prior).alias("b"))
    rest = lambda total, x: F.greatest(F.lit(total) + 2 * F.col("p") - F.col(x), F.lit(0.5))
    rows = rows.withColumn("delta", F.ln("a") - F.ln(rest(n_toxic, "a")) - F.ln("b") + F.ln(rest(n_clean, "b")))
    rows = rows.withColumn("sure", F.abs("delta") - Z_LEAST * F.sqrt(1 / F.col("a") + 1 / F.col("b"))).where(F.col("sure") >= ODDS_LEAST)
    return rows.select("f", F.when(F.col("delta") > 0, F.least(F.col("sure"), F.lit(MOST_SCORE))).otherwise(F.greatest(-F.col("sure"), F.lit(-1.0))).alias("s"))


def solve_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum w e^(lambda v) = 1 for scores of negative mean; 1 if none exists."""
    if not len(values) or values.max() <= 0 or (values * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda x: float((weights * np.exp(np.minimum(x * values, 500))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset, both labels weighing alike, by damped Newton steps."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    scale = max(float(x.max(initial=0.0)), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)])
    at = np.zeros(2)
    loss = lambda c: float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (c @ z))).sum() + ridge / 2 * c @ c)
    now = loss(at)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -40, 40)))
        slope = z @ (weight * (p - y)) + ridge * at
        bend = (z * (weight * p * (1 - p))) @ z.T + ridge * np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > now:
            size /= 2
        at, before = at - size * step, now
        now = loss(at)
        if before - now < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def no_evidence(toxic: int = 0, clean: int = 0) -> Model:
    """The model that scores everything alike, and low."""
    rate = max(1e-3, min(0.4, toxic / max(1, toxic + clean)))
    return Model({}, offset=math.log(rate / (1 - rate)))


def calibrated(rows: DataFrame, model: Model) -> None:
    """Sets the extreme-value law and the logistic curve of a model with scores, from the rows (t, y) of both labels."""
    context = rows.sparkSession.sparkContext
    held = context.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, best = Counter(), Counter()
            for text in batch.column(0):
                words = WORD.findall((text.as_py() or "").lower())
                each.update(map(held.value.word_score, words))
                best[max((s for *_, s in held.value.passages(text.as_py())[1]), default=0.0), len(words)] += 1
            found = [(-1, s, n) for s, n in each.items()] + [(m, s, n) for (s, m), n in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["words", "x", "n"])

    # one row for each word score (words -1), and for each length and best segment of a text
    got = rows.where("y = 0").select("t").mapInArrow(measure, "words long, x double, n long").groupBy("words", "x").agg(F.sum("n").alias("n")).collect()
    values, weights = (np.array([r[k] for r in got if r.words < 0], dtype=np.float64) for k in ("x", "n"))
    model.lambda_ = solve_lambda(values, weights / max(1.0, weights.sum()))
    # P(no segment above x) = exp(-K n e^(-lambda x)): the K that makes the clean texts' best segments likeliest
    spread = sum(r["n"] * r.words * math.exp(-model.lambda_ * r.x) for r in got if r.words >= 0)
    model.k = max(1e-6, min(1.0, sum(r["n"] for r in got if r.words >= 0) / max(spread, 1e-9)))
    held = context.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([held.value.evidence(t.as_py()) for t in batch.column(0)], pa.float64())], names=["y", "x"])

    found = sorted(rows.select("t", "y").mapInArrow(weigh, "y int, x double").collect())
    model.slope, model.offset = logistic(np.array([r.x for r in found]), np.array([float(r.y) for r in found]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from the labelled documents outside the held-out fifth, at most sample of them.

    The sample is chosen by a hash of the id, so it is the same wherever it is computed. Null
    labels and ids are left out. Of several labels of an id the largest counts; rows of docs that
    share an id are read each. Null and empty texts have no features. Without documents of both
    labels, or features that tell them apart, all texts score alike and low.
    """
    chosen = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & (common.crc_of_id("k") % 5 != 0)).groupBy("k").agg(F.max("y").alias("y"))
    chosen = common.smallest_hashes(chosen, "k", sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select(F.col("t"), (F.col("y") != 0).cast("int").alias("y"))
    rows = common.written(rows, "toxicity-sample")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return no_evidence(n.get(1, 0), n.get(0, 0))
    best = log_odds(feature_counts(rows), n[1], n[0]).orderBy(F.desc(F.abs("s")), "f").limit(MOST_FEATURES)
    model = Model({r.f: r.s for r in best.collect()})
    if not model.scores:
        return no_evidence(n[1], n[0])
    calibrated(rows, model)
    return model


def scorer(docs: DataFrame, model: Model):
    """An Arrow UDF text -> score. The model has MOST_FEATURES numbers at most, so it is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for texts in batches:
            yield pa.array([m.score(t.as_py()) for t in texts], pa.float64())

    return score


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs; whole texts, no shuffle.

    Null and empty texts get the score of a text without evidence. Repeated rows score alike. A
    null id is not held out. Only key and text are read, so other columns cannot clash.
    """
    s = scorer(docs, model)
    rows = docs.select(F.col(key), F.coalesce(common.crc_of_id(key) % 5 == 0, F.lit(False)).alias("held_out"), s(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose whole text scores under 0.5.

    Null and empty texts score as one without evidence. Repeated rows stay or go alike. An empty table
    stays empty. Texts of any length are read whole, one at a time.
    """
    return docs.where(scorer(docs, model)(F.col(text)) < 0.5)
