"""Quality classifier (7): ordinal cumulative-link regression on graded ratings.

A text's score is the mean weight of its hashed character trigrams, case kept,
plus that of its hashed words, plus that of hashed marks of its words: new, seen
before, or the same as the word before. All grades share these weights; they
differ in ordered thresholds, so P(grade <= g) is the logistic function of
threshold g less the score. Training is joint, in numpy, over a bounded sample
of rated rows: ``SAMPLE`` at most, drawn by the least hash of their id. Every
text is scored whole, with its expected grade and the probability of a grade of
at least ``least``, by which texts are selected.

Defined cases: a null text counts as empty, and an empty text scores nought
before the thresholds. With no rated rows the expected grade and the tail
probability are null and nothing is selected; with one grade only, every text
has it. Repeated rows get equal results; of rows that repeat an id with different
texts the least text is learnt from, and of ratings the least. A null id is never learnt from and is
held out. Other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm.common import col, held_out
from curatrix.llm.text import PIECE, codes, mix, words

BUCKETS = 1 << 18
SAMPLE = 6_000
SCALE = 30.0


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character trigrams, of the words and of their marks."""
    points = codes(text or "")
    mask = np.uint64(BUCKETS - 1)
    trigrams = np.empty(max(len(points) - 2, 0), dtype=np.int32)
    for at in range(0, len(trigrams), PIECE):  # in pieces, as each needs eight times its own size
        wide = points[at : at + PIECE + 2].astype(np.uint64)
        trigrams[at : at + PIECE] = mix(wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:], 1) & mask
    _, _, hashes = words(points)
    marks = np.ones(len(hashes), dtype=np.uint64)
    marks[np.unique(hashes, return_index=True)[1]] = 0
    marks[1:][hashes[1:] == hashes[:-1]] = 2
    return trigrams, *((mix(x, k) & mask).astype(np.int32) for k, x in enumerate((hashes, marks), 2))


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        return SCALE * float(sum(self.weights[b].mean() for b in features(text) if len(b)))

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= g) for every grade but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -30, 30)))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        if not self.grades:
            return np.full(len(scores), np.nan)
        up = np.diff(np.array(self.grades, dtype=float))
        return self.grades[0] + ((1 - self.below(scores)) * up[None, :]).sum(axis=1)

    def tail(self, scores: np.ndarray, least: int) -> np.ndarray:
        """P(grade >= least)."""
        if not self.grades:
            return np.full(len(scores), np.nan)
        k = int(np.searchsorted(self.grades, least))
        if k == 0:
            return np.ones(len(scores))
        if k == len(self.grades):
            return np.zeros(len(scores))
        return 1 - self.below(scores)[:, k - 1]


def train(texts: list[str], ratings: np.ndarray, steps: int = 70, rate: float = 0.08) -> Model:
    """Weights and thresholds by Adam on the negative log likelihood, full batch."""
    grades = sorted(set(ratings.tolist()))
    if len(grades) < 2:
        return Model(grades, np.zeros(BUCKETS, dtype=np.float32), np.zeros(0))
    buckets, shares, sizes = [], [], []
    for text in texts:  # each different bucket of a text once, with its share of the text's score
        own = [np.unique(b, return_counts=True) for b in features(text)]
        buckets += [b for b, _ in own]
        shares += [(SCALE * c / max(c.sum(), 1)).astype(np.float32) for _, c in own]
        sizes.append(sum(len(b) for b, _ in own))
    owner, share = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), np.concatenate(shares)
    present, slot = np.unique(np.concatenate(buckets), return_inverse=True)
    slot = slot.astype(np.int32)
    del buckets, shares
    grade = np.searchsorted(grades, ratings)
    n, k = len(texts), len(grades) - 1
    cumulative = np.clip(np.cumsum(np.bincount(grade, minlength=k + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(cumulative / (1 - cumulative))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])  # first threshold, logs of the gaps
    weights = np.zeros(len(present))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, free)]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        thresholds = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(owner, weights[slot] * share, n)
        c = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -30, 30)))
        c = np.concatenate([np.zeros((n, 1)), c, np.ones((n, 1))], axis=1)
        high, low = c[rows, grade + 1], c[rows, grade]
        p = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        on_score = (slope_high - slope_low) / n
        on_threshold = np.bincount(grade, -slope_high, k + 1)[:k] / n + np.bincount(grade, slope_low, k + 1)[1:] / n
        on_free = np.concatenate([[on_threshold.sum()], np.cumsum(on_threshold[::-1])[::-1][1:] * gaps])
        on_weights = np.bincount(slot, on_score[owner] * share, len(present)) + 1e-6 * weights
        for j, (value, g) in enumerate(((weights, on_weights), (free, on_free))):
            m, v = moments[j]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    full = np.zeros(BUCKETS, dtype=np.float32)
    full[present] = weights
    return Model(grades, full, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on rated rows of the folds not held out, ``sample`` of them at most."""
    rated = labels.select(col(id_col).cast("long").alias("doc_id"), col(rating_col).cast("int").alias("rating")).where("rating IS NOT NULL")
    rated = rated.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("rating").alias("rating"))
    rating_of = {r["doc_id"]: r["rating"] for r in rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    nothing = Model([], np.zeros(BUCKETS, dtype=np.float32), np.zeros(0))
    if not rating_of:
        return nothing
    held = docs.sparkSession.sparkContext.broadcast(np.array(sorted(rating_of), dtype=np.int64))

    @arrow_udf("boolean")
    def wanted(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.clip(np.searchsorted(held.value, values), 0, len(held.value) - 1)
        return pa.array((held.value[at] == values) & ids.is_valid().to_numpy(zero_copy_only=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        model = train([t for _, t in rows], np.array([rating_of[d] for d, _ in rows], dtype=int))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.grades], pa.list_(pa.int32())), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))],
            names=["grades", "weights", "thresholds"],
        )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).where(wanted("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).repartition(1)
    got = rows.mapInArrow(run, "grades array<int>, weights binary, thresholds array<double>").first()
    if got is None:
        return nothing
    return Model(list(got["grades"]), np.frombuffer(got["weights"], dtype=np.float32), np.array(got["thresholds"]))


def grade(docs: DataFrame, model: Model, least: int = 1, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, expected_grade, tail_probability, selected)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<expected:double,tail:double>")
    def graded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in batches:
            scores = np.array([m.score(t.as_py()) for t in batch])
            yield pa.StructArray.from_arrays(
                [pa.array(m.expected(scores), pa.float64(), from_pandas=True), pa.array(m.tail(scores, least), pa.float64(), from_pandas=True)],
                names=["expected", "tail"],
            )

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", graded("text").alias("g")).select(
        "doc_id", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail_probability"),
        F.coalesce(F.col("g.tail") >= cut, F.lit(False)).alias("selected"),
    )
