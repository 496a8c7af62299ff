"""Toxicity (5): subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, hashed into ``BUCKETS`` vectors, so
a misspelling shares most of its vectors with the word it stands for. The words
are averaged and a linear softmax over two labels scores the average. It is taken
over every window of ``WINDOW`` consecutive words, and a text is as toxic as its
most toxic window: a few words in a long text then count as much as in a short
one, which the average of the whole text does not give (on sf0.1's held-out rows it
finds 0.60 of the toxic texts where the windows find 0.77). Vectors and softmax are
trained jointly in numpy: first on the average of a whole text, which finds the
words that matter, then through each text's highest window.

The model learns from a bounded sample of labelled rows, ``SAMPLE`` of each
label at most, drawn by the least hash of their id. The final curve takes the
labels' shares from all labelled rows of the training folds. Scores cover every
text whole, a piece of bounded size at a time.

Defined cases: a null text counts as empty; a text without words has the score
of the bias alone. With no labelled rows, or one label only, every score is that
label's share, 0 if there are none. Repeated rows get equal scores; of rows that
repeat an id with different texts the least text is learnt from. A null id is
never learnt from and is held out. Other columns are not read.
"""

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm.common import col, held_out
from curatrix.llm.text import codes, mix, words

BUCKETS = 1 << 18
DIMENSIONS = 8
SIZES = (3, 4, 5)
WINDOW = 4
SAMPLE = 3_000
#: Characters that are looked at together; a longer text goes in pieces.
_CHUNK = 1 << 18
#: Different words whose n-grams are looked at together in training.
_WORDS = 1 << 15


def _bags(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of the marked words: its bucket, and its word's number."""
    length = ends - starts + 2  # with a mark on either side
    total = int(length.sum())
    first = np.cumsum(length) - length
    word = np.repeat(np.arange(len(starts), dtype=np.int32), length)
    at = np.arange(total) - first[word]
    left = length[word] - at  # characters from here to the word's end
    source = np.clip(starts[word] + at - 1, 0, max(len(points) - 1, 0))
    chars = np.where(at == 0, 1, np.where(left == 1, 2, points[source])).astype(np.uint64)
    buckets, owners = [], []
    h = np.zeros(total, dtype=np.uint64)
    for j in range(min(max(SIZES), total)):
        n = total - j
        h = h[:n] * np.uint64(0x100000001B3) + chars[j:] + np.uint64(1)
        if j + 1 in SIZES:
            whole = left[:n] >= j + 1
            buckets.append(((mix(h[whole], j) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(word[:n][whole])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _before(text: str, end: int, start: int) -> int:
    """Where the ``WINDOW`` - 1 words before ``end`` begin, so that no window is cut; ``end`` if that is not after the start."""
    at = end
    for _ in range(WINDOW - 1):
        while at > start and not text[at - 1].isalnum():
            at -= 1
        while at > start and text[at - 1].isalnum():
            at -= 1
    return at if at > start else end


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], str]]:
    """The lowered texts joined up to ``_CHUNK`` characters; each line's text. Long texts are cut between words."""
    numbers, lines, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text.lower(), 0
        while at < len(text) or not at:
            end = at + _CHUNK
            if end < len(text):
                cut = end
                while cut > at and text[cut].isalnum():
                    cut -= 1
                end = cut if cut > at else end
            numbers.append(i)
            lines.append(text[at:end].replace("\n", " "))
            size += len(lines[-1])
            at = max(_before(text, end, at) if end < len(text) else end, 1)
            if size >= _CHUNK:
                yield numbers, "\n".join(lines)
                numbers, lines, size = [], [], 0
    if lines:
        yield numbers, "\n".join(lines)


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each piece: text and number of every word; code points; start, end and hash of each number."""
    for numbers, joined in _pieces(texts):
        points = codes(joined)
        starts, ends, hashes = words(points)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        line = np.cumsum(points == 10)
        text = np.array(numbers)[line[starts]] if len(starts) else np.zeros(0, dtype=np.int64)
        yield text, number, points, starts[first], ends[first], hashes[first]


def _windows(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean of the window that ends at each word, its number of words, and the words that end a window.

    Each word ends a window, unless its text has ``WINDOW`` words and fewer come before it.
    """
    n = len(values)
    if not n:
        return np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.arange(n)
    edge = np.concatenate([[True], text[1:] != text[:-1]])
    first = np.maximum.accumulate(np.where(edge, at, 0))
    final = np.concatenate([edge[1:], [True]])
    last = np.flatnonzero((at - first >= WINDOW - 1) | final)
    size = np.minimum(at - first + 1, WINDOW)[last]
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[last + 1] - sums[last + 1 - size]) / size, size, last


@dataclass
class Model:
    """What scoring needs: each bucket's share of the logit and the bias, or a constant."""

    weights: np.ndarray
    bias: float
    constant: float | None = None

    def tops(self, texts: list[str]) -> np.ndarray:
        """The logit of each text's highest window, before the bias."""
        out = np.full(len(texts), -np.inf)
        for text, number, points, starts, ends, _ in _counted(texts):
            buckets, owners = _bags(points, starts, ends)
            grams = np.maximum(np.bincount(owners, minlength=len(starts)), 1)
            word = np.bincount(owners, self.weights[buckets], len(starts)) / grams
            mean, _, last = _windows(word[number], text)
            np.maximum.at(out, text[last], mean)
        out[np.isinf(out)] = 0.0
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.tops(texts) + self.bias, -30, 30)))


def _learnt(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Text and number of every word in order; the buckets of each word's n-grams, word by word, and how many it has."""
    keys, ids = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    of_text, numbers, grams, sizes = (array("i") for _ in range(4))  # they grow in place
    for text, number, points, starts, ends, hashes in _counted(texts):
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        new = keys[at] != hashes if len(keys) else np.ones(len(hashes), dtype=bool)
        buckets, owners = _bags(points, starts[new], ends[new])
        grams.frombytes(buckets[np.argsort(owners, kind="stable")].tobytes())
        fresh = np.arange(len(sizes), len(sizes) + int(new.sum()), dtype=np.int32)
        sizes.frombytes(np.bincount(owners, minlength=len(fresh)).astype(np.int32).tobytes())
        order = np.argsort(np.concatenate([keys, hashes[new]]))
        keys, ids = np.concatenate([keys, hashes[new]])[order], np.concatenate([ids, fresh])[order]
        of_text.frombytes(text.astype(np.int32).tobytes())
        numbers.frombytes(ids[np.searchsorted(keys, hashes)][number].tobytes())
    return tuple(np.frombuffer(x, dtype=np.int32) for x in (of_text, numbers, grams, sizes))


def train(
    texts: list[str], labels: np.ndarray, share: float | None = None, epochs: tuple[int, int] = (12, 16), rate: float = 0.05, decay: float = 0.05,
    least: float = 0.004, scale: float = 60.0, batch: int = 256, seed: int = 7,
) -> Model:
    """Joint training of vectors and softmax with Adam.

    A fifth of the texts is kept out, to fit the slope and bias of the final
    logistic curve on; ``share`` is label 1's among the rows that the texts were
    drawn from.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, float(labels.mean()) if len(labels) else 0.0)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(texts))
    held, kept = (order[: len(texts) // 5], order[len(texts) // 5 :]) if len(texts) >= 50 else (order, order)
    if labels[kept].min() == labels[kept].max():
        held = kept = order
    y, n_texts = labels[kept], len(kept)
    text, number, buckets, sizes = _learnt([texts[t] for t in kept])
    n_words = len(sizes)
    grams = np.maximum(sizes, 1).astype(np.float32)
    ends = np.cumsum(sizes, dtype=np.int64)
    # n-grams that too few texts have would only learn those texts' labels by heart
    texts_of = np.bincount(np.unique(text.astype(np.int64) << 32 | number) & 0xFFFFFFFF, minlength=n_words)
    lots = [(w, min(w + _WORDS, n_words)) for w in range(0, n_words, _WORDS)]
    span = lambda lot: slice(int(ends[lot[0]] - sizes[lot[0]]), int(ends[lot[1] - 1]))
    spread = np.zeros(BUCKETS)
    for lot in lots:
        spread += np.bincount(buckets[span(lot)], np.repeat(texts_of[slice(*lot)], sizes[slice(*lot)]), BUCKETS)
    frequent = spread >= max(3, least * n_texts)
    present, rank = np.flatnonzero(frequent), (np.cumsum(frequent) - 1).astype(np.int32)
    common = frequent[buckets]
    size_of = np.zeros(n_words, dtype=np.int64)
    for lot in lots:
        owner = np.repeat(np.arange(lot[1] - lot[0]), sizes[slice(*lot)])
        size_of[slice(*lot)] = np.bincount(owner[common[span(lot)]], minlength=lot[1] - lot[0])
    slot = rank[buckets[common]]
    first_of = np.cumsum(size_of) - size_of
    del buckets, sizes, common, spread, rank, ends, texts_of
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    del text
    place = np.zeros(n_words, dtype=np.int64)
    vectors = draw.normal(0, 0.1, (len(present), DIMENSIONS))
    softmax = draw.normal(0, 1.0, (2, DIMENSIONS))
    bias = np.array([np.log(y.mean() / (1 - y.mean()))])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    step = 0
    for epoch in range(sum(epochs)):
        mixed = draw.permutation(n_texts)
        for chosen in np.array_split(mixed, max(1, n_texts // batch)):
            n = len(chosen)
            used = np.concatenate([number[bounds[t] : bounds[t + 1]] for t in chosen])
            place[:] = 0
            place[used] = 1
            own = np.flatnonzero(place)  # the batch's different words, and their n-grams
            place[own] = np.arange(len(own))
            used = place[used]
            grams_of = size_of[own]
            word_of = np.repeat(np.arange(len(own)), grams_of)
            own_slot = slot[np.repeat(first_of[own] - (np.cumsum(grams_of) - grams_of), grams_of) + np.arange(grams_of.sum())]
            sizes = bounds[chosen + 1] - bounds[chosen]
            of = np.repeat(np.arange(n), sizes)
            direction = softmax[1] - softmax[0]
            word = np.bincount(word_of, (vectors @ direction)[own_slot], len(own)) / grams[own]
            if epoch < epochs[0]:
                share_of = (scale / np.maximum(sizes, 1))[of]
                top = np.bincount(of, word[used] * share_of, n)
            else:  # the words of the first highest window, and no others
                mean, size, last = _windows(word[used], of)
                ranked = np.lexsort((-mean, of[last]))
                head = ranked[np.unique(of[last][ranked], return_index=True)[1]]
                top = np.zeros(n)
                top[of[last[head]]] = mean[head]
                span = np.repeat(last[head] - size[head] + 1, size[head]) + np.arange(size[head].sum()) - np.repeat(np.cumsum(size[head]) - size[head], size[head])
                share_of, of, used = np.repeat(1 / size[head], size[head]), of[span], used[span]
            error = (1 / (1 + np.exp(-np.clip(top + bias[0], -30, 30))) - y[chosen]) / n
            per_word = np.bincount(used, error[of] * share_of, len(own)) / grams[own]
            on_gram = np.bincount(own_slot, per_word[word_of], len(present))
            g_direction = on_gram @ vectors
            step += 1
            gradients = [np.outer(on_gram, direction), np.stack([-g_direction, g_direction]), np.array([error.sum()])]
            for k, (value, g) in enumerate(zip((vectors, softmax, bias), gradients)):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                if k < 2:
                    value *= 1 - rate * decay
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[present] = vectors @ (softmax[1] - softmax[0])
    slope, shift = _curve(Model(weights, 0.0).tops([texts[t] for t in held]), labels[held], share)
    return Model(weights * np.float32(slope), shift)


def _curve(x: np.ndarray, y: np.ndarray, share: float | None = None) -> tuple[float, float]:
    """Slope and bias of the logistic curve through (x, y), by damped Newton steps.

    ``share`` weighs the labels as they stand where x was drawn from.
    """
    center, spread = x.mean(), x.std() + 1e-6
    own = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    share = own if share is None else np.clip(share, 1e-3, 1 - 1e-3)
    each = np.where(y == 1, share / own, (1 - share) / (1 - own))
    z, y = (x - center) / spread, np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = each * p * (1 - p) + 1e-6
        g = np.array([(each * (y - p) * z).sum() - 0.01 * a, (each * (y - p)).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + d[0], 1e-3), b + d[1]
    return float(a / spread), float(b - a * center / spread)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on labelled rows of the folds not held out, ``sample`` of each label at most."""
    marked = labels.select(col(id_col).alias("doc_id"), col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id")))
    shares = marked.agg(F.avg("label").alias("share")).first()["share"]
    drawn = None
    for label in (0, 1):
        own = marked.where(F.col("label") == label).groupBy("doc_id").agg(F.max("label").alias("label"))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = own if drawn is None else drawn.unionByName(own)
    chosen = drawn.collect()  # bounded by the sample
    if not chosen:
        return train([], np.zeros(0))
    label_of: dict[int, int] = {}
    for r in chosen:  # a document with both labels is toxic
        label_of[r["doc_id"]] = max(r["label"], label_of.get(r["doc_id"], 0))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(np.array(sorted(label_of), dtype=np.int64))

    @arrow_udf("boolean")
    def wanted(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.clip(np.searchsorted(held.value, values), 0, len(held.value) - 1)
        return pa.array((held.value[at] == values) & ids.is_valid().to_numpy(zero_copy_only=False))

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).where(wanted("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = rows.repartition(1).mapInArrow(_trainer(label_of, shares), "weights binary, bias double, constant double").first()
    if texts is None:
        return train([], np.zeros(0))
    return Model(np.frombuffer(texts["weights"], dtype=np.float32), texts["bias"], texts["constant"])


def _trainer(label_of: dict[int, int], share: float | None):
    """Training in one task of the executors, over the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        model = train([t for _, t in rows], np.array([label_of[d] for d, _ in rows], dtype=float), share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.constant], pa.float64())],
            names=["weights", "bias", "constant"],
        )

    return run


def scorer(model: Model, spark):
    """A UDF from a text to its toxicity."""
    held = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in batches:
            out, chunk, size = [], [], 0
            for text in batch:
                chunk.append(text.as_py() or "")
                size += len(chunk[-1])
                if size > _CHUNK:
                    out.append(m.score(chunk))
                    chunk, size = [], 0
            if chunk:
                out.append(m.score(chunk))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), type=pa.float64())

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, score)."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", scorer(model, docs.sparkSession)("text").alias("score"))


def clean(docs: DataFrame, model: Model, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the cut, with all their columns."""
    return docs.where(scorer(model, docs.sparkSession)(col(text_col).cast("string")) < cut)
