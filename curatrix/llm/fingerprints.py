"""Document fingerprints (9): prefix polynomial hashes.

A text's prefix array holds the polynomial hash of every prefix, modulo the
prime 2**31 - 1, under two fixed multipliers. The difference of two entries,
moved to a common power, is the hash of a span, so any two spans compare in
constant time and the longest common extension of two positions is found by
binary search. A fingerprint is the length and both hashes of the whole text,
then the ``SKETCH`` least values among its mixed span hashes of ``WIDTH``
characters. The likeness of two fingerprints is the Dice coefficient of their
texts' span sets, estimated from the sketches, and exact while a text has no
more different spans than the sketch holds.

Defined cases: a null text counts as empty. An empty text has no spans and is
like nothing but an empty text. A text shorter than ``WIDTH`` is one span.
Texts are read whole, whatever their length. Rows of equal id are ordered by
their text; a null id comes first. Where the table has one row, that row is its
own next one. Other columns are not read. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm.common import col
from curatrix.llm.text import codes, mix

#: The prime modulus and two multipliers below it.
PRIME = (1 << 31) - 1
MULTIPLIERS = (911_382_323, 1_972_663_511)

WIDTH = 12
SKETCH = 64

_P, _31 = np.uint64(PRIME), np.uint64(31)
_tables: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    table = _tables.get(base, np.ones(1, dtype=np.uint64))
    while len(table) < n:
        table = np.concatenate([table, _mod(table * np.uint64(pow(base, len(table), PRIME)))])
    _tables[base] = table
    return table[:n]


class Prefix:
    """Prefix arrays of a text, and what they answer."""

    def __init__(self, points: np.ndarray, before: "Prefix | None" = None, keep: int = 0):
        """Of ``points``, or of the first ``keep`` characters of another text and then ``points``, without going over those again."""
        self.n, self.keep, self.before = keep + len(points), keep, before
        self.sums = []
        for k, base in enumerate(MULTIPLIERS):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            if before is not None:
                sums[: keep + 1] = before.sums[k][: keep + 1]
            np.cumsum(_mod((points.astype(np.uint64) + np.uint64(1)) * _powers(base, self.n)[keep:]), out=sums[keep + 1 :])
            sums[keep + 1 :] += sums[keep]
            sums[keep + 1 :] = _mod(sums[keep + 1 :])
            self.sums.append(sums)
        self.values: np.ndarray | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hashes of characters start to end, as if the span stood first."""
        return tuple(
            (int(s[end]) - int(s[start])) * pow(base, -start, PRIME) % PRIME for s, base in zip(self.sums, MULTIPLIERS)
        )

    def equal(self, start: int, other: "Prefix", at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def extension(self, start: int, other: "Prefix", at: int) -> int:
        """How many characters agree from ``start`` here and ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, width: int, start: int = 0) -> np.ndarray:
        """The first hash of every span of ``width`` characters from ``start`` on."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        width, sums = min(width, self.n), self.sums[0]
        inverse = _powers(pow(MULTIPLIERS[0], -1, PRIME), self.n - width + 1)[start:]
        return _mod(_mod(sums[start + width :] + _P - sums[start : self.n - width + 1]) * inverse)

    def marks(self) -> np.ndarray:
        """32 bits for every span of ``WIDTH`` characters."""
        if self.values is None:
            known = max(0, self.keep - WIDTH + 1) if self.n >= WIDTH else 0
            own = (mix(self.spans(WIDTH, known)) >> np.uint64(32)).astype(np.uint32)
            self.values = np.concatenate([self.before.marks()[:known], own]) if known else own
        return self.values

    def fingerprint(self) -> str:
        values = self.marks()
        if len(values) > 16 * SKETCH:
            least = np.unique(np.partition(values, 4 * SKETCH)[: 4 * SKETCH])
            values = least if len(least) >= SKETCH else values
        sketch = np.unique(values)[:SKETCH].astype(">u4").tobytes().hex()
        whole = self.span(0, self.n)
        return f"{self.n:08x}{whole[0]:08x}{whole[1]:08x}:{sketch}"


def fingerprint(text: str | None) -> str:
    return Prefix(codes(text or "")).fingerprint()


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.partition(":")[2]), dtype=">u4").astype(np.uint32) for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    # Below the lesser of the two last values of full sketches, both are complete.
    bound = min([int(s[-1]) for s in (x, y) if len(s) == SKETCH], default=None)
    if bound is not None:
        x, y = x[x <= bound], y[y <= bound]
    return 2 * len(np.intersect1d(x, y, assume_unique=True)) / (len(x) + len(y))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"
_FIRST = -(1 << 63)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 8) -> DataFrame:
    """(bucket, tail, doc_id, text), ordered, in partitions that need no others.

    Ids are dealt into ranges by approximate quantiles. The first id of each
    range is repeated as the last row, marked ``tail``, of the range before it,
    so every row's successor is at hand. Texts are shuffled once; what reaches
    the driver is one id for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_FIRST))
    ids = rows.select(key.alias("k"))
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n)).alias("q")).first()["q"] if n > 1 else []
    splits = np.unique(np.array(cuts or [], dtype=np.int64))

    @arrow_udf("int")
    def bucket_of(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splits, k.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    heads = sorted((r["b"], r["k"]) for r in ids.groupBy(bucket_of("k").alias("b")).agg(F.min("k").alias("k")).collect())
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}

    @arrow_udf("array<struct<bucket:int,tail:boolean>>")
    def places(k: pa.Array) -> pa.Array:
        at = np.searchsorted(splits, values := k.to_numpy(zero_copy_only=False), side="right")
        out = [
            [{"bucket": b, "tail": False}] + ([{"bucket": before[v], "tail": True}] if v in before else [])
            for b, v in zip(at.tolist(), values.tolist())
        ]
        return pa.array(out, type=pa.list_(pa.struct([("bucket", pa.int32()), ("tail", pa.bool_())])))

    placed = rows.select("doc_id", "text", key.alias("k")).withColumn("p", F.explode(places("k")))
    return placed.select("p.bucket", "p.tail", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    ``shared_prefix`` is the longest common extension of both texts' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for batch in batches:
            out = []
            for bucket, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tail and held is None:
                    continue
                prefix = Prefix(codes(text))
                print_ = prefix.fingerprint()
                if held is not None and held[0] == bucket:
                    _, own, own_text, own_prefix, own_print = held
                    other_text = edited(own_text, text)
                    keep = own_prefix.n - own_prefix.n // 4
                    other = Prefix(codes(other_text[keep:]), own_prefix, keep)
                    other_print = other.fingerprint()
                    out.append((
                        own, own_prefix.n, hashlib.sha256(other_text.encode()).hexdigest(), own_print, other_print,
                        likeness(own_print, other_print), likeness(own_print, print_), own_prefix.extension(0, other, 0),
                    ))
                held = None if tail else (bucket, doc, text, prefix, print_)
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            names = [c.split()[0] for c in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(run, _OUT)
