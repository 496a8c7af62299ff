"""Benchmark decontamination (8): Wu-Manber multi-pattern search over words.

Texts are lower-cased in A-Z only and split into runs of letters, digits and
non-ASCII characters. Every window of ``window`` consecutive words of a
benchmark item is a pattern; an item with fewer words is one shorter pattern.
Patterns of one length share a block shift table, keyed by two words: where the
block under the search position ends no pattern, the search moves ahead by as
much as no pattern can need. Where a pattern's suffix block gives a shift of
nought, the patterns of the window's hash are selected and compared word by word.
All tables are sorted arrays over one array of the items' words.

Defined cases: a null or empty text has no words and no hits; an item without
words has no patterns. Repeated rows get the same result each. A text of any
length is searched whole. Equal item ids count once. Items without an id are
searched for like others; those found are together one null, the last of
``items``, as in the query's SQL, where it counts but is not in the hash. Columns other than those
read cannot clash. An empty benchmark finds nothing, an empty table gives no
rows.
"""

from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm.common import col

#: Bytes of benchmark text that one search's tables are built from; they take some
#: ten times as much, in the driver and in each worker. A larger benchmark is
#: searched in blocks of about this size, one after the other.
BLOCK_BYTES = 8 << 20

_FOUND = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"

_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_BYTES else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8").translate(_TABLE).split() if text else []


class _Length:
    """Shift table and patterns of one length, as sorted arrays over the items' words."""

    def __init__(self, m: int, words_: np.ndarray, starts: np.ndarray, item: np.ndarray):
        self.m, self.block, self.words = m, min(2, m), words_
        self.keys, self.shift = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for far in range(m - self.block + 1):  # the nearest end of a pattern counts
            key = np.setdiff1d(_blocks(words_, starts + m - far - 1, self.block), self.keys)
            both = np.concatenate([self.keys, key])
            order = np.argsort(both)
            self.keys, self.shift = both[order], np.concatenate([self.shift, np.full(len(key), far)])[order]
        # Which keys there may be, by a hash of few bits: most blocks of a text need no search.
        self.bits = np.uint64(64 - max(10, int(8 * len(self.keys)).bit_length()))
        self.known = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
        self.known[self._cell(self.keys)] = True
        hashes = _windows(words_, starts, m)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.item = hashes[order], starts[order], item[order]

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.shift, self.known, self.hashes, self.starts, self.item))

    def search(self, ids: np.ndarray, found: list[tuple[int, int]], items: set[int]) -> None:
        m, b, n = self.m, self.block, len(ids)
        if n < m:
            return
        key = _blocks(ids, slice(m - 1, n), b)
        steps = np.where(ids[m - 1 :] < 0, m, m - b + 1)  # no pattern has this word, or not this block
        maybe = np.flatnonzero(self.known[self._cell(key)])
        at = np.searchsorted(self.keys, key[maybe])
        at[at == len(self.keys)] = 0
        met = self.keys[at] == key[maybe]
        steps[maybe[met]] = self.shift[at[met]]
        if steps.all():
            return
        ends, steps, at, stop = [], steps.tolist(), 0, n - m + 1
        while at < stop:
            step = steps[at]
            if not step:
                ends.append(at)
                step = 1
            at += step
        starts = np.array(ends, dtype=np.int64)
        hashes = _windows(ids, starts, m)
        low, high = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
        for k in np.flatnonzero(high > low):
            start, hit = int(starts[k]), False
            for j in range(low[k], high[k]):
                if np.array_equal(self.words[self.starts[j] : self.starts[j] + m], ids[start : start + m]):
                    items.add(int(self.item[j]))
                    hit = True
            if hit:
                found.append((start, start + m))


def _blocks(ids: np.ndarray, last: np.ndarray | slice, block: int) -> np.ndarray:
    """The key of the one or two words that end at each place; negative where one of them is in no pattern."""
    own = ids[last].astype(np.int64)
    if block == 1:
        return own
    before = ids[slice(last.start - 1, last.stop - 1) if isinstance(last, slice) else last - 1].astype(np.int64)
    return before << 32 | own


def _windows(ids: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m words from each start."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(m):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


class Matcher:
    """All patterns of some benchmark items."""

    def __init__(self, benchmark: list[tuple[str, str | None]], window: int = 10):
        self.ids: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in benchmark}, key=lambda i: (i is None, i or ""))
        number = {item: k for k, item in enumerate(self.items)}
        flat, starts = array("i"), {}
        for item, text in benchmark:
            first = len(flat)
            flat.extend(self.ids.setdefault(w, len(self.ids)) for w in words(text))
            n = len(flat) - first
            m = min(window, n)
            if m:
                at, of = starts.setdefault(m, (array("q"), array("i")))
                at.extend(range(first, first + n - m + 1))
                of.extend([number[item]] * (n - m + 1))
        sequence = np.array(flat, dtype=np.int32)
        self.lengths = [_Length(m, sequence, np.array(at, dtype=np.int64), np.array(of, dtype=np.int32)) for m, (at, of) in sorted(starts.items())]

    def nbytes(self) -> int:
        """Bytes of the tables, without the words themselves."""
        return sum(x.nbytes() for x in self.lengths) + (self.lengths[0].words.nbytes if self.lengths else 0)

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged spans of hit words, items as sorted strings, a null last."""
        own = words(text)
        ids = np.fromiter(map(self.ids.get, own, repeat(-1)), np.int32, len(own))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for of in self.lengths:
            of.search(ids, found, items)
        return len(own), _merged(found), [self.items[k] for k in sorted(items)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def searcher(benchmark: list[tuple[str, str | None]], spark, window: int = 10):
    """A UDF from a text to its number of words, hit spans and items."""
    held = spark.sparkContext.broadcast(Matcher(benchmark, window))

    @arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = held.value
        kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for text in batch:
                n, spans, items = matcher.search(text.as_py())
                rows.append({"n_words": n, "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": items})
            yield pa.array(rows, type=kind)

    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: (doc_id, n_words, spans, items).

    ``spans`` are the merged word ranges [start, end) inside occurrences;
    ``items`` the ids of the items found, as sorted strings.
    """
    spark = docs.sparkSession
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(item_text_col).cast("string").alias("text"))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        search = searcher([(r["item"], r["text"]) for r in part.collect()], spark, window)
        if blocks == 1:
            return _shaped(rows.select("doc_id", search("text").alias("f")))
        key = [F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")]
        one = rows.select(*key, search("text").alias("f"))
        out = one if out is None else out.unionByName(one)
    # A benchmark of several blocks: what the blocks found of a document is joined;
    # rows that repeat an id and a text have one result and get it each.
    gathered = out.groupBy("doc_id", "digest").agg(
        F.first("f.n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items"),
        F.flatten(F.collect_list(F.arrays_zip(F.col("f.starts").alias("start"), F.col("f.ends").alias("end")))).alias("spans"),
    )
    merged = _merge_udf()("spans.start", "spans.end")
    gathered = gathered.select(
        F.col("doc_id").alias("d"), F.col("digest").alias("g"),
        F.struct("n_words", merged["starts"].alias("starts"), merged["ends"].alias("ends"), F.array_sort("items").alias("items")).alias("f"),
    )
    base = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return _shaped(base.join(gathered, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("doc_id", "f"))


def _merge_udf():
    @arrow_udf("struct<starts:array<bigint>,ends:array<bigint>>")
    def merge(starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for s, e in zip(starts.to_pylist(), ends.to_pylist()):
            spans = _merged(list(zip(s, e)))
            rows.append({"starts": [x for x, _ in spans], "ends": [x for _, x in spans]})
        return pa.array(rows, type=pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    return merge


def _shaped(df: DataFrame) -> DataFrame:
    spans = F.arrays_zip(F.col("f.starts").alias("start"), F.col("f.ends").alias("end"))
    return df.select("doc_id", F.col("f.n_words").alias("n_words"), spans.alias("spans"), F.col("f.items").alias("items"))


def n_hit(spans: Column) -> Column:
    """How many words the merged spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without an occurrence, with all their columns."""
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        search = searcher([(r["item"], r["text"]) for r in part.collect()], docs.sparkSession, window)
        docs = docs.where(F.size(search(col(text_col).cast("string"))["starts"]) == 0)
    return docs
