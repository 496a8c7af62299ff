"""MinHash near-dedup (4): improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of ``WORDS`` words: term frequency
times ln(1 + n / f), where f is the exact number of the n different texts that
have the shingle. Every shingle of every text has its own f. The counts never
meet in one place: texts are hashed once, in lots; each lot sends its shingles by
ranges of their hashes; a range is counted by itself and tells each lot which of
its shingles more than one text has, and how many; all others have f = 1.
``ROWS`` times ``BANDS`` samples a text are drawn by improved consistent weighted
sampling, and texts that share a band are candidates.

What near copies share counts for less the more copies there are, as TF-IDF has
it: a large group holds together only where its texts differ in little weight.

Texts of equal words are one node from the start. A bucket does not emit its
pairs: its members are compared with few leaders, first one, then four, the nodes
that share most buckets with others, as the original of many copies does. Nodes
of one class are not compared again. What is left in buckets of several classes
is searched for block by block: every node outside its bucket's largest class is a
query against the members of its buckets, so no link of a bucket is lost.
Similarities are weighted Jaccard over 64-bit shingle hashes; classes are the
connected components of the links that hold.

Two texts of similarity 0.8 miss each other in all bands with probability
(1 - 0.8**ROWS)**BANDS; at 3 x 14 that is 4e-5.

Defined cases: a null text is a class of its own. Texts without words are equal
only if they are identical. Texts shorter than a shingle are one shingle.
Repeated rows are copies. Texts are read whole. A null id is allowed and counts
as the least of its class. Of rows that repeat an id and its words, the least
text stays, then the least of the other columns as JSON. Other columns are not
read by the operator, and the pipeline stage passes them on. An empty table gives
no rows.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm.common import col, fresh, materialize
from curatrix.llm.text import codes, mix, shingles, words

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 3, 14
#: Frequencies have no floor n / ``RARE``: no shingles are so rare that they weigh alike.
RARE = math.inf
#: Texts, fewer than 1 << ``_AT``, and about how many words make a lot.
_AT = 12
_TEXTS, _SHINGLES = 4000, 1 << 18
#: About how many shingles, once for each lot, are counted together.
_COUNTED = 1 << 21
#: How many leaders a bucket's members are compared with, round by round.
LEADERS = (1, 4)
#: Members of a bucket that are compared with its leaders in one task.
DEALT = 512
#: Bytes of shingle hashes in a block of queries.
BLOCK_BYTES = 8 << 20
#: Most ids or keys (of 8 bytes) that are broadcast; beyond it a shuffled join does.
LISTED = 1_000_000

#: Drops the shuffle files of a statement when it ends.
_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_U = np.uint64
_CHUNK = 1 << 15
NULL = bytes(16)


def _stored(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """``df`` materialized. Its shuffle files go at once, so that those of one step do not lie beside the next one's."""
    conf = df.sparkSession.conf
    before = conf.get(_DROPS, "false")
    conf.set(_DROPS, "true")
    try:
        return materialize(df, label, instead)
    finally:
        conf.set(_DROPS, before)


def _hashes(text: str) -> np.ndarray:
    return words(codes(text.lower()))[2]


def digest(text: str | None, hashes: np.ndarray) -> bytes:
    """The node of a text: its words, or the text itself where it has none."""
    if text is None:
        return NULL
    data = hashes.tobytes() if len(hashes) else b"text" + text.encode()
    return hashlib.blake2b(data, digest_size=16).digest()


def lots(texts: DataFrame) -> DataFrame:
    """(doc_id, node, lot, place, size, words) of every (doc_id, text), and before the rows of a lot one of its vocabulary.

    Rows of a lot are of one task and follow each other; a place is one row's.
    Words are places in the lot's vocabulary, which holds hashes and has no node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, size = TaskContext.get().partitionId() << 20, 0
        held: list[tuple[int | None, bytes, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            vocabulary, words = np.unique(np.concatenate([x for *_, x in held]), return_inverse=True)
            ends = np.cumsum([len(x) for *_, x in held])[:-1]
            first = lot << _AT
            out = [(None, None, lot, first, len(vocabulary), vocabulary.astype("<u8").tobytes())]
            for at, ((id_, node, x), own) in enumerate(zip(held, np.split(words, ends)), 1):
                out.append((id_, node, lot, first | at, len(x), _planes(own.astype("<u4"))))
            kinds = pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            names = ["doc_id", "node", "lot", "place", "size", "words"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                hashes = _hashes(text) if text else np.zeros(0, dtype=_U)
                if len(held) >= _TEXTS or size >= _SHINGLES:
                    yield closed()
                    held.clear()
                    lot, size = lot + 1, 0
                held.append((id_, digest(text, hashes), hashes))
                size += len(hashes)
        if held:
            yield closed()

    return texts.mapInArrow(run, "doc_id long, node binary, lot long, place long, size long, words binary")


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: small numbers so compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _planed(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _sets(rows: Iterator[tuple[bytes | None, bytes]], k: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The different shingles, in order, and how often each, of the (node, words) that follow their vocabulary's row."""
    vocabulary = np.zeros(0, dtype="<u8")
    for node, words_ in rows:
        if node is None:
            vocabulary = np.frombuffer(words_, dtype="<u8")
        else:
            yield node, *np.unique(shingles(vocabulary[_planed(words_, "<u4")], k), return_counts=True)


def _at(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``texts`` at ``places`` that have words, those of a lot one after the other, and the vocabularies.

    Places, as bits of spans of 64, are broadcast only where the spans are counted
    to be ``LISTED`` at most; beyond it the texts are shuffled.
    """
    texts = texts.where("size > 0")
    places = places.select("place").unionByName(texts.where("node IS NULL").select("place"))
    span, bit = F.shiftright("place", 6).alias("span"), "CAST(place & 63 AS INT)"
    spans = places.groupBy(span).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    if spans.count() <= LISTED:
        return texts.select("*", span).join(F.broadcast(spans), "span").where(f"getbit(bits, {bit}) = 1").select(texts.columns)
    return texts.join(places, "place", "left_semi").repartition("lot").sortWithinPartitions("place")


def _sent(k: int, parts: int):
    """(part, lot, h, n): a lot's different shingles in ranges of hashes, as differences, and how many of its texts have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=_U)

        def ranges(lot: int, rows: list[tuple[bytes | None, bytes]]) -> pa.RecordBatch:
            held = [h for _, h, _ in _sets(iter(rows), k)]
            h, n = np.unique(np.concatenate(held or [np.zeros(0, dtype=_U)]), return_counts=True)
            ends = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
            out = [
                (i, lot, _planes(np.diff(h[a:b], prepend=_U(0))), _planes(n[a:b].astype("<u4")))
                for i, (a, b) in enumerate(zip(ends, ends[1:])) if a < b
            ]
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary()
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "lot", "h", "n"])

        last, rows = None, []
        for batch in batches:
            for lot, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if lot != last and rows:
                    yield ranges(last, rows)
                    rows = []
                last = lot
                rows.append(row)
        if rows:
            yield ranges(last, rows)

    return run


def _count(rows: pa.Table) -> pa.Table:
    """(lot, h, f): of one range of hashes, for each lot its shingles that more than one text has."""
    own = [np.cumsum(_planed(x, "<u8")) for x in rows["h"].to_pylist()]
    h, n = np.concatenate(own), np.concatenate([_planed(x, "<u4") for x in rows["n"].to_pylist()])
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
    f = np.empty(len(h), dtype=np.int64)
    f[order] = np.repeat(np.add.reduceat(n[order], first, dtype=np.int64), np.diff(first, append=len(h)))
    ends = np.cumsum([0, *(len(x) for x in own)]).tolist()
    out = []
    for lot, x, a, b in zip(rows["lot"].to_pylist(), own, ends, ends[1:]):
        many = f[a:b] > 1
        if many.any():
            out.append((lot, x[many].tobytes(), f[a:b][many].astype("<i8").tobytes()))
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["lot", "h", "f"])


def counted(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(lot, h, f): for each lot, how many different texts have each of its shingles, for all of more than one text.

    Each node is counted once, where its place is. No task holds more than a range of hashes.
    """
    once = _at(texts, nodes)
    parts = -(-(texts.where("node IS NOT NULL").agg(F.sum("size")).first()[0] or 1) // _COUNTED)
    sent = once.select("lot", "node", "words").mapInArrow(_sent(k, parts), "part long, lot long, h binary, n binary")
    return _stored(sent.groupBy("part").applyInArrow(_count, "lot long, h binary, f binary"), "frequencies")


def placed(texts: DataFrame) -> DataFrame:
    """(node, rep, place, n): each different text, its least id, one row that has both, and the number of its rows."""
    real = texts.where(F.col("node") != F.lit(NULL))
    least = F.min(F.struct(_key(F.col("doc_id")).alias("rep"), "place")).alias("least")
    return _stored(real.groupBy("node").agg(least, F.count(F.lit(1)).alias("n")).select("node", "least.rep", "least.place", "n"), "nodes")


def frequencies(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All shingles in order, how many different texts have each, and the number of different texts.

    This brings the counts of ``counted`` to the driver, to look at those of a
    table that fits there; ``classify`` leaves them where they are.
    """
    rows = _stored(lots(texts.select(F.lit(None).cast("long").alias("doc_id"), "text")), "lots")
    nodes = placed(rows)
    own: dict[int, list[tuple[bytes | None, bytes]]] = {}
    for r in _at(rows, nodes).orderBy("place").collect():
        own.setdefault(r["lot"], []).append((r["node"], r["words"]))
    keys = np.unique(np.concatenate([np.zeros(0, dtype=_U), *(h for x in own.values() for _, h, _ in _sets(iter(x), k))]))
    counts = np.ones(len(keys), dtype=np.int64)
    for r in counted(rows, nodes, k).collect():
        counts[np.searchsorted(keys, np.frombuffer(r["h"], dtype="<u8"))] = np.frombuffer(r["f"], dtype="<i8")
    return keys, counts, nodes.count()


class Weigher:
    """The weights of a lot's shingles: ``counts`` texts have each of ``keys``, one text each other."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int):
        self.keys, first = np.unique(keys, return_index=True)
        self.idf = np.log1p(n / counts[first]).astype(np.float32)
        self.alone = np.float32(np.log1p(n))

    def weigh(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf.astype(np.float32) * self.idf_of(h)

    def idf_of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.alone, dtype=np.float32)
        if len(self.keys):
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            told = self.keys[at] == h
            out[told] = self.idf[at[told]]
        return out


def _weighed(rows: DataFrame, told: DataFrame, n: int, k: int, use, schema: str) -> DataFrame:
    """What ``use`` makes of each lot's (node, hashes, weights)."""

    def run(own: pa.Table, common: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(common["h"].to_pylist()), dtype="<u8")
        weigher = Weigher(keys, np.frombuffer(b"".join(common["f"].to_pylist()), dtype="<i8"), n)
        own = own.sort_by("place")  # the vocabulary first
        return use((x, h, weigher.weigh(h, tf)) for x, h, tf in _sets(zip(own["node"].to_pylist(), own["words"].to_pylist()), k))

    return rows.select("lot", "place", "node", "words").groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(run, schema)


def sample(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, draws: int) -> np.ndarray:
    """Consistent weighted samples, one row for each set; bounds are the sets' starts and the end.

    For each draw and shingle, r and c are Gamma(2, 1) and beta is uniform, all
    from the shingle's hash. t = floor(ln w / r + beta), ln y = r (t - beta) and
    ln a = ln c - ln y - r; the shingle of the least a, with its t, is the sample.
    """
    starts, sizes = bounds[:-1], np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    log_weight = np.log(weight)
    out = np.zeros((len(sizes), draws), dtype=_U)
    bits, unit = _U(0xFFFFFF), np.float32(2.0**-24)
    for k in range(draws):
        m, l = mix(h, 2 * k + 11), mix(h, 2 * k + 12)
        r = -np.log(((m & bits).astype(np.float32) + np.float32(0.5)) * unit * ((m >> _U(40)).astype(np.float32) + np.float32(0.5)) * unit)
        c = -np.log(((l & bits).astype(np.float32) + np.float32(0.5)) * unit * ((l >> _U(40)).astype(np.float32) + np.float32(0.5)) * unit)
        beta = ((m >> _U(24)) & _U(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_weight / r + beta)
        log_a = np.log(c) - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == least[owner])
        first = at[np.unique(owner[at], return_index=True)[1]]
        out[:, k] = mix(h[first] ^ (t[first].astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)), k)
    return out


def sign(texts: DataFrame, nodes: DataFrame, told: DataFrame, n: int, k: int, rows: int, bands: int) -> DataFrame:
    """(node, sig) of the nodes that have words: a hash for each band."""

    def use(sets: Iterator[tuple[bytes, np.ndarray, np.ndarray]]) -> pa.Table:
        named: list[bytes] = []
        sig: list[np.ndarray] = []
        chunk: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            if not chunk:
                return
            bounds = np.cumsum([0, *(len(h) for h, _ in chunk)])
            drawn = sample(np.concatenate([h for h, _ in chunk]), np.concatenate([w for _, w in chunk]), bounds, rows * bands)
            keys = np.zeros((len(chunk), bands), dtype=_U)
            for j in range(rows):
                keys = mix(keys ^ drawn[:, j::rows], j)
            sig.extend(mix(keys + np.arange(bands, dtype=_U), 99).view(np.int64))
            chunk.clear()

        size = 0
        for node, h, w in sets:
            named.append(node)
            chunk.append((h, w))
            size += len(h)
            if size > _CHUNK:
                settle()
                size = 0
        settle()
        return pa.table([pa.array(named, pa.binary()), pa.array(sig, pa.list_(pa.int64()))], names=["node", "sig"])

    return _stored(_weighed(_at(texts, nodes), told, n, k, use, "node binary, sig array<long>"), "signed")


def vectors(texts: DataFrame, wanted: DataFrame, told: DataFrame, n: int, k: int) -> DataFrame:
    """(node, h, w) of the wanted nodes, one row each: sorted hashes and weights."""

    def use(sets: Iterator[tuple[bytes, np.ndarray, np.ndarray]]) -> pa.Table:
        columns = list(zip(*((x, h.tobytes(), w.astype("<f4").tobytes()) for x, h, w in sets))) or [(), (), ()]
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["node", "h", "w"])

    return _stored(_weighed(_at(texts, wanted), told, n, k, use, "node binary, h binary, w binary"), "vectors")


def _key(id_: Column) -> Column:
    """What rows are ordered and told apart by: a null id first."""
    return F.struct(id_.isNotNull().alias("known"), id_.alias("id"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with sorted keys."""
    (x, v), (y, w) = a, b
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = x[at] == y if len(x) else np.zeros(len(y), dtype=bool)
    shared = float(np.minimum(v[at[both]], w[both]).sum(dtype=np.float64))
    total = float(v.sum(dtype=np.float64) + w.sum(dtype=np.float64)) - shared
    return shared / total if total else 0.0


def _similar(h1: pa.Array, w1: pa.Array, h2: pa.Array, w2: pa.Array) -> pa.Array:
    def of(h, w):
        return np.frombuffer(h.as_py(), dtype="<u8"), np.frombuffer(w.as_py(), dtype="<f4")

    return pa.array([similarity(of(a, b), of(c, d)) for a, b, c, d in zip(h1, w1, h2, w2)], pa.float64())


def _verified(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """(a, b, s), a before b, for the distinct pairs (leader, node)."""
    own, lead = vecs.select("node", "h", "w").toDF("b", "h2", "w2"), vecs.select("node", "h", "w").toDF("a", "h1", "w1")
    once = pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    both = once.join(own, "b").join(lead, "a")
    return _stored(both.select("a", "b", arrow_udf(_similar, "double")("h1", "w1", "h2", "w2").alias("s")), "verified")


def _led(members: DataFrame, leaders: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (leader, node) of different classes so far, and the members without the leaders.

    A bucket's leaders are the members that share most buckets with others. The
    members of a large bucket are dealt over several tasks, with the leaders in each.
    """
    order = W.partitionBy("key").orderBy(F.desc("shared"), "node")
    heads = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders)
    heads = heads.select("key", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("node").alias("leader"), F.col("root").alias("its"))
    # A pair of two leaders is taken twice; pairs are made distinct before they are verified.
    met = members.join(heads, ["key", "slot"])
    pairs = met.where("root <> its").select("leader", "node")
    rest = members.join(heads.select("key", "slot", F.col("leader").alias("node")), ["key", "slot", "node"], "left_anti")
    return pairs, rest


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members``, with their roots, of the buckets whose members are of several classes."""
    labelled = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.first("slots").alias("n")).where("x <> y")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    return _stored(labelled.join(mixed, ["key", "slot"]), "members")


def _searched(members: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of the members outside their bucket's largest class with members of other classes.

    A pair of a bucket that no leader was part of has such a member, so nothing
    is left out. These members are the queries of a search, block by block: the
    shingles of a block's queries make an inverted index of bounded size, which
    the members of the queries' buckets are held against. Queries that share
    their first bucket are in one block. Each block's links are written out
    before the next index is sent.
    """
    spark = members.sparkSession
    of = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.first("slots").alias("slots"))
    largest = of.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.first("slots").alias("slots"))
    largest = largest.select("key", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("top.root").alias("main"))
    queries = members.join(largest, ["key", "slot"]).where("root <> main").groupBy("node").agg(F.min("key").alias("home"))
    nodes = members.groupBy("node").agg(F.first("root").alias("root"), F.collect_list("key").alias("keys"))  # a key for each band at most
    full = _stored(nodes.join(queries, "node", "left").join(vecs, "node"), "unsettled")
    size = full.where("home IS NOT NULL").agg(F.sum(F.octet_length("h"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = spark.createDataFrame([], "a binary, b binary")
    for block in range(blocks):
        asked = full.where(F.pmod(F.xxhash64("home"), F.lit(blocks)) == block)
        keys = asked.select(F.explode("keys").alias("key")).distinct()  # of a bounded block
        near = members.join(F.broadcast(keys), "key", "left_semi").select("node").distinct()
        index = spark.sparkContext.broadcast(_index(asked.select("node", "root", "keys", "h", "w").toArrow()))
        met = (full.join(near, "node", "left_semi") if blocks > 1 else full).select("node", "root", "keys", "h", "w")
        found = found.unionByName(_stored(met.mapInArrow(_scan(index, threshold), "a binary, b binary"), "found"))
        index.unpersist()
    return found


def _index(rows: pa.Table) -> dict:
    """An inverted index of the block's weighted shingles."""
    hashes = [np.frombuffer(x, dtype="<u8") for x in rows["h"].to_pylist()]
    weights = [np.frombuffer(x, dtype="<f4") for x in rows["w"].to_pylist()]
    if not hashes:
        return {"nodes": []}
    h, w = np.concatenate(hashes), np.concatenate(weights)
    of = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    return {
        "nodes": rows["node"].to_pylist(), "roots": rows["root"].to_pylist(), "buckets": [frozenset(k) for k in rows["keys"].to_pylist()],
        "total": np.array([x.sum(dtype=np.float64) for x in weights]), "keys": keys, "first": np.append(first, len(h)), "of": of[order], "w": w[order],
    }


def _scan(index, threshold: float):
    """What a member has in common with all queries of the block at once, and so the queries that it is similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            a, b = [], []
            for node, root, buckets, h, w in zip(*(c.to_pylist() for c in batch.columns)) if x["nodes"] else ():
                h, w = np.frombuffer(h, dtype="<u8"), np.frombuffer(w, dtype="<f4")
                at = np.searchsorted(x["keys"], h)
                at[at == len(x["keys"])] = 0
                met = x["keys"][at] == h
                at, own = at[met], w[met]
                n = x["first"][at + 1] - x["first"][at]
                if not n.sum():
                    continue
                place = np.repeat(x["first"][at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(x["of"][place], np.minimum(x["w"][place], np.repeat(own, n)), len(x["nodes"]))
                near = np.flatnonzero(shared >= threshold * (x["total"] + w.sum(dtype=np.float64) - shared))
                seen = {root}  # a link for each class is enough
                for i in near.tolist():
                    if x["roots"][i] not in seen and not x["buckets"][i].isdisjoint(buckets):
                        seen.add(x["roots"][i])
                        a.append(x["nodes"][i])
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _sized(bucketed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, node, n): the members of the buckets in ``sizes``.

    The rows of large buckets are not shuffled by their key: large ones are few,
    and sent to all tasks where they are counted to be ``LISTED`` at most.
    """
    large = sizes.where(F.col("n") > DEALT)
    if large.count() > LISTED:
        return bucketed.join(sizes, "key").select("key", "node", "n")
    small = bucketed.join(F.broadcast(large.select("key")), "key", "left_anti").join(sizes.where(F.col("n") <= DEALT), "key")
    return small.select("key", "node", "n").unionByName(bucketed.join(F.broadcast(large), "key").select("key", "node", "n"))


def classes(nodes: DataFrame, signed: DataFrame, texts: DataFrame, told: DataFrame, n: int, k: int, threshold: float) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    bucketed = signed.select("node", F.explode("sig").alias("key"))
    sizes = _stored(bucketed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    keyed = _stored(_sized(bucketed, sizes), "buckets")
    shared = keyed.groupBy("node").agg(F.sum("n").alias("shared"))
    wanted = _stored(shared.join(nodes.select("node", "place"), "node"), "involved")
    vecs = vectors(texts, wanted, told, n, k)
    slots = F.ceil(F.col("n") / DEALT).cast("int")
    members = keyed.select("key", "node", slots.alias("slots")).join(wanted.select("node", "shared"), "node")
    members = members.withColumns({"slot": F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"), "root": F.col("node")})
    members = _stored(members, "members")
    links = roots = None
    for leaders in LEADERS:
        pairs, rest = _led(members, leaders)
        near = _verified(pairs, vecs).where(F.col("s") >= threshold).select("a", "b")
        links = near if links is None else links.unionByName(near)
        roots = components(links)
        members = _unsettled(rest, roots)
    if not members.limit(1).count():
        return roots
    return components(links.unionByName(_searched(members, vecs, threshold)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes with an edge.

    Every node takes the least label around it, then its label's label, until
    nothing changes; each round is written to the shared folder.
    """
    both = _stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    step = _stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    labels, written = step, step
    while True:
        around = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(around, labels["node"] == around["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = labels.toDF("at", "further")
        step = step.join(jump, step["root"] == jump["at"]).select("node", F.least("root", "further").alias("root"), "was")
        step = written = _stored(step, "labels", instead=written)
        labels = step.select("node", "root")
        if not step.where("root <> was").limit(1).count():
            return labels


def classify(
    docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, rows: int = ROWS, bands: int = BANDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a document: (doc_id, node, class_id, class_size, first).

    ``class_id`` is the least id of the class, ``class_size`` its number of
    documents. ``first`` marks the rows that stand for their class: one,
    unless rows repeat an id and a text.
    """
    base = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    texts = _stored(lots(base), "lots")
    nodes = placed(texts)
    n, told = nodes.count(), counted(texts, nodes, k)
    signed = sign(texts, nodes, told, n, k, rows, bands)
    roots = classes(nodes, signed, texts, told, n, k, threshold)
    known = nodes.select("node", "rep", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = _stored(known, "known")
    heads = known.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("head"), F.sum("n").alias("class_size"))
    of = known.join(heads, "root").select("node", "head", "class_size")
    id_, rep = F.col("doc_id"), F.col("head.rep")
    out = texts.where(F.col("node") != F.lit(NULL)).select("doc_id", "node").join(of, "node").select(
        "doc_id", "node", rep["id"].alias("class_id"), "class_size", ((_key(id_) == rep) & (F.col("node") == F.col("head.node"))).alias("first"),
    )
    alone = texts.where(F.col("node") == F.lit(NULL)).select(
        "doc_id", "node", id_.alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("first")
    )
    return out.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the first row of its least id."""
    kept = classify(docs, id_col=id_col, text_col=text_col, **how).where(F.col("first") & (F.col("node") != F.lit(NULL)))
    node, at = fresh(docs, "node", "kept_id")

    @arrow_udf("binary")
    def node_of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            out.append(digest(t, _hashes(t) if t else np.zeros(0, dtype=_U)))
        return pa.array(out, pa.binary())

    held = kept.select(_key(F.col("doc_id")).alias(at), F.col("node").alias(node)).distinct()
    text = col(text_col).cast("string")
    keyed = docs.where(col(text_col).isNotNull()).withColumn(node, node_of(text)).withColumn(at, _key(col(id_col).cast("long")))
    row, least = F.struct(*[col(c) for c in docs.columns]), F.struct(text, F.to_json(F.struct(*[col(c) for c in docs.columns])))
    once = keyed.join(held, [at, node], "left_semi").groupBy(at, node).agg(F.min_by(row, least).alias("row"))
    return once.select("row.*").unionByName(docs.where(col(text_col).isNull()))
