"""Selection: weighted scores, exclusions, near duplicates, a varied best few."""

from collections.abc import Iterator
from datetime import date
from itertools import combinations, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.vectors import hamming
from curatrix.sources.tables import cut

#: Fixed value: how far two aspect ratios may differ and still be the same look.
ASPECT = 0.1
#: Radius from which quarters of a hash are no longer enumerated: two bits of a quarter are 137 values, which make 552 rows a look.
WIDE = 8
#: Looks of a block, and pairs that a task gives out at once.
BLOCK, PIECE = 16_384, 500_000
#: Width of a band of logarithms of aspect ratios: more than two that are alike are apart, so these are in bands that touch.
BAND = 0.106
#: Ranks of the first stretch that is deduped, and how often as long as all before the ranks then reach.
STRETCH, GROWTH = 8_192, 4


def weighted_score(scores: Column, weights: dict[str, float]) -> Column:
    """The weighted mean of a map of scores over the configured criteria, to four places, half to even."""
    total = sum(weights.values())
    parts = [F.element_at(scores, F.lit(name)).cast("double") * F.lit(float(w)) for name, w in weights.items()]
    s = parts[0]
    for p in parts[1:]:
        s = s + p
    return F.bround(s / F.lit(float(total)), 4)


def weighted_scores(long: DataFrame, criteria: DataFrame, key: str = "photo_id") -> DataFrame:
    """As ``weighted_score``, from rows (key, name, score) and (name, weight)."""
    joined = long.join(F.broadcast(criteria.select("name", "weight")), "name")
    return joined.groupBy(key).agg(F.bround(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 4).alias("score"))


def status(excluded: Column, day: Column, score: Column, minimum: float, not_before: date | None = None) -> Column:
    """The first rule that keeps an item out, or ``eligible``. An unknown day is no ground."""
    out = F.when(excluded, "visual_exclusion")
    if not_before is not None:
        out = out.when(day < F.lit(not_before), "date_exclusion")
    return out.when(score < minimum, "below_minimum_score").otherwise("eligible")


def _near_looks(looks: DataFrame, radius: int, others: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of different looks within ``radius`` bits, b of like aspect to a and some item of a ranked before one of b.

    ``looks`` has look, last, phash and ratio: a look goes by the rank of its best
    item, last is that of its worst. With ``others``, looks of the same kind, each
    of these is compared with each of ``looks`` and these not among each other.

    Hashes within r bits differ by at most r // 4 bits in one of their four
    quarters, so the one side is put under each quarter's values, the other under
    all values that differ from them by so many bits, and they meet in an
    equi-join. From ``WIDE`` bits on such values are so many that looks are
    compared with each other, block by block.
    """
    if radius >= WIDE:
        return _compared(looks, radius, others)
    left, right = (x.select(*[F.col(c).alias(f"{c}_{side}") for c in ("look", "last", "phash", "ratio")]) for x, side in ((others or looks, "a"), (looks, "b")))
    close = (
        (hamming(F.col("phash_a"), F.col("phash_b")) <= radius) & (F.col("look_a") != F.col("look_b")) & (F.col("look_a") < F.col("last_b"))
        & (F.abs(F.col("ratio_b") / F.col("ratio_a") - 1) < ASPECT)
    )

    def quarter(side: str, i: int, masks: list[int]) -> Column:
        own = F.shiftrightunsigned(F.col(f"phash_{side}"), 16 * i).bitwiseAND(0xFFFF)
        return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.lit(i).alias("i"), own.bitwiseXOR(m).alias("v")))

    def quarters(side: str, masks: list[int]) -> Column:
        return F.explode(F.flatten(F.array(*[quarter(side, i, masks) for i in range(4)])))

    # Spark takes the many rows for no larger than the looks: without a hint it would gather them in the driver.
    masks = [sum(1 << k for k in bits) for n in range(radius // 4 + 1) for bits in combinations(range(16), n)]
    met = left.withColumn("quarter", quarters("a", [0])).hint("merge").join(right.withColumn("quarter", quarters("b", masks)), "quarter").where(close)
    return met.select(F.col("look_a").alias("a"), F.col("look_b").alias("b")).distinct()


def _compared(looks: DataFrame, radius: int, others: DataFrame | None) -> DataFrame:
    """``_near_looks`` by comparing blocks of ``BLOCK`` looks at most, but for chance, each with each.

    Blocks hold looks of one band of aspect ratios; those of bands that do not
    touch are left out. A task holds two blocks at a time, however many there are.
    """
    spark = looks.sparkSession
    sides = [x.select("look", "last", "phash", "ratio", F.floor(F.log(F.abs("ratio")) / BAND).alias("band")) for x in (others, looks) if x is not None]
    counts = [{r["band"]: -(-r["n"] // BLOCK) for r in x.where("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()} for x in sides]
    first, second = ([(band, i) for band, n in sorted(x.items()) for i in range(n)] for x in (counts[0], counts[-1]))
    blocks: dict[int, list[tuple[int, int]]] = {}
    for band, i in second:
        blocks.setdefault(band, []).append((band, i))
    met = [(x, y) for x in first for band in (x[0] - 1, x[0], x[0] + 1) for y in blocks.get(band, ()) if others is not None or x <= y]
    if not met:
        return looks.select(F.col("look").alias("a"), F.col("look").alias("b")).limit(0)
    dealt = []
    for side, rows in enumerate(sides):
        of = [(pair, 0 if others is None and x == y else at + 1, *block) for pair, (x, y) in enumerate(met) for at, block in enumerate((x, y)) if (others is None or at == side) and not (at and others is None and x == y)]
        sizes = spark.createDataFrame(list(counts[side].items()), "band bigint, blocks bigint")
        numbered = rows.join(F.broadcast(sizes), "band").withColumn("block", F.pmod(F.xxhash64("look"), "blocks"))
        dealt.append(numbered.join(F.broadcast(spark.createDataFrame(of, "pair int, side int, band bigint, block bigint")), ["band", "block"]).select("pair", "side", "look", "last", "phash", "ratio"))
    rows = dealt[0] if others is None else dealt[0].unionByName(dealt[1])
    rows = rows.repartition(min(len(met), 2_000), "pair").sortWithinPartitions("pair")
    return rows.mapInPandas(_comparer(radius), "a bigint, b bigint")


def _comparer(radius: int):
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (part for frame in frames for part in frame.groupby("pair", sort=False))
        for _, held in groupby(parts, key=lambda part: part[0]):
            yield from _close(pd.concat([rows for _, rows in held]), radius)

    return compare


def _close(rows: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    """The near pairs of two blocks, sides 1 and 2, or of one, side 0, in pieces."""
    own = bool((rows["side"] == 0).any())
    a, b = (rows[rows["side"] == side] for side in ((0, 0) if own else (1, 2)))
    a, b = ({c: x[c].to_numpy() for c in ("look", "last", "phash", "ratio")} for x in (a, b))
    n, width = len(b["look"]), -(-len(b["look"]) // 8) * 8
    left, right = a["phash"].view(np.uint64), np.zeros(width, np.uint64)
    right[:n] = b["phash"].view(np.uint64)
    found, held = [], 0
    step = max(1, (1 << 17) // max(width, 1))
    for at in range(0, len(left), step):
        hits = (np.bitwise_count(left[at:at + step, None] ^ right[None]) <= radius).reshape(-1, 8)
        some = np.flatnonzero(hits.view(np.uint64))  # eight at a time, as most have none
        word, bit = np.nonzero(hits[some])
        i, j = np.divmod(some[word] * 8 + bit, max(width, 1))
        i += at
        whole = (j < n) & (j > i) if own else j < n
        i, j = i[whole], j[whole]
        for x, y, p, q in ((a, b, i, j), (b, a, j, i)):
            fits = (x["look"][p] < y["last"][q]) & (np.abs(y["ratio"][q] / x["ratio"][p] - 1) < ASPECT)
            found.append((x["look"][p][fits], y["look"][q][fits]))
            held += int(fits.sum())
        if held >= PIECE:
            yield _frame(found)
            found, held = [], 0
    if held:
        yield _frame(found)


def _frame(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def _looks(items: DataFrame) -> DataFrame:
    """The different looks of ranked items (equal hashes and sizes are one): look, last, phash, width, height and ratio."""
    seen = items.where("phash IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL").groupBy("phash", "width", "height")
    return seen.agg(F.min("rank_no").alias("look"), F.max("rank_no").alias("last")).withColumn("ratio", F.col("width") / F.col("height"))


def near_pairs(items: DataFrame, radius: int, key: str = "path") -> DataFrame:
    """(a, b, rank_a): pairs within ``radius`` bits and of like aspect, b ranked after a.

    Different looks are compared, once each, and their items joined to the pairs
    that hold: the result names every pair, so its size is that of the answer.
    """
    items = cut(items.select(key, "rank_no", "phash", "width", "height"))
    looks = cut(_looks(items))
    same = looks.where("look < last").select(F.col("look").alias("a"), F.col("look").alias("b"))
    edges = _near_looks(looks, radius).unionByName(same) if radius >= 0 else same.limit(0)
    items = items.join(looks.select("look", "phash", "width", "height").hint("merge"), ["phash", "width", "height"])
    first = items.select(F.col("look").alias("a"), F.col(key).alias("first"), F.col("rank_no").alias("rank_a"))
    later = items.select(F.col("look").alias("b"), F.col(key).alias("later"), F.col("rank_no").alias("rank_b"))
    pairs = edges.hint("merge").join(first, "a").hint("merge").join(later, "b").where("rank_a < rank_b")
    return pairs.select(F.col("first").alias("a"), F.col("later").alias("b"), "rank_a")


def ranked(items: DataFrame, key: str = "path") -> DataFrame:
    """``items`` with rank_no, a total order by score and path."""
    return numbered(items, F.desc("score"), F.asc(key))


def numbered(items: DataFrame, *order: Column) -> DataFrame:
    """``items`` with rank_no, from 1 in the given order, which must leave no ties.

    Numbers come from a range sort, written out so that they stay as they are,
    and per-partition offsets, so no task holds all rows; only the offsets of the
    partitions, one number each, pass through the driver.
    """
    spark = items.sparkSession
    rows = cut(items.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("first")).orderBy("_p").collect()
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r["_p"], at - r["first"]))
        at += r["n"]
    if not offsets:
        return items.withColumn("rank_no", F.lit(0).cast("bigint"))
    table = spark.createDataFrame(offsets, "_p int, _o bigint")
    return rows.join(F.broadcast(table), "_p").withColumn("rank_no", F.col("_i") + F.col("_o") + 1).drop("_p", "_i", "_o")


def dedupe(items: DataFrame, radius: int, key: str = "path") -> DataFrame:
    """(key, kept, duplicate_of): keep an item unless it matches a kept one ranked before it.

    Matches are equal contents, whatever the aspect, or hashes within ``radius``
    (none if it is negative) of like aspect. This is the first maximal
    independent set in rank order. It is decided in stretches of ranks, each
    longer than all before it: what matches a kept item of an earlier stretch is
    dropped, and only the others are compared among each other. ``duplicate_of``
    is the kept item of equal content, else the best-ranked kept match.
    """
    items = cut(ranked(items.select(key, "score", "sha256", "phash", "width", "height"), key).drop("score"))
    total = items.count()
    slim = items.drop(key)
    kept, decided, low = None, None, 0
    while low < total:
        high = low * GROWTH or STRETCH
        stretch = slim.where((F.col("rank_no") > low) & (F.col("rank_no") <= high))
        part = _decided(stretch, kept, radius)
        now = part.where("kept").join(slim.hint("merge"), "rank_no").select(*slim.columns)
        decided = part if decided is None else decided.unionByName(part)
        kept = now if kept is None else kept.unionByName(now)
        low = high
    if decided is None:
        return items.select(key, F.lit(True).alias("kept"), F.lit(None).cast("string").alias("duplicate_of"))
    content = kept.where("sha256 IS NOT NULL").select("sha256", F.col("rank_no").alias("same"))
    out = items.join(decided.hint("merge"), "rank_no").join(content.hint("merge"), "sha256", "left")
    owner = F.when(~F.col("kept"), F.coalesce(F.when(F.col("same") < F.col("rank_no"), F.col("same")), "near"))
    named = kept.select("rank_no").join(items.hint("merge"), "rank_no").select(F.col("rank_no").alias("owner"), F.col(key).alias("duplicate_of"))
    return out.select(key, "kept", owner.alias("owner")).join(named.hint("merge"), "owner", "left").select(key, "kept", "duplicate_of")


def _decided(items: DataFrame, kept: DataFrame | None, radius: int) -> DataFrame:
    """(rank_no, kept, near) of a stretch of ranked items, near being the best-ranked kept item that looks alike.

    ``kept`` has the kept items before the stretch. Those that match none of them
    are decided in rounds: an item is kept once no match before it is undecided or
    kept, and dropped once one is kept. Each round decides the best-ranked
    undecided item at least, so the rounds end when all are decided.

    No pairs of items are made. Of a content, and of a look with the looks near
    it, a round needs no more than the best rank that is kept and the best that
    is undecided, so a group of copies costs one row a member.
    """
    size = ["phash", "width", "height"]
    looks = cut(_looks(items))
    state = items.join(looks.select("look", *size).hint("merge"), size, "left").select("rank_no", "sha256", "look")
    none = F.lit(None).cast("bigint")
    if kept is None:
        state = state.withColumns({"kept": F.lit(None).cast("boolean"), "near": none})
    else:
        same = kept.where("sha256 IS NOT NULL").select("sha256", F.lit(True).alias("same"))
        state = state.join(same.hint("merge"), "sha256", "left")
        if radius >= 0:
            before = kept.where("phash IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
            before = before.select(F.col("rank_no").alias("look"), F.col("rank_no").alias("last"), "phash", (F.col("width") / F.col("height")).alias("ratio"))
            near = _near_looks(looks, radius, before).groupBy(F.col("b").alias("look")).agg(F.min("a").alias("near"))
            state = state.join(near.hint("merge"), "look", "left")
        else:
            state = state.withColumn("near", none)
        dropped = F.col("same").isNotNull() | F.col("near").isNotNull()
        state = state.withColumn("kept", F.when(dropped, False)).select("rank_no", "sha256", "look", "kept", "near")
    state = cut(state)
    settled = state.where("kept IS NOT NULL").select("rank_no", "kept", "near")
    state = cut(state.where("kept IS NULL").select("rank_no", "sha256", "look", "kept"))
    if radius >= 0:
        open_looks = state.groupBy("look").agg(F.max("rank_no").alias("last")).join(looks.drop("last").hint("merge"), "look")
        near = cut(_near_looks(cut(open_looks), radius).unionByName(open_looks.select(F.col("look").alias("a"), F.col("look").alias("b"))))
    best = [F.min(F.when(F.col("kept"), F.col("rank_no"))).alias("best_kept"), F.min(F.when(F.col("kept").isNull(), F.col("rank_no"))).alias("best_open")]

    def around(state: DataFrame) -> DataFrame:
        """``state`` with the best kept and undecided ranks of its content, c, and of the looks near its own, n."""
        content = state.groupBy("sha256").agg(*best).toDF("sha256", "kept_c", "open_c")
        out = state.join(content.hint("merge"), "sha256", "left")
        if radius < 0:
            return out.withColumns({"kept_n": none, "open_n": none})
        own = state.groupBy("look").agg(*best).withColumnRenamed("look", "a")
        met = near.hint("merge").join(own, "a").groupBy(F.col("b").alias("look")).agg(F.min("best_kept").alias("kept_n"), F.min("best_open").alias("open_n"))
        return out.join(met.hint("merge"), "look", "left")

    before = lambda c: F.coalesce(F.col(c) < F.col("rank_no"), F.lit(False))
    hit, undecided = before("kept_c") | before("kept_n"), before("open_c") | before("open_n")
    left = None
    while left is None or left:
        state = cut(around(state).withColumn("kept", F.coalesce("kept", F.when(hit, False).when(~undecided, True))).select("rank_no", "sha256", "look", "kept"), instead=state)
        now = state.where("kept IS NULL").count()
        if now and now == left:
            raise RuntimeError(f"{now} items cannot be decided")
        left = now
    return cut(settled.unionByName(around(state).select("rank_no", "kept", F.when(before("kept_n"), F.col("kept_n")).alias("near"))))


def diversify(
    items: DataFrame, top: int, bonus: float, max_per_day: int, min_distance: int, group: str | None = None, key: str = "path", chunk: int = 1_000,
) -> DataFrame:
    """(key, status, rank, selection_score, diversity_of) of every item looked at.

    The best few by score plus a bonus that shrinks as a category fills. Within a
    category items are taken in order of score, so only the first of each
    category matters at a time: ``chunk`` items of each are brought together,
    and more, should a category run out before ``top`` are chosen. Items never
    looked at are not in the result; they stay eligible.
    """
    group_col = F.lit(0) if group is None else F.col(group)
    pool = items.select(group_col.alias("g"), key, "score", "category", "day", "phash", "width", "height")
    order = W.partitionBy("g", "category").orderBy(F.desc("score"), F.asc(key))
    settings = dict(top=top, bonus=bonus, max_per_day=max_per_day, min_distance=min_distance, key=key)
    while True:
        numbered = pool.withColumn("n", F.row_number().over(order)).where(F.col("n") <= chunk + 1)
        got = numbered.groupBy("g").applyInPandas(
            _chooser(chunk, **settings),
            f"{key} string, status string, rank int, selection_score double, diversity_of string, short boolean",
        ).cache()
        if not got.where("short").limit(1).count():
            return got.where("status IS NOT NULL").drop("short")
        got.unpersist()
        chunk *= 8


def _chooser(chunk: int, **settings):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        return _choose(pdf, chunk=chunk, **settings)

    return choose


def _choose(pdf: pd.DataFrame, top: int, bonus: float, max_per_day: int, min_distance: int, key: str, chunk: int) -> pd.DataFrame:
    """Greedy choice within one group; ``short`` if a category's chunk ran out."""
    rows = pdf.sort_values(["score", key], ascending=[False, True], kind="stable").to_dict("records")
    queues: dict[str, list[dict]] = {}
    for i, r in enumerate(rows):
        r["place"] = i
        queues.setdefault(r["category"], []).append(r)
    heads = dict.fromkeys(queues, 0)
    taken: dict[str, int] = {}
    days: dict = {}
    chosen: list[dict] = []
    out, short = [], False
    while len(chosen) < top and heads:
        gain = {c: queues[c][i]["score"] + bonus / (1 + taken.get(c, 0)) for c, i in heads.items()}
        category = min(heads, key=lambda c: (-gain[c], queues[c][heads[c]]["place"]))
        item = queues[category][heads[category]]
        heads[category] += 1
        if heads[category] > chunk:
            short = True
            break
        if heads[category] == len(queues[category]):
            del heads[category]
        day = item["day"] if pd.notna(item["day"]) else None
        twin = next((c[key] for c in chosen if min_distance and alike(item, c, min_distance)), None)
        if day is not None and max_per_day and days.get(day, 0) >= max_per_day:
            out.append((item[key], "day_limit", None, None, None))
        elif twin is not None:
            out.append((item[key], "visual_similarity", None, None, twin))
        else:
            chosen.append(item)
            taken[category] = taken.get(category, 0) + 1
            if day is not None:
                days[day] = days.get(day, 0) + 1
            out.append((item[key], "recommended", len(chosen), round(gain[category], 4), None))
    frame = pd.DataFrame(out, columns=[key, "status", "rank", "selection_score", "diversity_of"]).astype({"rank": "Int32"})
    frame["short"] = False
    if short:
        frame = pd.DataFrame([(None, None, None, None, None, True)], columns=[*frame.columns]).astype({"rank": "Int32"})
    return frame


def alike(item: dict, other: dict, distance: int) -> bool:
    ratio = (item["width"] / item["height"]) / (other["width"] / other["height"])
    return abs(ratio - 1) < ASPECT and ((int(item["phash"]) ^ int(other["phash"])) & (1 << 64) - 1).bit_count() < distance


def select(items: DataFrame, weights: dict[str, float], settings, key: str = "path") -> DataFrame:
    """The whole selection: every item with its status, rank, scores and what it repeats.

    ``items`` has the key, excluded, day, category, scores (a map), sha256,
    phash, width and height; ``settings`` is a ``Selection`` of the configuration.
    """
    scored = items.withColumn("score", weighted_score(F.col("scores"), weights))
    scored = scored.withColumn("status", status(F.col("excluded"), F.col("day"), F.col("score"), settings.minimum_score, settings.first_day)).cache()
    pool = scored.where(F.col("status") == "eligible")
    copies = dedupe(pool, settings.near_duplicate_distance, key).cache()
    unique = pool.join(copies.where("kept").select(key), key, "left_semi")
    picks = diversify(unique, settings.top, settings.diversity_bonus, settings.max_per_day, settings.min_visual_distance, key=key)
    out = scored.drop("status").join(scored.select(key, F.col("status").alias("first")), key)
    out = out.join(copies.where(~F.col("kept")).select(key, "duplicate_of"), key, "left").join(picks, key, "left")
    final = F.coalesce("status", F.when(F.col("duplicate_of").isNotNull(), "duplicate"), F.col("first"))
    return out.withColumn("status", final).drop("first")


def variety(selected: DataFrame) -> DataFrame:
    """(distinct_known_days, undated_photos) of the recommended items."""
    return selected.where(F.col("status") == "recommended").agg(
        F.count_distinct("day").alias("distinct_known_days"), F.count_if(F.col("day").isNull()).alias("undated_photos")
    )
