"""Identity: enrolled references, and how like them a face is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.vectors import bound, checked_unit, dot, top_two_mean

#: The least side of a reference face, and the least likeness of a
#: reference to another one.
LEAST_SIDE, LEAST_PEER = 70.0, 0.30
#: References are enrolled by hand; more than these are not sent to every task.
MOST_REFERENCES = 10_000


def reference_set(refs: DataFrame, id_col: str = "ref_id", vector_col: str = "embedding") -> DataFrame:
    """One row: all references as an array of unit vectors, ordered by id.

    The number of references is counted first; beyond ``MOST_REFERENCES`` the
    query ends, as faces are scored against all of them.
    """
    rows = refs.select(F.col(id_col).alias("ref_id"), checked_unit(F.col(vector_col)).alias("unit"))
    n = rows.count()
    if n > MOST_REFERENCES:
        raise ValueError(f"{n} references are more than {MOST_REFERENCES}")
    return rows.agg(F.array_sort(F.collect_list(F.struct("ref_id", "unit"))).alias("refs"))


def score(faces: DataFrame, refs: DataFrame, vector_col: str = "embedding", out: str = "similarity") -> DataFrame:
    """``faces`` with the mean of the two greatest likenesses to the references.

    The references are a scalar subquery, one bounded value for all tasks, so
    faces are neither shuffled nor multiplied. A face's vector is brought to
    length one once, for all references.
    """
    return faces.withColumn("_refs", reference_set(refs).scalar()).withColumn(out, _likeness(vector_col)).drop("_refs")


def _likeness(vector_col: str) -> Column:
    both = F.struct(checked_unit(F.col(vector_col)).alias("own"), F.col("_refs").alias("refs"))
    return top_two_mean(bound(both, lambda p: F.transform(p["refs"], lambda r: dot(p["own"], r["unit"]))))


def matches(faces: DataFrame, refs: DataFrame, threshold: float, vector_col: str = "embedding") -> DataFrame:
    """The faces at least so like the references. The likeness that filters is the one returned, computed once."""
    known = faces.withColumn("_refs", reference_set(refs).scalar())
    likely = F.filter(F.array(_likeness(vector_col)), lambda s: s >= threshold)
    return known.select("*", F.explode(likely).alias("similarity")).drop("_refs")


def best_face(scored: DataFrame, photo_col: str = "photo_id", pos_col: str = "face_pos") -> DataFrame:
    """Per photo: number of faces, greatest similarity and its first face."""
    best = F.max(F.struct(F.col("similarity").alias("s"), (-F.col(pos_col)).alias("p"))).alias("best")
    return scored.groupBy(photo_col).agg(F.count(F.lit(1)).alias("face_count"), best).select(
        photo_col, "face_count", (-F.col("best.p")).alias("best_pos"), F.col("best.s").alias("similarity")
    )


def with_best_face(photos: DataFrame, scored: DataFrame, photo_col: str = "photo_id") -> DataFrame:
    """Photos without a face have none of its columns and the similarity -1."""
    best = best_face(scored, photo_col)
    return photos.join(best, photo_col, "left").withColumns({
        "face_count": F.coalesce("face_count", F.lit(0).cast("bigint")), "similarity": F.coalesce("similarity", F.lit(-1.0)),
    })


def peers(refs: DataFrame) -> DataFrame:
    """Per reference: the greatest and the least likeness to another one; of a counted number of references."""
    others = F.filter(F.col("refs"), lambda r: r["ref_id"] != F.col("ref_id"))
    both = F.struct(checked_unit(F.col("embedding")).alias("own"), others.alias("others"))
    scores = bound(both, lambda p: F.transform(p["others"], lambda r: dot(p["own"], r["unit"])))
    ends = bound(scores, lambda s: F.struct(F.array_max(s).alias("best_peer"), F.array_min(s).alias("least_peer")))
    refs = refs.select("ref_id", "embedding", reference_set(refs).scalar().alias("refs"))
    return refs.select("ref_id", ends.alias("e")).where(F.col("e.best_peer").isNotNull()).select("ref_id", "e.best_peer", "e.least_peer")


def centroid(refs: DataFrame) -> DataFrame:
    """(pos, value): the mean of the vectors, at length one."""
    mean = refs.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy(F.lit(0))))
    return mean.select("pos", (F.col("m") / length).alias("value"))


def enrolled(candidates: DataFrame, skip_invalid: bool) -> DataFrame:
    """The references that can be enrolled: (path, sha256, embedding).

    ``candidates`` has path, sha256 and ``faces``, an array of structs with
    face_pixels and embedding. The rules are checked in a fixed order: at least
    two files, one large enough face in each (or it is left out, if
    ``skip_invalid``), at least two left, no equal files, a peer for each.
    """
    sound = (F.size("faces") == 1) & (F.get("faces", F.lit(0))["face_pixels"] >= LEAST_SIDE)
    counts = candidates.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(sound, F.lit(False))).alias("ok")).first()
    if counts["n"] < 2:
        raise ValueError(f"two references at least are needed, not {counts['n']}")
    if counts["ok"] < counts["n"] and not skip_invalid:
        raise ValueError(f"{counts['n'] - counts['ok']} references do not show exactly one large enough face")
    if counts["ok"] < 2:
        raise ValueError("fewer than two references can be used")
    kept = candidates.where(sound).select("path", "sha256", F.get("faces", F.lit(0))["embedding"].alias("embedding"))
    if kept.select("sha256").distinct().count() != counts["ok"]:
        raise ValueError("references repeat a file")
    lonely = peers(kept.withColumnRenamed("path", "ref_id")).where(F.col("best_peer") < LEAST_PEER).select("ref_id").limit(10).collect()
    if lonely:
        raise ValueError("references like no other one: " + ", ".join(str(r["ref_id"]) for r in lonely))
    return kept
