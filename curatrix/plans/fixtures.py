"""Views over general tables that play the parts of a media collection.

Each view exists as a DataFrame and as the same relation in DuckDB SQL, so that
every query can be held against SQL over the same rows. Vectors stand for faces
and references, documents for files, events for scores and days.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.vectors import median_bits

WEIGHTS = {"expression": 3.0, "pose": 2.0, "composition": 2.0, "presentation": 1.5, "story": 1.5, "technical": 1.0}
REFERENCES = 5
CONFIG = "c1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") < REFERENCES).select(F.col("vec_id").alias("ref_id"), "embedding")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") >= REFERENCES)
    return rows.select("vec_id", F.floor(F.col("vec_id") / 2).alias("photo_id"), (F.col("vec_id") % 2).alias("face_pos"), "embedding")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, path): names with possible, impossible, mixed, touching and absent dates, and other endings."""
    v = F.col("vec_id")
    day = F.lpad((v % 28 + 1).cast("string"), 2, "0")
    named = (
        F.when(v % 5 == 0, F.concat(F.lit("202401"), day)).when(v % 5 == 1, F.lit("2024-02-30"))
        .when(v % 5 == 2, F.concat(F.lit("2023_11"), day)).when(v % 5 == 3, F.concat(F.lit("9202401"), day)).otherwise(F.lit("x"))
    )
    folder = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (v % 3 + 1).cast("int"))
    ending = F.when(v % 7 == 0, ".JPG").when(v % 7 == 1, ".txt").when(v % 7 == 2, ".heic").otherwise(".jpg")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("/library/"), folder, F.lit("/IMG_"), named, F.lit("_"), v.cast("string"), ending).alias("path"))


PATHS = """paths AS (SELECT vec_id, '/library/' || ['a', 'b', 'c'][vec_id % 3 + 1] || '/IMG_' ||
  CASE vec_id % 5 WHEN 0 THEN '202401' || lpad(CAST(vec_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN '2024-02-30'
    WHEN 2 THEN '2023_11' || lpad(CAST(vec_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 3 THEN '9202401' || lpad(CAST(vec_id % 28 + 1 AS VARCHAR), 2, '0') ELSE 'x' END
  || '_' || CAST(vec_id AS VARCHAR) || CASE vec_id % 7 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '.heic' ELSE '.jpg' END AS path FROM embeddings)"""


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, name, score): a score of each criterion for every vector."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    n = events.agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(WEIGHTS)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(names).alias("c")).crossJoin(F.broadcast(n))
    rows = rows.select("vec_id", "c.name", ((F.col("vec_id") * 6 + F.col("c.k")) % F.col("n")).alias("event_id"))
    return rows.join(events, "event_id").select("vec_id", "name", (F.floor(F.col("value") % 10 * 10) / 10).alias("score"))


_NAMES = ", ".join(f"({k}, '{name}', {w})" for k, (name, w) in enumerate(WEIGHTS.items()))
SCORES = f"""criteria(k, name, weight) AS (VALUES {_NAMES}),
long_scores AS (SELECT vec_id, k, name, weight, floor(value % 10 * 10) / 10 AS score
  FROM embeddings, criteria JOIN events ON event_id = (vec_id * 6 + k) % (SELECT count(*) FROM events))"""


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "name string, weight double")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection candidates: path, sha256, phash, size, day, category, excluded and scores."""
    v = F.col("vec_id")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.sha2("text", 256).alias("sha256"))
    files = documents.agg(F.count(F.lit(1)).alias("files"))
    events = table(spark, sf_dir, "events")
    n = events.agg(F.count(F.lit(1)).alias("n"))
    days = events.select(F.col("event_id").alias("at"), F.to_date("ts").alias("seen"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("t")).distinct()
    scores = long_scores(spark, sf_dir).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "score"))).alias("scores"))
    category = F.element_at(F.array(*[F.lit(c) for c in ("portrait", "full_body", "activity", "social", "other")]), (F.col("label") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(files)).join(paths(spark, sf_dir), "vec_id")
    rows = rows.join(documents, v % F.col("files") == F.col("d"), "left").join(days, v * 97 % F.col("n") == F.col("at"), "left")
    rows = rows.join(toxic, v == F.col("t"), "left").join(scores, "vec_id")
    return rows.select(
        "vec_id", "path", "sha256", median_bits(F.col("embedding")).alias("phash"), (F.lit(100) + v % 3 * 30).cast("bigint").alias("width"),
        F.lit(100).cast("bigint").alias("height"), F.when(v % 11 != 0, F.col("seen")).alias("day"), category.alias("category"),
        F.col("t").isNotNull().alias("excluded"), "scores",
    )


_TERMS = " + ".join(f"sum(score) FILTER (name = '{name}') * {w}" for name, w in WEIGHTS.items())
ITEMS = f"""{PATHS}, {SCORES},
scored AS (SELECT vec_id, round_even(({_TERMS}) / {sum(WEIGHTS.values())}::DOUBLE, 4)::DOUBLE AS score FROM long_scores GROUP BY vec_id),
bits AS (SELECT vec_id, label, embedding AS e, list_sort(embedding[2:64])[32] AS m FROM embeddings),
hashes AS (SELECT vec_id, label, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN i = 0 OR e[i + 1] <= m THEN 0::BIGINT
  WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << i END), lambda a, b: a | b) AS phash FROM bits),
items AS MATERIALIZED (SELECT h.vec_id, path, sha256(d.text) AS sha256, phash, 100 + h.vec_id % 3 * 30 AS width, 100::BIGINT AS height,
  CASE WHEN h.vec_id % 11 <> 0 THEN CAST(ev.ts AS DATE) END AS day,
  ['portrait', 'full_body', 'activity', 'social', 'other'][label % 5 + 1] AS category,
  h.vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS excluded, s.score
  FROM hashes h JOIN paths USING (vec_id) JOIN scored s USING (vec_id) LEFT JOIN documents d ON d.doc_id = h.vec_id % (SELECT count(*) FROM documents)
  LEFT JOIN events ev ON ev.event_id = h.vec_id * 97 % (SELECT count(*) FROM events))"""


VARIANT_RADIUS = 11


def variants(items: DataFrame) -> DataFrame:
    """``items`` in threes of one look: two of each three have the first one's hash with five bits changed."""
    v = F.col("vec_id")
    flip = F.expr("shiftleft(cast(vec_id % 3 * 4681 as bigint), cast(vec_id % 40 as int))")
    first = items.select(F.col("vec_id").alias("of"), F.col("phash").alias("first"))
    changed = items.join(first, v - v % 3 == F.col("of")).withColumns({"phash": F.col("first").bitwiseXOR(flip), "width": F.lit(100).cast("bigint")})
    return changed.withColumn("sha256", F.when(v % 4 == 1, F.lit("one")).otherwise(F.col("sha256"))).drop("of", "first")


VARIANTS = """variants AS MATERIALIZED (SELECT i.vec_id, i.path, CASE WHEN i.vec_id % 4 = 1 THEN 'one' ELSE i.sha256 END AS sha256,
  xor(f.phash, (i.vec_id % 3 * 4681)::BIGINT << (i.vec_id % 40)::BIGINT) AS phash, 100::BIGINT AS width, i.height, i.score, i.excluded
  FROM items i JOIN items f ON f.vec_id = i.vec_id - i.vec_id % 3)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored inventory and a later listing of the same documents."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), d.cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), (d * 1000 + 7).alias("mtime_ns"))
    stored = rows.where(d % 10 != 3).select(
        "path", "size", "mtime_ns", F.when(d % 7 == 0, "c0").otherwise(CONFIG).alias("config"), F.when(d % 11 == 0, "unreadable").alias("error")
    )
    listing = rows.where(d % 13 != 5).select("path", F.when(d % 17 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ns")
    return listing, stored


SNAPSHOTS = """files AS (SELECT doc_id, 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS path, n_chars AS size, doc_id * 1000 + 7 AS mtime_ns FROM documents),
stored AS (SELECT path, size, mtime_ns, CASE WHEN doc_id % 7 = 0 THEN 'c0' ELSE 'c1' END AS config,
  CASE WHEN doc_id % 11 = 0 THEN 'unreadable' END AS error FROM files WHERE doc_id % 10 <> 3),
listing AS (SELECT path, CASE WHEN doc_id % 17 = 2 THEN size + 1 ELSE size END AS size, mtime_ns FROM files WHERE doc_id % 13 <> 5)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned rows: number of faces, similarity, error."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (v % 4).alias("face_count"), F.when(v % 4 == 0, F.lit(-1.0)).otherwise(F.round((v * 7 % 100) / 100, 2)).alias("similarity"), F.when(v % 23 == 0, "bad file").alias("error")
    )


PHOTOS = """photos AS (SELECT vec_id, vec_id % 4 AS face_count, CASE WHEN vec_id % 4 = 0 THEN -1.0::DOUBLE ELSE round((vec_id * 7 % 100)::DOUBLE / 100, 2) END AS similarity,
  CASE WHEN vec_id % 23 = 0 THEN 'bad file' END AS error FROM embeddings)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five overlapping detections an image."""
    v = F.col("vec_id")
    x, y = (v * 13 % 50).cast("double"), (v * 29 % 50).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 5).alias("image_id"), v.alias("box_id"), ((v * 37 % 60 + 40) / 100).alias("conf"), x.alias("x1"), y.alias("y1"), (x + 40).alias("x2"), (y + 40).alias("y2")
    )


BOXES = """boxes AS (SELECT vec_id // 5 AS image_id, vec_id AS box_id, (vec_id * 37 % 60 + 40)::DOUBLE / 100 AS conf, (vec_id * 13 % 50)::DOUBLE AS x1,
  (vec_id * 29 % 50)::DOUBLE AS y1, (vec_id * 13 % 50)::DOUBLE + 40 AS x2, (vec_id * 29 % 50)::DOUBLE + 40 AS y2 FROM embeddings)"""

_GOOD = '"exclusion_reason":"","category":"portrait","summary":"s"'
_E, _P = '"expression":{"score":7,"reason":"r"}', '"pose":{"score":6.5,"reason":"r"}'
#: One text for each rule of a valid assessment, the first valid.
ASSESSMENTS = [
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},{_P}}}}}',
    "no JSON at all",
    f'{{"excluded":false,"exclusion_reason":"","category":"portrait","scores":{{{_E},{_P}}}}}',
    f'{{"excluded":"no",{_GOOD},"scores":{{{_E},{_P}}}}}',
    f'{{"excluded":false,"exclusion_reason":"","category":"landscape","summary":"s","scores":{{{_E},{_P}}}}}',
    f'{{"excluded":true,"exclusion_reason":"  ","category":"other","summary":"s","scores":{{{_E},{_P}}}}}',
    f'{{"excluded":false,{_GOOD},"scores":{{{_E}}}}}',
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},"pose":{{"score":true,"reason":"r"}}}}}}',
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},"pose":{{"score":11,"reason":"r"}}}}}}',
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},"pose":{{"score":-1,"reason":"r"}}}}}}',
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},"pose":{{"score":5,"reason":" "}}}}}}',
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},"pose":{{"score":5,"reason":"r","note":1}}}}}}',
    "[1, 2]",
    f'{{"excluded":false,{_GOOD},"scores":{{{_E},"pose":{{"score":"5","reason":"r"}}}}}}',
]


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(list(enumerate(ASSESSMENTS)), "k bigint, text string")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % len(ASSESSMENTS)).alias("k")).join(F.broadcast(texts), "k").select("vec_id", "text")


_TEXTS = ", ".join(f"({k}, '{t}')" for k, t in enumerate(ASSESSMENTS))
ASSESSMENT_TEXTS = f"""texts(k, text) AS (VALUES {_TEXTS}),
assessments AS (SELECT vec_id, text FROM embeddings JOIN texts ON k = vec_id % {len(ASSESSMENTS)})"""
