"""The named queries over the test views, and the same in DuckDB SQL."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.config import Selection
from curatrix.functions import text as T
from curatrix.functions.vectors import checked_unit, dot, hex16
from curatrix.operators import assessment, detection, identity, inventory, selection
from curatrix.plans import fixtures as X
from curatrix.sources import sinks

# Settings under which every rule has work to do on the test views.
THRESHOLD, RADIUS, DISTANCE, DAY_CAP, TOP, BONUS, MINIMUM = 0.15, 19, 24, 2, 30, 0.75, 4.5
NOT_BEFORE = "2024-01-05"
SETTINGS = Selection(TOP, MINIMUM, RADIUS, BONUS, DAY_CAP, DISTANCE)

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_UNIT = f"(SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt({_DOT.format('embedding', 'embedding')})) AS u FROM embeddings)"
_FACE = f"""unit AS {_UNIT},
pair AS (SELECT f.vec_id, {_DOT.format('f.u', 'r.u')} AS s FROM unit f, unit r WHERE f.vec_id >= 5 AND r.vec_id < 5),
top AS (SELECT vec_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS n FROM pair),
face AS (SELECT vec_id, avg(s) AS similarity FROM top WHERE n <= 2 GROUP BY vec_id)"""


@query(f"WITH {_FACE} SELECT vec_id, round(similarity, 6) AS similarity FROM face WHERE similarity >= {THRESHOLD}")
def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """C1 E4 F1 G6 D1."""
    return identity.matches(X.faces(spark, d), X.refs(spark, d), THRESHOLD).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_FACE}, ranked AS (SELECT vec_id // 2 AS photo_id, vec_id % 2 AS pos, similarity, row_number() OVER (PARTITION BY vec_id // 2 ORDER BY similarity DESC, vec_id) AS n,
  count(*) OVER (PARTITION BY vec_id // 2) AS face_count FROM face)
SELECT photo_id, face_count, pos AS best_pos, round(similarity, 6) AS similarity FROM ranked WHERE n = 1""")
def best_face_per_photo(spark: SparkSession, d: str) -> DataFrame:
    """F2 F3 C3."""
    best = identity.best_face(identity.score(X.faces(spark, d), X.refs(spark, d)))
    return best.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_FACE}, photo AS (SELECT vec_id, vec_id % 3 = 0 AS empty FROM embeddings)
SELECT photo.vec_id AS photo_id, CAST(CASE WHEN face.vec_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS face_count, round(coalesce(similarity, -1), 6) AS similarity
FROM photo LEFT JOIN face ON face.vec_id = photo.vec_id AND NOT empty""")
def faceless_photos(spark: SparkSession, d: str) -> DataFrame:
    """a photo without a face has the similarity -1."""
    photos = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"))
    faces = X.faces(spark, d).where("vec_id % 3 <> 0").withColumns({"photo_id": F.col("vec_id"), "face_pos": F.lit(0)})
    scored = identity.score(faces, X.refs(spark, d))
    return identity.with_best_face(photos, scored).select("photo_id", "face_count", F.round("similarity", 6).alias("similarity"))


_PEER = f"""unit AS {_UNIT}, peer AS (SELECT a.vec_id, {_DOT.format('a.u', 'b.u')} AS s FROM unit a, unit b WHERE a.vec_id < 5 AND b.vec_id < 5 AND a.vec_id <> b.vec_id)"""


@query(f"WITH {_PEER} SELECT vec_id AS ref_id, round(max(s), 6) AS best_peer, max(s) >= 0.30 AS convincing FROM peer GROUP BY 1")
def reference_peer_check(spark: SparkSession, d: str) -> DataFrame:
    """E5 F4 D9."""
    found = identity.peers(X.refs(spark, d))
    return found.select("ref_id", F.round("best_peer", 6).alias("best_peer"), (F.col("best_peer") >= identity.LEAST_PEER).alias("convincing"))


@query(f"WITH {_PEER} SELECT round(min(s), 6) AS least, round(max(s), 6) AS most FROM peer")
def reference_pair_range(spark: SparkSession, d: str) -> DataFrame:
    """F6."""
    return identity.peers(X.refs(spark, d)).agg(F.round(F.min("least_peer"), 6).alias("least"), F.round(F.max("best_peer"), 6).alias("most"))


@query("""WITH x AS (SELECT unnest(range(0, 64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE vec_id < 5), m AS (SELECT pos, avg(v) AS m FROM x GROUP BY pos)
SELECT CAST(pos AS INT) AS pos, round(m / (SELECT sqrt(sum(m * m)) FROM m), 6) AS value FROM m""")
def reference_centroid(spark: SparkSession, d: str) -> DataFrame:
    """F5 C1."""
    return identity.centroid(X.refs(spark, d)).select("pos", F.round("value", 6).alias("value"))


@query(f"WITH {X.ITEMS} SELECT vec_id, phash, printf('%016x', CASE WHEN phash < 0 THEN (phash::HUGEINT + 18446744073709551616)::UBIGINT ELSE phash::UBIGINT END) AS hex FROM items")
def embedding_hash64(spark: SparkSession, d: str) -> DataFrame:
    """C2 (binarising) F7 J.3."""
    return X.items(spark, d).select("vec_id", "phash", hex16(F.col("phash")).alias("hex"))


_ALIKE = "abs((b.width / b.height) / (a.width / a.height) - 1) < 0.1"


@query(f"""WITH {X.ITEMS} SELECT a.path AS a, b.path AS b FROM items a, items b
WHERE bit_count(xor(a.phash, b.phash)) <= {RADIUS} AND {_ALIKE} AND (a.score > b.score OR a.score = b.score AND a.path < b.path)""")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """E7 C12 J.3."""
    return selection.near_pairs(selection.ranked(_scored(spark, d)), RADIUS).select("a", "b")


@query(f"WITH {X.ITEMS} SELECT sha256, count(*) AS n, min(path) AS first_path FROM items GROUP BY sha256 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """E6 F10."""
    return X.items(spark, d).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return X.items(spark, d).withColumn("score", selection.weighted_score(F.col("scores"), X.WEIGHTS))


@query(f"WITH {X.ITEMS} SELECT vec_id, score FROM items")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    """C8 C9 E10 F9."""
    return _scored(spark, d).select("vec_id", "score")


@query(f"WITH {X.SCORES} SELECT vec_id, round_even(sum(score * weight) / sum(weight), 4)::DOUBLE AS score FROM long_scores GROUP BY vec_id")
def weighted_score_long(spark: SparkSession, d: str) -> DataFrame:
    """C8 E10 F9 as a join and an aggregate."""
    return selection.weighted_scores(X.long_scores(spark, d), X.criteria(spark), "vec_id")


@query(f"""WITH {X.ITEMS} SELECT vec_id, CASE WHEN excluded THEN 'visual_exclusion' WHEN day < DATE '{NOT_BEFORE}' THEN 'date_exclusion'
  WHEN score < {MINIMUM} THEN 'below_minimum_score' ELSE 'eligible' END AS status FROM items""")
def status_cascade(spark: SparkSession, d: str) -> DataFrame:
    """D5 D6 D7."""
    found = selection.status(F.col("excluded"), F.col("day"), F.col("score"), MINIMUM, date.fromisoformat(NOT_BEFORE))
    return _scored(spark, d).select("vec_id", found.alias("status"))


@query(f"WITH {X.ITEMS} SELECT vec_id, CAST(day AS VARCHAR) AS day FROM items WHERE day IS NULL OR day >= DATE '{NOT_BEFORE}'")
def not_before_filter(spark: SparkSession, d: str) -> DataFrame:
    """Unknown days stay."""
    return X.items(spark, d).where(F.col("day").isNull() | (F.col("day") >= F.lit(date.fromisoformat(NOT_BEFORE)))).select("vec_id", F.col("day").cast("string").alias("day"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    found = selection.status(F.col("excluded"), F.col("day"), F.col("score"), MINIMUM)
    return _scored(spark, d).where(found == "eligible")


def _greedy(items: str, radius: int) -> str:
    return f"""pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS r FROM {items} WHERE NOT excluded AND score >= {MINIMUM}),
walk AS (SELECT 0::BIGINT AS r, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS owner,
    CAST([] AS STRUCT(path VARCHAR, sha256 VARCHAR, phash BIGINT, a DOUBLE)[]) AS kept
  UNION ALL
  SELECT p.r, p.path, o.owner, CASE WHEN o.owner IS NULL THEN list_append(w.kept, {{'path': p.path, 'sha256': p.sha256, 'phash': p.phash, 'a': p.width / p.height}}) ELSE w.kept END
  FROM walk w JOIN pool p ON p.r = w.r + 1, LATERAL (SELECT coalesce(
    list_filter(w.kept, lambda k: k.sha256 = p.sha256)[1].path,
    list_filter(w.kept, lambda k: bit_count(xor(k.phash, p.phash)) <= {radius} AND abs((p.width / p.height) / k.a - 1) < 0.1)[1].path) AS owner) o)"""


_GREEDY = _greedy("items", RADIUS)


@query(f"""WITH {X.ITEMS}, {X.VARIANTS} SELECT a.path AS a, b.path AS b FROM variants a, variants b
WHERE bit_count(xor(a.phash, b.phash)) <= {X.VARIANT_RADIUS} AND {_ALIKE} AND (a.score > b.score OR a.score = b.score AND a.path < b.path)""")
def near_duplicate_pairs_banded(spark: SparkSession, d: str) -> DataFrame:
    """E7 through enumerated quarters of the hash: the same answer by an equi-join, on hashes that differ by a few bits in threes."""
    return selection.near_pairs(selection.ranked(X.variants(_scored(spark, d))), X.VARIANT_RADIUS).select("a", "b")


@query(f"""WITH RECURSIVE {X.ITEMS}, {X.VARIANTS}, {_greedy('variants', X.VARIANT_RADIUS)} SELECT path, owner IS NULL AS kept, owner AS duplicate_of FROM walk WHERE r > 0""")
def greedy_dedupe_variants(spark: SparkSession, d: str) -> DataFrame:
    """G2 E6 E7 on variants of the same looks, with equal contents across them."""
    pool = X.variants(_scored(spark, d)).where(~F.col("excluded") & (F.col("score") >= MINIMUM))
    return selection.dedupe(pool, X.VARIANT_RADIUS)


@query(f"WITH RECURSIVE {X.ITEMS}, {_GREEDY} SELECT path, owner IS NULL AS kept, owner AS duplicate_of FROM walk WHERE r > 0")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """G1 G2 E6 E7 I: the first maximal independent set in rank order."""
    return selection.dedupe(_pool(spark, d), RADIUS)


_CHOOSE = f"""uniq AS MATERIALIZED (SELECT path, score, category, day, phash, width / height AS a, row_number() OVER (ORDER BY score DESC, path) AS r
  FROM pool SEMI JOIN (SELECT path FROM walk WHERE r > 0 AND owner IS NULL) USING (path)),
pick AS (SELECT 0::BIGINT AS step, CAST([] AS STRUCT(path VARCHAR, category VARCHAR, day DATE, phash BIGINT, a DOUBLE)[]) AS chosen, CAST([] AS VARCHAR[]) AS seen,
    CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS VARCHAR) AS diversity_of
  UNION ALL
  SELECT t.step + 1, CASE WHEN s.status = 'recommended' THEN list_append(t.chosen, {{'path': b.path, 'category': b.category, 'day': b.day, 'phash': b.phash, 'a': b.a}}) ELSE t.chosen END,
    list_append(t.seen, b.path), b.path, s.status, b.gain, CASE WHEN s.status = 'visual_similarity' THEN s.twin END
  FROM pick t, LATERAL (
    SELECT u.*, u.score + {BONUS} / (1 + len(list_filter(t.chosen, lambda c: c.category = u.category))) AS gain FROM uniq u
    WHERE len(t.chosen) < {TOP} AND NOT list_contains(t.seen, u.path) ORDER BY gain DESC, u.r LIMIT 1) b, LATERAL (
    SELECT twin, CASE WHEN b.day IS NOT NULL AND len(list_filter(t.chosen, lambda c: c.day = b.day)) >= {DAY_CAP} THEN 'day_limit' WHEN twin IS NOT NULL THEN 'visual_similarity' ELSE 'recommended' END AS status
    FROM (SELECT list_filter(t.chosen, lambda c: bit_count(xor(c.phash, b.phash)) < {DISTANCE} AND abs(b.a / c.a - 1) < 0.1)[1].path AS twin)) s)"""


@query(f"""WITH RECURSIVE {X.ITEMS}, {_GREEDY}, {_CHOOSE}
SELECT path, status, CASE WHEN status = 'recommended' THEN CAST(sum(CASE WHEN status = 'recommended' THEN 1 ELSE 0 END) OVER (ORDER BY step) AS INT) END AS rank,
  CASE WHEN status = 'recommended' THEN round_even(gain, 4)::DOUBLE END AS selection_score, diversity_of FROM pick WHERE step > 0""")
def diversified_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The varied best few, with what each rejected item ran into."""
    pool = _pool(spark, d)
    kept = selection.dedupe(pool, RADIUS).where("kept").select("path")
    return selection.diversify(pool.join(kept, "path", "left_semi"), TOP, BONUS, DAY_CAP, DISTANCE)


@query(f"""WITH RECURSIVE {X.ITEMS}, {_GREEDY}, {_CHOOSE}
SELECT i.path, i.score, coalesce(p.status, CASE WHEN w.owner IS NOT NULL THEN 'duplicate' WHEN excluded THEN 'visual_exclusion' WHEN score < {MINIMUM} THEN 'below_minimum_score' ELSE 'eligible' END) AS status, w.owner AS duplicate_of
FROM items i LEFT JOIN (SELECT path, owner FROM walk WHERE r > 0) w ON w.path = i.path LEFT JOIN pick p ON p.path = i.path""")
def selection_statuses(spark: SparkSession, d: str) -> DataFrame:
    """G1-G3 G7 and the whole status lattice, for every item."""
    return selection.select(X.items(spark, d), X.WEIGHTS, SETTINGS).select("path", "score", "status", "duplicate_of")


@query(f"""WITH RECURSIVE {X.ITEMS}, {_GREEDY}, {_CHOOSE}
SELECT count(DISTINCT day) AS distinct_known_days, count(*) FILTER (day IS NULL) AS undated_photos FROM items SEMI JOIN (SELECT path FROM pick WHERE status = 'recommended') USING (path)""")
def variety_report(spark: SparkSession, d: str) -> DataFrame:
    """F11."""
    return selection.variety(selection.select(X.items(spark, d), X.WEIGHTS, SETTINGS))


@query(f"""WITH {X.PATHS}, found AS (SELECT vec_id, regexp_extract(path, '(?:^|[^0-9])((?:19|20)[0-9][0-9])[-_]?([01][0-9])[-_]?([0-3][0-9])(?:[^0-9]|$)', ['y', 'm', 'd']) AS p FROM paths)
SELECT vec_id, CASE WHEN p.y <> '' THEN CAST(TRY_CAST(p.y || '-' || p.m || '-' || p.d AS DATE) AS VARCHAR) END AS day,
  CASE WHEN p.y <> '' AND TRY_CAST(p.y || '-' || p.m || '-' || p.d AS DATE) IS NOT NULL THEN 'filename/folder' ELSE 'unknown' END AS date_source FROM found""")
def capture_date(spark: SparkSession, d: str) -> DataFrame:
    """C10 C11 J.1."""
    rows = X.paths(spark, d).withColumn("relative", T.relative(F.col("path"), F.lit("/library")))
    day, source = T.capture_date(F.lit(None).cast("string"), F.col("relative"))
    return rows.select("vec_id", day.cast("string").alias("day"), source.alias("date_source"))


@query(f"""WITH {X.PATHS} SELECT vec_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension FROM paths
WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({', '.join(f"'{e}'" for e in T.EXTENSIONS)})""")
def supported_extensions(spark: SparkSession, d: str) -> DataFrame:
    """A2 J.2."""
    return X.paths(spark, d).where(T.supported(F.col("path"))).select("vec_id", T.extension(F.col("path")).alias("extension"))


_CHANGE = """change AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'vanished' WHEN b.path IS NULL THEN 'new'
  WHEN a.size <> b.size OR a.mtime_ns <> b.mtime_ns OR config <> 'c1' THEN 'changed' WHEN error IS NOT NULL THEN 'retry' ELSE 'unchanged' END AS change
  FROM listing a FULL JOIN stored b ON a.path = b.path)"""


@query(f"WITH {X.SNAPSHOTS}, {_CHANGE} SELECT path, change FROM change")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """M1 M2 E1 D2 A4."""
    return inventory.difference(*X.snapshots(spark, d), X.CONFIG)


@query(f"WITH {X.SNAPSHOTS} SELECT path FROM stored EXCEPT SELECT path FROM listing")
def vanished_rows(spark: SparkSession, d: str) -> DataFrame:
    """E3 I1 B3."""
    return inventory.vanished(*X.snapshots(spark, d))


@query(f"WITH {X.SNAPSHOTS} SELECT path, size, mtime_ns FROM listing l WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = l.path AND s.size = l.size AND s.mtime_ns = l.mtime_ns AND s.config = 'c1' AND s.error IS NULL)")
def pending_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a scan has to process."""
    return inventory.pending(*X.snapshots(spark, d), X.CONFIG)


@query(f"WITH {X.SNAPSHOTS} SELECT path, size, mtime_ns FROM listing l WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.path = l.path AND s.size = l.size AND s.mtime_ns = l.mtime_ns AND s.config = 'c1' AND s.error IS NULL) ORDER BY path LIMIT 50")
def pending_limit(spark: SparkSession, d: str) -> DataFrame:
    """A limit on processed rows is the feature."""
    return inventory.pending(*X.snapshots(spark, d), X.CONFIG, limit=50)


@query(f"WITH {X.SNAPSHOTS} SELECT l.path FROM listing l LEFT JOIN stored s ON l.path = s.path AND l.size = s.size AND l.mtime_ns = s.mtime_ns AND s.config = 'c1' WHERE s.path IS NULL")
def staleness_check(spark: SparkSession, d: str) -> DataFrame:
    """D3 D17."""
    return inventory.stale(*X.snapshots(spark, d), X.CONFIG)


@query(f"""WITH {X.SNAPSHOTS}, {_CHANGE}, c AS (SELECT count(*) FILTER (change <> 'unchanged') AS p, count(*) FILTER (change = 'unchanged') AS k,
  count(*) FILTER (change <> 'unchanged' AND path IN (SELECT path FROM stored WHERE error IS NOT NULL)) AS e, count(*) AS t FROM change WHERE change <> 'vanished')
SELECT 'processed' AS outcome, p AS n FROM c UNION ALL SELECT 'cached', k FROM c UNION ALL SELECT 'errors', e FROM c UNION ALL SELECT 'total', t FROM c""")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    """F12."""
    listing, stored = X.snapshots(spark, d)
    return inventory.counters(inventory.difference(listing, stored, X.CONFIG), stored.where("error IS NOT NULL"))


@query(f"""WITH {X.SNAPSHOTS}, {_CHANGE} SELECT path, CASE WHEN change = 'unchanged' THEN 'kept' ELSE 'fresh' END AS origin, l.size
FROM change JOIN listing l USING (path)""")
def upsert_photos(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows after a scan."""
    listing, stored = X.snapshots(spark, d)
    fresh = inventory.pending(listing, stored, X.CONFIG).select("path", "size", F.lit("fresh").alias("origin"))
    kept = stored.select("path", "size", F.lit("kept").alias("origin"))
    return inventory.upsert(kept, fresh, listing).select("path", "origin", "size")


@query(f"""WITH {X.SNAPSHOTS}, a AS (SELECT DISTINCT path, size, mtime_ns FROM listing), b AS (SELECT DISTINCT path, size, mtime_ns FROM stored),
x AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_before, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_after)
SELECT *, only_before = 0 AND only_after = 0 AS equal FROM x""")
def snapshot_equality(spark: SparkSession, d: str) -> DataFrame:
    """I2 M8 D12."""
    return inventory.same_snapshot(*X.snapshots(spark, d))


_KEYED = f"""{X.ITEMS}, cached AS (SELECT DISTINCT sha256 FROM items WHERE vec_id % 10 < 3)"""


@query(f"WITH {_KEYED} SELECT path, sha256 IN (SELECT sha256 FROM cached) AS hit FROM items")
def assessment_cache_split(spark: SparkSession, d: str) -> DataFrame:
    """E2 A10 M3 M4 F15 J.4."""
    hits, misses = assessment.split(*_cached(spark, d))
    return hits.select("path", F.lit(True).alias("hit")).unionByName(misses.select("path", F.lit(False).alias("hit")))


def _cached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = assessment.keyed(X.items(spark, d).withColumn("box", F.array(F.lit(0.0), F.lit(0.0))), "rubric")
    return items, items.where("vec_id % 10 < 3").select("key").distinct().withColumn("result", F.lit("{}"))


@query(f"WITH {_KEYED} SELECT min(path) AS path, sha256 FROM items WHERE sha256 NOT IN (SELECT sha256 FROM cached) GROUP BY sha256")
def memo_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """M5: equal content is assessed once."""
    _, misses = assessment.split(*_cached(spark, d))
    return assessment.once(misses).select("path", "sha256")


_J = "json_extract(j, '{0}')"
_NUM = "json_type(j, '$.scores.pose.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')"


@query(f"""WITH {X.ASSESSMENT_TEXTS}, p AS (SELECT vec_id, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM assessments)
SELECT vec_id, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not a JSON object'
  WHEN list_sort(json_keys(j)) <> ['category', 'excluded', 'exclusion_reason', 'scores', 'summary'] THEN 'wrong parts'
  WHEN json_type(j, '$.excluded') <> 'BOOLEAN' THEN 'excluded is not a boolean'
  WHEN json_extract_string(j, '$.category') NOT IN ('portrait', 'full_body', 'activity', 'social', 'other') THEN 'unknown category'
  WHEN json_extract_string(j, '$.excluded') = 'true' AND trim(json_extract_string(j, '$.exclusion_reason')) = '' THEN 'excluded without a reason'
  WHEN list_sort(json_keys(j, '$.scores')) <> ['expression', 'pose'] THEN 'wrong criteria'
  WHEN list_sort(json_keys(j, '$.scores.pose')) <> ['reason', 'score'] THEN 'wrong parts of a score'
  WHEN NOT {_NUM} THEN 'a score is not a number'
  WHEN TRY_CAST(json_extract_string(j, '$.scores.pose.score') AS DOUBLE) NOT BETWEEN 0 AND 10 THEN 'a score is out of range'
  WHEN trim(json_extract_string(j, '$.scores.pose.reason')) = '' THEN 'a score lacks its reason' END AS error FROM p""")
def assessment_validation(spark: SparkSession, d: str) -> DataFrame:
    """D15 I3 J.5."""
    _, error = assessment.validate(F.col("text"), ["expression", "pose"])
    return X.assessments(spark, d).select("vec_id", error.alias("error"))


@query(f"""WITH {X.PHOTOS} SELECT count(*) AS supported_images, count(error) AS read_errors,
  count(*) FILTER (error IS NULL AND face_count > 0 AND similarity >= 0.45) AS identity_matches FROM photos""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """F13 D1 D4 A7."""
    return inventory.coverage(X.photos(spark, d), 0.45)


@query("SELECT vec_id, CASE WHEN regexp_matches(c, '^[-=+@]') THEN '''' || c ELSE c END AS cell FROM (SELECT vec_id, ['=', '+', '-', '@', 'x', ' ='][vec_id % 6 + 1] || CAST(vec_id AS VARCHAR) AS c FROM embeddings)")
def csv_guard(spark: SparkSession, d: str) -> DataFrame:
    """B6 J.2."""
    start = F.element_at(F.array(*[F.lit(s) for s in ("=", "+", "-", "@", "x", " =")]), (F.col("vec_id") % 6 + 1).cast("int"))
    rows = X.table(spark, d, "embeddings").select("vec_id", F.concat(start, F.col("vec_id").cast("string")).alias("c"))
    return rows.select("vec_id", T.guarded(F.col("c")).alias("cell"))


_WIDE = ", ".join(
    f"sum(score) FILTER (name = '{n}') AS {n}_score, CASE WHEN vec_id % 6 < 4 THEN '''' ELSE '' END || ['=', '+', '-', '@', 'x', ' ='][vec_id % 6 + 1] || '{n}' AS {n}_reason"
    for n in X.WEIGHTS
)
_EMPTY = {k: f"CAST(NULL AS VARCHAR) AS {k}" for k in ("score", "rank", "similarity", "date", "date_source", "duplicate_of", "diversity_of")}


@query(f"""WITH {X.PATHS}, {X.SCORES}, w AS (SELECT vec_id, {_WIDE} FROM long_scores GROUP BY vec_id)
SELECT path, 'eligible' AS status, 'other' AS category, 'said' AS summary, '' AS exclusion_reason, {', '.join(_EMPTY.values())}, w.* EXCLUDE (vec_id) FROM w JOIN paths USING (vec_id)""")
def all_scores_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide report, a score and a guarded reason for each criterion."""
    start = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "x", " =")]), (F.col("vec_id") % 6 + 1).cast("int"))
    told = F.transform_values("scores", lambda n, v: F.struct(v.alias("score"), F.concat(F.col("start"), n).alias("reason")))
    said = F.struct(F.lit("other").alias("category"), F.lit("said").alias("summary"), F.lit("").alias("exclusion_reason"), told.alias("scores"))
    rows = X.items(spark, d).withColumn("start", start).select("path", F.lit("eligible").alias("status"), said.alias("assessment"))
    return sinks.wide(rows, list(X.WEIGHTS))


_PIXELS = "list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 1000) AS BIGINT) % 256)"
_AROUND = " + ".join(
    f"g[(7 - abs(7 - abs({line}))) * 8 + 7 - abs(7 - abs({column})) + 1]"
    for line, column in (("i // 8 - 1", "i % 8"), ("i // 8 + 1", "i % 8"), ("i // 8", "i % 8 - 1"), ("i // 8", "i % 8 + 1"))
)


@query(f"""WITH p AS (SELECT vec_id, {_PIXELS} AS g FROM embeddings)
SELECT vec_id, round(list_var_pop(list_transform(range(0, 64), lambda i: CAST({_AROUND} - 4 * g[i + 1] AS DOUBLE))), 6) AS blur, round(list_avg(g), 6) AS brightness FROM p""")
def face_sharpness(spark: SparkSession, d: str) -> DataFrame:
    """Blur and brightness of squares of gray values."""
    gray = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    rows = X.table(spark, d, "embeddings").select("vec_id", detection.sharpness(gray, 8).alias("s"))
    return rows.select("vec_id", F.round("s.blur", 6).alias("blur"), F.round("s.brightness", 6).alias("brightness"))


@query("""WITH p AS (SELECT doc_id, ['', 'b/', 'a/', 'a/z/', 'a.b/'][doc_id % 5 + 1] AS folder, 'f' || CAST(doc_id * 7919 % 100003 AS VARCHAR) AS name FROM documents)
SELECT doc_id, '/r/' || folder || name AS path, row_number() OVER (ORDER BY CASE folder WHEN '' THEN 0 WHEN 'a/' THEN 1 WHEN 'a/z/' THEN 2 WHEN 'a.b/' THEN 3 ELSE 4 END, name, doc_id) AS place FROM p""")
def traversal_order(spark: SparkSession, d: str) -> DataFrame:
    """Files as the folder tree is walked, those of a folder before the folders below it."""
    folder = F.element_at(F.array(*[F.lit(x) for x in ("", "b/", "a/", "a/z/", "a.b/")]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("f"), (F.col("doc_id") * 7919 % 100003).cast("string"))
    rows = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/r/"), folder, name).alias("path"))
    return selection.numbered(rows, T.traversal(F.col("path")), F.col("doc_id")).select("doc_id", "path", F.col("rank_no").alias("place"))


@query(f"""WITH RECURSIVE {X.BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, box_id) AS n FROM boxes WHERE conf >= 0.5),
walk AS (SELECT DISTINCT image_id, 0::BIGINT AS n, CAST([] AS STRUCT(box_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM o
  UNION ALL SELECT o.image_id, o.n, CASE WHEN len(list_filter(w.kept, lambda k:
    greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)) /
    ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1))) >= 0.4)) = 0
    THEN list_append(w.kept, {{'box_id': o.box_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE w.kept END
  FROM walk w JOIN o ON o.image_id = w.image_id AND o.n = w.n + 1),
last AS (SELECT image_id, arg_max(kept, n) AS kept FROM walk GROUP BY image_id)
SELECT image_id, k.box_id FROM (SELECT image_id, unnest(kept) AS k FROM last)""")
def nms(spark: SparkSession, d: str) -> DataFrame:
    """E9 D11."""
    return detection.suppress(X.boxes(spark, d)).select("image_id", "box_id")


@query(f"""WITH {X.BOXES}, c AS (SELECT box_id, conf, greatest(0, x1 - 20) AS x, greatest(0, y1 - 20) AS y, least(60, x2 - 20) AS r, least(50, y2 - 20) AS b FROM boxes)
SELECT box_id, least(r - x, b - y) AS face_pixels, (r - x) * (b - y) / 3000 AS face_fraction FROM c WHERE r > x AND b > y AND conf >= 0.5""")
def face_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clamped to an image of 60 x 50, and their measures."""
    w, h = F.lit(60), F.lit(50)
    corners = [F.col(c) - 20 for c in ("x1", "y1", "x2", "y2")]
    rows = X.boxes(spark, d).withColumn("box", detection.clamp(*corners, w, h)).where(detection.usable(F.col("box"), F.col("conf")))
    pixels, fraction = detection.measures(F.col("box"), w, h)
    return rows.select("box_id", pixels.alias("face_pixels"), fraction.alias("face_fraction"))


@query("""SELECT vec_id, round(s, 9) AS scale FROM (SELECT vec_id, unnest(list_distinct([least(1.0::DOUBLE, 640.0::DOUBLE / (400 + vec_id * 31 % 3000)), least(1.0::DOUBLE, 1280.0::DOUBLE / (400 + vec_id * 31 % 3000))])) AS s FROM embeddings)""")
def detection_scales(spark: SparkSession, d: str) -> DataFrame:
    """C7."""
    longest = 400 + F.col("vec_id") * 31 % 3000
    return X.table(spark, d, "embeddings").select("vec_id", F.explode(detection.scales(longest, F.lit(300), 1280)).alias("s")).select("vec_id", F.round("s", 9).alias("scale"))


@query(f"WITH {_FACE.replace('f.vec_id >= 5 AND r.vec_id < 5', 'f.vec_id < 0')}, u AS {_UNIT} SELECT vec_id, round({_DOT.format('u', 'u')}, 6) AS length FROM u")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector at length one."""
    rows = X.table(spark, d, "embeddings").select("vec_id", checked_unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("length"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
