import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions.vectors import checked_unit, from_hex16, hamming, hex16, top_two_mean, unit
from curatrix.operators import assessment, detection, identity, inventory, selection

ITEM = "path string, score double, sha256 string, phash bigint, width bigint, height bigint, day date, category string"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def item(path, score, sha=None, phash=0, width=100, height=100, day=None, category="portrait"):
    return (path, score, sha or path, signed(phash), width, height, day, category)


def greedy(rows, radius):
    """Plain model of the dedupe rule."""
    kept, out = [], {}
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        same = [k for k in kept if k[2] == r[2]]
        near = [k for k in kept if radius >= 0 and ((k[3] ^ r[3]) & (1 << 64) - 1).bit_count() <= radius and abs((r[4] / r[5]) / (k[4] / k[5]) - 1) < 0.1]
        owner = (same or near or [None])[0]
        out[r[0]] = owner and owner[0]
        if owner is None:
            kept.append(r)
    return out


@pytest.mark.parametrize("radius", [-1, 0, 6, 20])
def test_dedupe_against_model(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randrange(9)):
            h ^= 1 << rng.randrange(64)
        rows.append(item(f"p{i:03d}", round(rng.uniform(0, 10), 1), f"s{rng.randrange(90)}", h, rng.choice([100, 105, 150])))
    got = {r["path"]: r["duplicate_of"] for r in selection.dedupe(spark.createDataFrame(rows, ITEM), radius).collect()}
    assert got == greedy(rows, radius)


def test_chain_keeps_both_ends(spark):
    rows = [item("a", 9.0, phash=0b0), item("b", 8.0, phash=0b111), item("c", 7.0, phash=0b111111)]
    got = {r["path"]: (r["kept"], r["duplicate_of"]) for r in selection.dedupe(spark.createDataFrame(rows, ITEM), 3).collect()}
    assert got == {"a": (True, None), "b": (False, "a"), "c": (True, None)}


def chosen(spark, rows, top, cap=0, distance=0, bonus=0.0, **kw):
    got = selection.diversify(spark.createDataFrame(rows, ITEM), top, bonus, cap, distance, **kw).collect()
    return {r["path"]: (r["status"], r["rank"], r["diversity_of"]) for r in got}


def test_day_limit_and_unknown_days(spark):
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    rows = [item("best", 9.0, day=one), item("same", 8.9, day=one), item("other", 8.0, day=two), item("u1", 7.0), item("u2", 6.9)]
    got = chosen(spark, rows, 4, cap=1)
    assert got["same"] == ("day_limit", None, None)
    assert [p for p, (s, *_) in sorted(got.items(), key=lambda x: x[1][1] or 9) if s == "recommended"] == ["best", "other", "u1", "u2"]


def test_visual_variety_on_and_off(spark):
    rows = [item("a", 9.0, phash=0), item("b", 8.0, phash=0xFF), item("c", 7.0, phash=(1 << 64) - 1)]
    assert chosen(spark, rows, 3, distance=12)["b"] == ("visual_similarity", None, "a")
    assert all(s == "recommended" for s, *_ in chosen(spark, rows, 3).values())


def test_bonus_spreads_categories_and_small_chunks_agree(spark):
    rng = random.Random(3)
    days = [date(2024, 1, d) for d in range(1, 4)]
    rows = [item(f"p{i:02d}", round(rng.uniform(5, 9), 2), phash=rng.getrandbits(64), day=rng.choice([None, *days]), category=rng.choice("xyz")) for i in range(60)]
    whole = chosen(spark, rows, 20, cap=2, distance=28, bonus=1.0)
    assert whole == chosen(spark, rows, 20, cap=2, distance=28, bonus=1.0, chunk=3)
    assert sum(s == "recommended" for s, *_ in whole.values()) <= 20


def test_identity(spark):
    faces = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 1, [2.0, 0.0])], "photo_id bigint, face_pos int, embedding array<float>")
    refs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "ref_id bigint, embedding array<float>")
    got = {(r["photo_id"]): (r["best_pos"], r["similarity"]) for r in identity.best_face(identity.score(faces, refs)).collect()}
    assert got == {1: (1, 1.0), 2: (0, 1.0)}  # the target is second; equal faces give the first
    one = spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("s"))
    assert one.select(top_two_mean("s"), top_two_mean(F.array(F.lit(0.3)))).first()[:] == (0.5, 0.3)


def test_enrolment_rules(spark):
    schema = "path string, sha256 string, faces array<struct<face_pixels:double,embedding:array<double>>>"
    good, tilted = (90.0, [1.0, 0.0]), (90.0, [0.9, 0.1])
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert identity.enrolled(frame(("a", "1", [good]), ("b", "2", [tilted])), False).count() == 2
    assert identity.enrolled(frame(("a", "1", [good]), ("b", "2", [tilted]), ("c", "3", [])), True).count() == 2
    for wrong, skip in [
        (frame(("a", "1", [good])), True), (frame(("a", "1", [good]), ("b", "2", [tilted]), ("c", "3", [])), False), (frame(("a", "1", [good]), ("b", "2", [(10.0, [1.0, 0.0])])), True),
        (frame(("a", "1", [good]), ("b", "1", [tilted])), True), (frame(("a", "1", [good]), ("b", "2", [(90.0, [0.0, 1.0])])), True),
    ]:
        with pytest.raises(ValueError):
            identity.enrolled(wrong, skip)


def test_vectors(spark):
    row = spark.range(1).select(from_hex16(F.lit("ffffffffffffffff")).alias("h"), unit(F.array(F.lit(0.0))).alias("u"))
    assert row.select("h", "u", hex16(F.col("h")), hamming(F.col("h"), F.lit(0).cast("bigint"))).first()[:] == (-1, None, "f" * 16, 64)
    with pytest.raises(Exception, match="usable length"):
        spark.range(1).select(checked_unit(F.array(F.lit(0.0)))).collect()


@pytest.mark.parametrize("path,day", [
    ("a/20240115_x.jpg", date(2024, 1, 15)), ("2024-01_15.jpg", date(2024, 1, 15)), ("2024-02-30 2024-03-01.jpg", None), ("120240115.jpg", None), ("2024/01/15.jpg", None), ("18991231.jpg", None), ("", None),
])
def test_dates_in_paths(spark, path, day):
    found, source = T.capture_date(F.lit("bad exif"), F.lit(path))
    assert spark.range(1).select(found, source).first()[:] == (day, "filename/folder" if day else "unknown")


def test_exif_wins(spark):
    found, source = T.capture_date(F.lit("2023:05:06 07:08:09"), F.lit("20240101.jpg"))
    assert spark.range(1).select(found, source).first()[:] == (date(2023, 5, 6), "EXIF")


def test_status_order(spark):
    rows = spark.createDataFrame([(True, date(2020, 1, 1), 1.0), (False, date(2020, 1, 1), 1.0), (False, None, 1.0), (False, None, 7.0)], "e boolean, d date, s double")
    got = [r[0] for r in rows.select(selection.status(F.col("e"), F.col("d"), F.col("s"), 6.0, date(2021, 1, 1))).collect()]
    assert got == ["visual_exclusion", "date_exclusion", "below_minimum_score", "eligible"]


def test_validation_names_the_broken_rule(spark):
    from curatrix.plans.fixtures import ASSESSMENTS

    broken = [*ASSESSMENTS, ASSESSMENTS[0].replace("7", "NaN", 1), ASSESSMENTS[0].replace('"s"', '"' + "x" * 4001 + '"'), ASSESSMENTS[0].replace('"r"', '"' + "x" * 2001 + '"', 1)]
    rows = spark.createDataFrame(list(enumerate(broken)), "k int, t string")
    valid, error = assessment.validate(F.col("t"), ["expression", "pose"])
    got = rows.select("k", valid.alias("ok"), error.alias("e")).orderBy("k").collect()
    assert [r["ok"] for r in got] == [True] + [False] * (len(broken) - 1)
    assert got[0]["e"] is None and got[-2]["e"] == "an explanation is too long" and got[-1]["e"] == "a score lacks its reason"


class _Moody:
    """Fails on one key, breaks a rule on another."""

    def assess(self, item):
        if item["key"] == "fails":
            raise OSError("no answer")
        score = 11 if item["key"] == "wrong" else 5
        return {"excluded": False, "exclusion_reason": "", "category": "other", "summary": "s", "scores": {"pose": {"score": score, "reason": "r"}}}


def test_attempts_keep_what_works(spark):
    rows = spark.createDataFrame([("fails",), ("wrong",), ("fine",)], "key string")
    got = {r["key"]: r for r in assessment.attempt(rows, _Moody, ["pose"]).collect()}
    assert got["fine"]["problem"] is None and '"score": 5' in got["fine"]["result"]
    assert got["fails"]["problem"] == "no answer" and got["wrong"]["problem"] == "a score is out of range" and got["wrong"]["result"] is None


def test_vectors_are_bound_once(spark):
    """The plan names a vector's length once, however many elements it divides."""
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None]


def _items(spark, rows):
    return spark.createDataFrame(rows, "path string, score double, sha256 string, phash bigint, width bigint, height bigint")


def _greedy(rows, radius):
    kept, out = [], {}
    for path, _, sha, h, w, height in sorted(rows, key=lambda r: (-r[1], r[0])):
        same = next((k[0] for k in kept if sha is not None and k[2] == sha), None)
        near = None
        if h is not None:
            near = next((k[0] for k in kept if k[3] is not None and (((k[3] ^ h) & (1 << 64) - 1).bit_count() <= radius) and abs((w / height) / (k[4] / k[5]) - 1) < 0.1), None)
        out[path] = same or near
        if out[path] is None:
            kept.append((path, _, sha, h, w, height))
    return out


@pytest.mark.parametrize("radius", [-1, 0, 5, 9, 20])
def test_dedupe_is_the_greedy_walk(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(160):
        h = base[i % 12] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(6)))
        rows.append((f"p{i:03}", float(rng.randrange(20)), rng.choice([None, "a", "b", *[f"s{i}"] * 6]), None if i % 40 == 7 else h, rng.choice([100, 105, 150]), 100))
    got = {r["path"]: r for r in selection.dedupe(_items(spark, rows), radius).collect()}
    wanted = _greedy(rows, radius)
    assert {k: r["duplicate_of"] for k, r in got.items()} == wanted
    assert all(r["kept"] == (wanted[k] is None) for k, r in got.items())


def test_dedupe_settles_a_long_chain(spark):
    rows = [(f"p{i:02}", 1.0, f"s{i}", (1 << i) - 1, 100, 100) for i in range(14)]  # each one bit from the next
    got = {r["path"]: r["kept"] for r in selection.dedupe(_items(spark, rows), 1).collect()}
    assert got == {f"p{i:02}": i % 2 == 0 for i in range(14)}


def test_copies_make_no_pairs(spark):
    rows = [(f"p{i:04}", 1.0, "same", 5, 100, 100) for i in range(2_000)]
    got = selection.dedupe(_items(spark, rows), 6)
    assert got.where("kept").count() == 1 and got.where("duplicate_of = 'p0000'").count() == 1_999


def test_inventory(spark):
    stored = spark.createDataFrame([("a", 1, 1, "c", None), ("b", 1, 1, "c", None), ("e", 1, 1, "c", "bad"), ("g", 1, 1, "c", None), ("o", 1, 1, "old", None)], "path string, size bigint, mtime_ns bigint, config string, error string")
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("e", 1, 1), ("n", 1, 1), ("o", 1, 1)], "path string, size bigint, mtime_ns bigint")
    diff = {r["path"]: r["change"] for r in inventory.difference(listing, stored, "c").collect()}
    assert diff == {"a": "unchanged", "b": "changed", "e": "retry", "g": "vanished", "n": "new", "o": "changed"}
    assert [r["path"] for r in inventory.pending(listing, stored, "c").orderBy("path").collect()] == ["b", "e", "n", "o"]
    with pytest.raises(ValueError, match="3 files"):
        inventory.require_scanned(listing, stored, "c")
    assert inventory.same_snapshot(listing, listing).first()["equal"]


def test_suppression_keeps_the_surest(spark):
    rows = [(1, 1, 0.8, 200.0, 200.0, 400.0, 400.0), (1, 2, 0.9, 201.0, 200.0, 400.0, 400.0), (1, 3, 0.7, 0.0, 0.0, 50.0, 50.0), (1, 4, 0.3, 0.0, 0.0, 50.0, 50.0)]
    got = detection.suppress(spark.createDataFrame(rows, "image_id bigint, box_id bigint, conf double, x1 double, y1 double, x2 double, y2 double"))
    assert sorted(r["box_id"] for r in got.collect()) == [2, 3]


def test_formula_guard(spark):
    cells = ["=1", "+x", "-y", "@z", "plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(T.guarded(F.col("c"))).collect()]
    assert got == ["'=1", "'+x", "'-y", "'@z", "plain", "", None]


@pytest.fixture
def written(monkeypatch):
    """The frames that selection writes out from here on."""
    frames = []

    def cut(df, instead=None, f=selection.cut):
        out = f(df, instead)
        frames.append(df)
        df.pairs = out.count() if df.columns == ["a", "b"] else 0
        return out

    monkeypatch.setattr(selection, "cut", cut)
    return frames


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _looks_apart(n, bits=63):
    rng = random.Random(n)
    return [(f"p{i:04}", float(rng.randrange(50)), f"s{i}", rng.getrandbits(bits), rng.choice([100, 130, 160]), 100) for i in range(n)]


def test_dedupe_gathers_no_enumerated_quarters(spark, written):  # F1
    rows = _looks_apart(200, 24)
    got = {r["path"]: r["duplicate_of"] for r in selection.dedupe(_items(spark, rows), 11).collect()}
    assert got == _greedy(rows, 11)
    assert not any("Generate" in _plan(df) for df in written)


def _all_pairs(df):
    return any(x in _plan(df) for x in ("NestedLoopJoin", "CartesianProduct"))


@pytest.mark.parametrize("radius", [5, 11, 19])
def test_near_pairs_meet_in_blocks_and_out_of_the_driver(spark, radius):  # F2, F3
    rows = _looks_apart(150, 20)
    got = selection.near_pairs(selection.ranked(_items(spark, rows)), radius)
    plan = _plan(got)
    assert not _all_pairs(got) and ("Generate" in plan) == (radius < 8)
    assert radius >= 8 or "BroadcastHashJoin" not in plan  # nor are the rows of the quarters gathered in the driver
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    wanted = {(x[0], y[0]) for i, x in enumerate(order) for y in order[i + 1:] if (x[3] ^ y[3]).bit_count() <= radius and abs((y[4] / y[5]) / (x[4] / x[5]) - 1) < 0.1}
    assert {(r["a"], r["b"]) for r in got.collect()} == wanted


def test_dedupe_of_many_alike_makes_few_pairs(spark, written, monkeypatch):  # F4, F5, F6, F7
    for name, value in (("STRETCH", 32), ("BLOCK", 16)):
        monkeypatch.setattr(selection, name, value, raising=False)
    rows = [(p, s, sha, (0b1111 << 40 | i) if i % 2 else h, w, height) for i, (p, s, sha, h, w, height) in enumerate(_looks_apart(300))]
    got = {r["path"]: r["duplicate_of"] for r in selection.dedupe(_items(spark, rows), 19).collect()}
    assert got == _greedy(rows, 19)
    assert not any(map(_all_pairs, written))
    assert sum(df.pairs for df in written) < 5_000  # the 150 that look alike make 7,500 pairs and more
