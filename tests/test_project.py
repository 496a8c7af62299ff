import json
import os
import struct
import sys
import zlib
from functools import partial

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from curatrix.config import parse
from curatrix.plans import pipeline
from curatrix.plans.pipeline import Project, ProjectError, exclusive
from curatrix.sources import assessor, images
from curatrix.sources.library import read_library
from curatrix.sources.tables import BatchedTable
from curatrix.streaming import snapshots

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def png(pixels: np.ndarray, exif: bytes = b"") -> bytes:
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed: int, exif: bytes = b"") -> bytes:
    return png(np.random.default_rng(seed).integers(0, 256, (40, 48, 3)), exif)


def taken_exif(text: bytes) -> bytes:
    """A TIFF block whose EXIF directory names a time of capture."""
    first = struct.pack("<HHHIII", 1, images.TAG_EXIF, 4, 1, 26, 0)
    return b"II*\0" + struct.pack("<I", 8) + first + struct.pack("<HHHIII", 1, images.TAG_TAKEN, 2, len(text) + 1, 44, 0) + text + b"\0"


class Faces:
    """Every picture shows one face whose vector follows its corner."""

    def faces(self, pixels):
        x = float(pixels[0, 0, 0]) / 2550
        return [{"box": [1.0, 2.0, 30.0, 30.0], "embedding": [1.0, x], "face_pixels": 90.0}]


class Rubric:
    def __init__(self, calls="/dev/null"):
        self.calls = calls

    def assess(self, item):
        with open(self.calls, "a") as calls:
            calls.write(item["path"] + "\n")
        score = int(item["sha256"][:4], 16) / 65535 * 10
        return {"excluded": False, "exclusion_reason": "", "category": "portrait", "summary": "=s", "scores": {"pose": {"score": score, "reason": "r"}, "light": {"score": 5, "reason": "r"}}}


@pytest.fixture
def project(spark, tmp_path):
    library, references = tmp_path / "library", tmp_path / "references"
    (library / "sub").mkdir(parents=True)
    references.mkdir()
    for i in range(3):
        (library / f"IMG_2024010{i + 1}.png").write_bytes(picture(i))
        (references / f"r{i}.png").write_bytes(picture(10 + i))
    (library / "sub" / "copy.PNG").write_bytes(picture(0))
    (library / "broken.png").write_bytes(b"no picture")
    (library / "notes.txt").write_text("x")
    os.symlink(library / "broken.png", library / "link.png")
    calls = tmp_path / "calls"
    calls.touch()
    raw = {
        "paths": {"library": str(library), "references": str(references)},
        "recognition": {"threshold": 0.45, "max_side": 640, "threads": 1, "skip_invalid_references": False},
        "selection": {"top": 3, "minimum_score": 0, "near_duplicate_distance": 6, "diversity_bonus": 0.5, "not_before": "", "max_per_day": 1, "min_visual_distance": 0},
        "vision": {"image_size": 336, "timeout_seconds": 10, "exclude": []},
        "criteria": {"pose": {"weight": 2.0, "description": "p"}, "light": {"weight": 1.0, "description": "l"}},
    }

    def make(**changes):
        for path, value in changes.items():
            section, key = path.split("__")
            raw[section][key] = value
        return Project(spark, parse(raw, tmp_path), tmp_path / "state", Faces, partial(Rubric, str(calls)))

    make.library, make.references, make.calls, make.state = library, references, lambda: calls.read_text().splitlines(), tmp_path / "state"
    return make


def test_run_rerank_and_drift(project):
    out = project().run()
    run = json.loads((out / "run.json").read_text())
    assert run["coverage"]["supported_images"] == 5 and run["coverage"]["read_errors"] == 1 and run["coverage"]["identity_matches"] == 4
    best = json.loads((out / "recommendations.json").read_text())
    assert [b["rank"] for b in best] == [1, 2, 3] and run["recommended"] == 3
    assert len(project.calls()) == 3  # the copy is assessed with its original
    csv = b"".join(p.read_bytes() for p in (out / "all-scores").glob("*.csv")).decode()
    assert "'=s" in csv and "pose_score" in csv and "duplicate" in csv
    assert json.loads((project.state / project().config.project / "latest.json").read_text())["output"] == str(out)

    project(criteria__pose={"weight": 9.0, "description": "p"}).rank()
    assert len(project.calls()) == 3  # weights need no new assessments
    project(criteria__pose={"weight": 9.0, "description": "new words"}).rank()
    assert len(project.calls()) == 6
    (project.library / "new.png").write_bytes(picture(77))
    with pytest.raises(ValueError, match="1 files"):
        project().rank()
    (project.references / "r9.png").write_bytes(picture(99))
    with pytest.raises(ProjectError, match="references changed"):
        project().rank()


def test_every_unreadable_file_is_reported(project, monkeypatch):
    monkeypatch.setattr("curatrix.plans.pipeline.LISTED_ERRORS", 1)
    for i in range(3):
        (project.library / f"bad{i}.png").write_bytes(b"no picture")
    out = project().run()
    run = json.loads((out / "run.json").read_text())["coverage"]
    rows = [json.loads(line) for p in (out / "errors").glob("*.json") for line in p.read_text().splitlines()]
    assert {r["path"] for r in rows} == {str(project.library / n) for n in ("broken.png", "bad0.png", "bad1.png", "bad2.png")} and all(r["error"] for r in rows)
    assert run["read_errors"] == 4 and run["errors_listed"] == len(run["errors"]) == 1 and run["all_errors"] == str(out / "errors")


def test_scan_is_incremental(project):
    p = project()
    p.enroll()
    assert p.scan() == {"processed": 5, "cached": 0, "errors": 1, "total": 5, "vanished": 0}
    assert p.scan() == {"processed": 1, "cached": 4, "errors": 1, "total": 5, "vanished": 0}  # errors are tried again
    (project.library / "sub" / "copy.PNG").unlink()
    assert p.scan()["vanished"] == 1
    assert p.photos.read().count() == 4


def test_failed_enrolment_changes_nothing(project):
    p = project()
    p.enroll()
    before = p._identity()
    (project.references / "bad.png").write_bytes(b"x")
    with pytest.raises(ValueError):
        p.enroll()
    assert p._identity() == before


def test_folders_and_lock(project, tmp_path):
    p = project()
    with pytest.raises(ProjectError):
        Project(p.spark, p.config, project.library / "state", Faces, Rubric)
    with exclusive(p.state), pytest.raises(ProjectError), exclusive(p.state):
        pass


def test_library_listing(spark, project):
    rows = [r["path"].removeprefix(str(project.library)) for r in read_library(spark, str(project.library)).collect()]
    assert rows == ["/IMG_20240101.png", "/IMG_20240102.png", "/IMG_20240103.png", "/broken.png", "/sub/copy.PNG"]
    with pytest.raises(Exception, match="not a folder"):
        read_library(spark, str(project.library / "nowhere")).collect()


def test_pictures(spark):
    pixels = np.random.default_rng(1).integers(0, 256, (40, 48, 3)).astype(np.uint8)
    assert (images.decode_png(png(pixels)) == pixels).all()
    assert images.taken(png(pixels, taken_exif(b"2023:05:06 07:08:09"))) == "2023:05:06 07:08:09"
    flat = images.phash(np.full((50, 50, 3), 7))
    tiles = np.kron(np.random.default_rng(2).integers(30, 220, (8, 8)), np.ones((8, 8)))[:, :, None].repeat(3, axis=2)
    assert images.phash(tiles) & 1 == 0 and flat & 1 == 0
    assert (images.phash(tiles) ^ images.phash(tiles + 4)).bit_count() <= 6
    got = {r["path"]: r for r in images.hashed(spark.createDataFrame([("a", png(pixels)), ("b", b"x")], "path string, content binary")).collect()}
    assert got["a"]["width"] == 48 and got["a"]["error"] is None and got["b"]["error"]
    turned = images.upright(pixels, 6)
    assert turned.shape[:2] == (48, 40) and (turned[0, -1] == pixels[0, 0]).all()


def test_snapshots_stream(spark, tmp_path):
    listings, stored, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    write = lambda n, rows, of=None: spark.createDataFrame([(n, of or len(rows), *r) for r in rows], snapshots.SCHEMA).coalesce(1).write.mode("append").parquet(listings)
    write(1, [("a", 1, 1), ("b", 1, 1)])
    snapshots.follow(spark, listings, stored, mark, "c").awaitTermination()
    write(2, [("b", 2, 1), ("d", 1, 1)])
    snapshots.follow(spark, listings, stored, mark, "c").awaitTermination()
    table = lambda: sorted((r["path"], r["size"]) for r in snapshots.VersionedTable(spark, stored + "/inventory", snapshots.STORED).read().where(F.col("config") == "c").collect())
    assert table() == [("b", 2), ("d", 1)]
    write(4, [("b", 3, 1)], of=2)  # half of a snapshot, and an older one
    write(1, [("z", 9, 9)])
    snapshots.follow(spark, listings, stored, mark, "c").awaitTermination()
    assert table() == [("b", 2), ("d", 1)]
    write(4, [("e", 1, 1)], of=2)
    snapshots.follow(spark, listings, stored, mark, "c").awaitTermination()
    assert table() == [("b", 3), ("e", 1)]


class Stops:
    """Finds faces until a file says stop, then ends its worker's task."""

    def __init__(self, flag):
        self.flag = flag

    def faces(self, pixels):
        if os.path.exists(self.flag):
            raise SystemExit("stopped")
        return Faces().faces(pixels)


def test_a_stopped_scan_goes_on(project, tmp_path):
    p, flag = project(), tmp_path / "stop"
    p.enroll()
    p.detector = partial(Stops, str(flag))
    listing = read_library(p.spark, str(project.library)).where("path NOT LIKE '%broken%'")
    assert sum(x.count() for x in p._rounds(listing, "path", 1)) == 4
    p.photos.add(p._read(listing.limit(2), p._scan_config()))
    done = p.photos.read().count()
    flag.touch()
    with pytest.raises(Exception):
        p.scan(batch=1)
    assert p.photos.read().count() >= done == 2
    flag.unlink()
    again = p.scan(batch=1)
    assert again["processed"] == 3 and p.photos.read().count() == 5


def test_batches_replace_by_key(spark, tmp_path):
    table = BatchedTable(spark, tmp_path / "t", "key string, result string", "key")
    row = lambda *r: spark.createDataFrame(list(r), "key string, result string")
    assert table.read().count() == 0
    table.add(row(("a", "1"), ("b", "1")))
    table.add(row(("a", "2")))
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("b", "1")]
    table.compact(1)
    assert len(table._batches()) == 1 and sorted(map(tuple, table.read().collect())) == [("a", "2"), ("b", "1")]
    table.keep(spark.createDataFrame([("b",)], "key string"))
    assert table.read().count() == 1


class Shy(Rubric):
    """Fails on the first try of each picture."""

    def assess(self, item):
        first = item["path"] not in open(self.calls).read()
        out = super().assess(item)
        if first:
            raise ValueError("try again")
        return out


def test_assessments_are_tried_again(project):
    p = project()
    p.enroll()
    p.scan()
    p.assessor = partial(Shy, p.assessor.args[0])
    assert (p.rank() / "index.html").exists() and len(project.calls()) == 6


def test_report_page_and_thumbnails(project):
    out = project().run()
    page = (out / "index.html").read_text()
    assert page.count("<img") == 3 and "thumbs/01.png" in page and "<details>" in page and "file://" in page and "(filename/folder)" in page
    assert images.decode_png((out / "thumbs" / "01.png").read_bytes()).shape == (40, 48, 3)
    faces = project().photos.read().where("error IS NULL").select(F.explode("faces").alias("f")).select("f.*").collect()
    assert all(f["blur"] > 0 and 0 < f["brightness"] < 255 and f["face_fraction"] == pytest.approx(900 / (40 * 48)) for f in faces)


def test_guards(project, tmp_path):
    p = project()
    p.enroll()
    p.scan()
    held = p.folder / "library.json"
    told = json.loads(held.read_text())
    held.write_text(json.dumps(told | {"source": "/elsewhere"}))
    with pytest.raises(ProjectError, match="another library"):
        p.scan()
    held.write_text(json.dumps(told))
    os.symlink(tmp_path, p.folder / "link")
    with pytest.raises(ProjectError, match="links"):
        project()
    os.remove(p.folder / "link")
    assert pipeline.unchanged(str(project.library / "sub" / "copy.PNG"), *_version(project.library / "sub" / "copy.PNG"), str(project.library))
    assert not pipeline.unchanged(str(project.library / "link.png"), 10, 1, str(project.library))
    assert not pipeline.unchanged(str(project.references / "r0.png"), *_version(project.references / "r0.png"), str(project.library))
    with pytest.raises(ProjectError):  # a source of an earlier run
        pipeline.check_folders(p.state, [str(p.state / "inner")])


def _version(path):
    return path.stat().st_size, path.stat().st_mtime_ns


def test_other_decoders(project):
    (project.library / "text.jpg").write_bytes(b"seven")
    p = project()
    p.decoder = _seven
    p.enroll()
    assert p.scan()["errors"] == 1  # the broken file alone
    assert p.photos.read().where("path LIKE '%text.jpg'").first()["width"] == 20


def _seven(data):
    return np.full((20, 20, 3), 7, dtype=np.uint8) if data == b"seven" else images.decode_png(data)


def test_http_assessor(project, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    asked, answer = [], {"excluded": False, "exclusion_reason": "", "category": "other", "summary": "s", "scores": {}}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            short = body["max_tokens"] == assessor.BUDGETS[0]
            reply = json.dumps({"choices": [{"finish_reason": "length" if short else "stop", "message": {"content": json.dumps(answer)}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    config = project().config
    client = assessor.HttpAssessor(f"http://127.0.0.1:{server.server_port}", config)
    assert client.assess({"path": str(project.library / "IMG_20240101.png"), "box": [1.0, 2.0, 30.0, 30.0]}) == answer
    server.shutdown()
    assert [b["max_tokens"] for b in asked] == list(assessor.BUDGETS[:2])
    said = asked[0]["messages"][1]["content"]
    assert "pose: p" in said[0]["text"] and [c["type"] for c in said] == ["text", "image_url", "image_url"]
    assert asked[0]["response_format"]["schema"]["properties"]["scores"]["required"] == ["pose", "light"]
    assert "maxLength" in json.dumps(asked[1]) and "maxLength" not in json.dumps(asked[0])
    with pytest.raises(ValueError, match="this machine"):
        assessor.HttpAssessor("http://example.com", config)


def _filtered(pixels, kinds, step):
    lines, out, above = pixels.reshape(len(pixels), -1).astype(int), b"", None
    above = np.zeros(lines.shape[1], dtype=int)
    for line, kind in zip(lines, kinds):
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        near = [abs(left + above - corner - v) for v in (left, above, corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], above, corner))
        out += bytes([kind]) + ((line - [0 * left, left, above, (left + above) // 2, paeth][kind]) & 255).astype(np.uint8).tobytes()
        above = line
    return out


def _png(width, height, depth, colour, raw, interlaced=0, palette=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    header = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    return images.PNG + header + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_every_kind_of_png():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (21, 17, 3)).astype(np.uint8)
    assert (images.decode_png(_png(17, 21, 8, 2, _filtered(pixels, [i % 5 for i in range(21)], 3))) == pixels).all()
    passes = [pixels[a::c, b::d] for a, b, c, d in images.PASSES]
    raw = b"".join(_filtered(p, [(i * 3) % 5 for i in range(len(p))], 3) for p in passes if p.size)
    assert (images.decode_png(_png(17, 21, 8, 2, raw, 1)) == pixels).all()
    numbers, palette = rng.integers(0, 4, (9, 10)), rng.integers(0, 256, (4, 3)).astype(np.uint8)
    packed = np.packbits(np.stack([numbers >> 1, numbers & 1], -1).reshape(9, -1).astype(np.uint8), axis=1)
    assert (images.decode_png(_png(10, 9, 2, 3, _filtered(packed, [0] * 9, 1), 0, palette.tobytes())) == palette[numbers]).all()
    wide = rng.integers(0, 65536, (5, 6)).astype(">u2")
    assert (images.decode_png(_png(6, 5, 16, 0, _filtered(wide.view(np.uint8).reshape(5, -1), [4] * 5, 2))) == (wide >> 8)[:, :, None]).all()
    assert (images.decode_png(images.encode_png(pixels)) == pixels).all()
    assert images.fitted(pixels, 10, 10).shape == (10, 8, 3) and images.fitted(pixels, 50, 50) is pixels
    framed = images.outlined(pixels, (2, 3, 8, 9), (0, 170, 255))
    assert (framed[3, 2:11] == (0, 170, 255)).all() and (framed[6, 6] == pixels[6, 6]).all() and (framed[0] == pixels[0]).all()
    flat = images.face_quality(np.full((30, 30, 3), 100, dtype=np.uint8), (0, 0, 30, 30))
    assert flat == (0.0, 100.0)
