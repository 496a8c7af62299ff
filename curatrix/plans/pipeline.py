"""The whole run over a folder: enrol, scan, assess, select, report.

Face detection and assessment are plug-ins: objects made once in each task.
"""

import fcntl
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.config import Config
from curatrix.functions import text as T
from curatrix.operators import assessment, identity, inventory, selection
from curatrix.sources import sinks
from curatrix.sources.images import decode_png, encode_png, face_quality, fitted, phash, read_image, taken
from curatrix.sources.library import read_library
from curatrix.sources.tables import BatchedTable, VersionedTable, cut

PHOTOS = (
    "path string, size bigint, mtime_ns bigint, config string, error string, sha256 string, phash bigint, width bigint, height bigint, "
    "taken string, faces array<struct<box:array<double>,embedding:array<double>,face_pixels:double,face_fraction:double,blur:double,brightness:double>>"
)
ASSESSED = "key string, result string"
#: Unreadable files listed in run.json itself; the folder errors beside it has every one.
LISTED_ERRORS = 1000
#: Fixed value: the most width and height of a chosen picture in the report.
THUMB = (1200, 1000)
REFERENCES = "path string, sha256 string, embedding array<double>"


class Detector(Protocol):
    """Made once in a task; finds faces as dictionaries with box (x, y, width, height) and embedding, and face_pixels if that is not the box's shorter side."""

    def faces(self, pixels) -> list[dict]: ...


class ProjectError(ValueError):
    pass


def check_folders(state: Path, sources: list[str]) -> Path:
    """The state folder: private, without links, and apart from the sources, those of earlier runs as well.

    Where the state is mounted from elsewhere, $CURATRIX_STATE_HOST names its other place.
    """
    state = state.expanduser()
    if state.is_symlink():
        raise ProjectError("the state folder must not be a link")
    state = state.resolve()
    listed = state / "sources.json"
    known = set(json.loads(listed.read_text())) if listed.exists() else set()
    places = [state, *(Path(p).resolve() for p in [os.environ.get("CURATRIX_STATE_HOST")] if p)]
    for place in places:
        for source in map(Path, {*sources, *known}):
            if place == source or place in source.parents or source in place.parents:
                raise ProjectError("state and source folders must not contain each other")
    if any(p.is_symlink() for p in state.rglob("*")):
        raise ProjectError("the state folder must not hold links")
    state.mkdir(parents=True, exist_ok=True, mode=0o700)
    if not known.issuperset(sources):
        sinks.write_json(listed, sorted({*sources, *known}))
    return state


def unchanged(path: str, size: int, mtime_ns: int, library: str) -> bool:
    """Whether a file is still the one scanned, no link, and inside the library."""
    at = Path(path)
    if at.is_symlink() or not at.resolve().is_relative_to(library) or not at.exists():
        return False
    stat = at.stat()
    return (stat.st_size, stat.st_mtime_ns) == (size, mtime_ns)


@contextmanager
def exclusive(state: Path) -> Iterator[None]:
    """One run at a time for a state folder; the lock goes with its process."""
    with open(state / ".lock", "a") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as error:
            raise ProjectError("another run is using this state folder") from error
        yield


class Project:
    """The stored state of one pair of folders, and the steps over it."""

    def __init__(
        self, spark: SparkSession, config: Config, state: str | Path, detector: Callable[[], Detector] | None = None, assessor: Callable | None = None,
        revision: str = "1", decoder: Callable[[bytes], np.ndarray] = decode_png,
    ):
        self.spark, self.config, self.revision = spark, config, revision
        self.detector, self.assessor, self.decoder = detector, assessor, decoder
        self.state = check_folders(Path(state), [config.library, config.references])
        self.folder = check_folders(self.state / config.project, [config.library, config.references])
        self.photos = BatchedTable(spark, self.folder / "photos", PHOTOS, "path")
        self.assessed = BatchedTable(spark, self.folder / "assessed", ASSESSED, "key")
        self.references = VersionedTable(spark, self.folder / "references", REFERENCES)

    def _identity(self) -> dict:
        at = self.folder / "identity.json"
        return json.loads(at.read_text()) if at.exists() else {}

    def _scan_config(self) -> str:
        return self.config.scan_signature(self._identity()["digest"], self.revision)

    def _read(self, files: DataFrame, config: str) -> DataFrame:
        """Decode, hash and find faces, one detector a task."""
        if self.detector is None:
            raise ProjectError("a detector is needed to read pictures")
        make, decode = self.detector, self.decoder

        def measured(pixels: np.ndarray, face: dict) -> dict:
            box = tuple(map(float, face["box"]))
            blur, brightness = face_quality(pixels, box)
            return dict(
                box=list(box), embedding=list(map(float, face["embedding"])), face_pixels=float(face.get("face_pixels", min(box[2:]))),
                face_fraction=box[2] * box[3] / (pixels.shape[0] * pixels.shape[1]), blur=blur, brightness=brightness,
            )

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = make()
            for frame in frames:
                rows = []
                for path, size, mtime in zip(frame["path"], frame["size"], frame["mtime_ns"]):
                    row = dict(path=path, size=size, mtime_ns=mtime, config=config, error=None, sha256=None, phash=None, width=None, height=None, taken=None, faces=None)
                    try:
                        data = Path(path).read_bytes()
                        pixels = read_image(data, decode)
                        h = phash(pixels)
                        faces = [measured(pixels, f) for f in found.faces(pixels)]
                        stat = Path(path).stat()
                        if (stat.st_size, stat.st_mtime_ns) != (size, mtime):
                            raise ValueError("the file changed while it was read")
                        row |= dict(sha256=hashlib.sha256(data).hexdigest(), phash=h - (1 << 64) if h >> 63 else h, width=pixels.shape[1], height=pixels.shape[0], taken=taken(data), faces=faces)
                    except Exception as error:  # any unreadable file is a row with an error
                        row["error"] = str(error) or type(error).__name__
                    rows.append(row)
                yield pd.DataFrame(rows).astype({"phash": "Int64", "width": "Int64", "height": "Int64"})

        return files.select("path", "size", "mtime_ns").mapInPandas(run, PHOTOS)

    def _rounds(self, rows: DataFrame, key: str, batch: int) -> Iterator[DataFrame]:
        """``rows`` in parts of about ``batch`` for each task that can run at once."""
        n, width = rows.count(), self.spark.sparkContext.defaultParallelism
        rounds = -(-n // (batch * width))
        for k in range(rounds):
            part = rows.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == k) if rounds > 1 else rows
            yield part.repartition(min(width, n))

    def _reference_digest(self) -> str:
        files = read_library(self.spark, self.config.references).select("path").collect()  # enrolled by hand, so few
        return T.fingerprint([(r["path"], hashlib.sha256(Path(r["path"]).read_bytes()).hexdigest()) for r in files])

    def enroll(self) -> None:
        """Read the references and keep those that can be used; a failure changes nothing."""
        digest = self._reference_digest()
        found = cut(self._read(read_library(self.spark, self.config.references), "references").select("path", "sha256", "faces"))
        kept = identity.enrolled(found, self.config.recognition.skip_invalid_references)
        self.references.replace(kept.select("path", "sha256", "embedding"))
        sinks.write_json(self.folder / "identity.json", {
            "input": digest, "revision": self.revision, "excluded": found.count() - self.references.read().count(),
            "digest": T.fingerprint([(r["path"], r["sha256"]) for r in self.references.read().orderBy("path").collect()]),
        })

    def scan(self, limit: int | None = None, batch: int = 256) -> dict:
        """Bring the stored rows up to the folder; returns how many were read.

        Files are read in rounds of about ``batch`` for each task at once, and each
        round is stored as it ends: a scan that is broken off goes on from there.
        """
        held = self.folder / "library.json"
        if held.exists() and json.loads(held.read_text())["source"] != self.config.library:
            raise ProjectError("this state belongs to another library")
        config, listing = self._scan_config(), cut(read_library(self.spark, self.config.library))
        total = listing.count()
        sinks.write_json(held, {"source": self.config.library, "config": config, "supported_files": total, "identity_digest": self._identity()["digest"]})
        gone = inventory.vanished(listing, self.photos.read()).count()
        if gone:
            self.photos.keep(listing.select("path"))
        work = cut(inventory.pending(listing, self.photos.read(), config, limit))
        for part in self._rounds(work, "path", batch):
            self.photos.add(self._read(part, config))
        self.photos.compact()
        read = self.photos.read().join(work.select("path"), "path", "left_semi")
        n, bad = read.count(), read.where("error IS NOT NULL").count()
        return {"processed": n, "cached": total - n, "errors": bad, "total": total, "vanished": gone}

    def candidates(self) -> tuple[DataFrame, dict]:
        """Matching photos with their best face, and what the scan covered."""
        config, listing = self._scan_config(), read_library(self.spark, self.config.library)
        photos = self.photos.read()
        inventory.require_scanned(listing, photos, config)
        photos = photos.join(listing.select("path"), "path", "left_semi")
        refs = self.references.read().select(F.col("path").alias("ref_id"), "embedding")
        faces = photos.where("error IS NULL").select(F.col("path").alias("photo_id"), F.posexplode("faces").alias("face_pos", "face"))
        scored = identity.score(faces.select("photo_id", "face_pos", "face", F.col("face.embedding").alias("embedding")), refs)
        best = identity.with_best_face(photos.withColumnRenamed("path", "photo_id"), scored).withColumnRenamed("photo_id", "path")
        day, source = T.capture_date(F.col("taken"), T.relative(F.col("path"), F.lit(self.config.library)))
        seen = inventory.coverage(best, self.config.recognition.threshold).first().asDict()
        match = (F.col("face_count") > 0) & (F.col("similarity") >= self.config.recognition.threshold) & F.col("error").isNull()
        rows = best.where(match).withColumns({"day": day, "date_source": source, "box": F.get("faces", F.col("best_pos").cast("int"))["box"]})
        return rows.drop("faces"), seen

    def rank(self, batch: int = 16) -> Path:
        """Assess what is new, in stored rounds, then select and report."""
        self._require_identity()
        criteria = list(self.config.criteria)
        items = cut(assessment.keyed(self.candidates()[0], self.config.signature(self.revision)))
        _, misses = assessment.split(items, self.assessed.read())
        for part in self._rounds(cut(assessment.once(misses)), "key", batch):
            self._assess(part, criteria)
        self.assessed.compact()
        done, _ = assessment.split(items, self.assessed.read())
        again, coverage = self.candidates()
        if not inventory.same_snapshot(again, done).first()["equal"]:
            raise ProjectError("the library changed during assessment; run again, assessments are kept")
        parsed = done.withColumn("a", F.from_json("result", _result_type()))
        parsed = parsed.withColumns({"excluded": F.col("a.excluded"), "category": F.col("a.category"), "scores": F.transform_values("a.scores", lambda _, v: v["score"])})
        weights = {k: c.weight for k, c in self.config.criteria.items()}
        chosen = cut(selection.select(parsed, weights, self.config.selection))
        return self._report(chosen, criteria, coverage)

    def _assess(self, items: DataFrame, criteria: list[str], attempts: int = 2, pause: float = 1.0) -> None:
        """Store the assessments of ``items``; those that fail are tried again, the others are kept."""
        if self.assessor is None:
            raise ProjectError("an assessor is needed for new pictures")
        library = self.config.library
        same = F.udf(lambda path, size, mtime_ns: unchanged(path, size, mtime_ns, library), "boolean")  # one look at the file system a row

        def refuse_changed() -> None:
            other = items.where(~same("path", "size", "mtime_ns")).select("path").first()
            if other is not None:
                raise ProjectError(f"a source changed, scan again: {other['path']}")

        refuse_changed()
        for k in range(attempts):
            tried = cut(assessment.attempt(items, self.assessor, criteria))
            refuse_changed()
            self.assessed.add(tried.where("problem IS NULL").select("key", "result"))
            failed = tried.where("problem IS NOT NULL")
            one = failed.select("problem").first()
            if one is None:
                return
            items = items.join(failed.select("key"), "key", "left_semi")
            if k < attempts - 1:
                time.sleep(pause)
        raise RuntimeError(f"{failed.count()} pictures could not be assessed, one of them as {one['problem']}; finished assessments are kept")

    def _require_identity(self) -> None:
        held = self._identity()
        if not held:
            raise ProjectError("nothing is enrolled; run the whole pipeline")
        if held["input"] != self._reference_digest() or held["revision"] != self.revision:
            raise ProjectError("the references changed; run the whole pipeline")

    def _report(self, chosen: DataFrame, criteria: list[str], coverage: dict) -> Path:
        out, top = sinks.new_run(self.folder), self.config.selection.top
        rows = chosen.withColumns({"assessment": F.col("a"), "date": F.col("day").cast("string")})
        sinks.write_csv(rows, criteria, str(out / "all-scores"))
        picked = rows.where("status = 'recommended'").orderBy("rank").limit(top)
        best = [r.asDict(True) for r in picked.select("path", "size", "mtime_ns", "rank", "score", "selection_score", "similarity", "date", "date_source", "category", "a").collect()]
        for item in best:
            item |= {"summary": item["a"]["summary"], "scores": item.pop("a")["scores"]}
        thumbs = self._thumbs(best, out)
        variety = selection.variety(chosen).first().asDict() | {"max_per_day": self.config.selection.max_per_day, "min_visual_distance": self.config.selection.min_visual_distance}
        unread = self.photos.read().where("error IS NOT NULL").select("path", "error")
        unread.write.mode("errorifexists").json(str(out / "errors"))  # all of them; the report lists the first
        errors = [r.asDict() for r in unread.orderBy("path").limit(LISTED_ERRORS).collect()]
        sinks.write_json(out / "run.json", {
            "config": self.config.to_dict(), "coverage": coverage | {"errors": errors, "errors_listed": len(errors), "all_errors": str(out / "errors")}, "assessment_signature": self.config.signature(self.revision),
            "requested": top, "recommended": len(best), "diversity": variety, "note": "Scores are a model's opinion by the configured rubric.",
        })
        sinks.write_json(out / "recommendations.json", best)
        (out / "index.html").write_text(sinks.page(best, coverage, variety, top, thumbs=thumbs))
        sinks.publish(self.folder, out, len(best), top)
        return out

    def _thumbs(self, best: list[dict], out: Path) -> dict[int, str]:
        """Small pictures of the chosen files, which must still be those scanned; at most as many as may be requested."""
        names = {}
        (out / "thumbs").mkdir(mode=0o700)
        for item in best:
            if not unchanged(item["path"], item["size"], item["mtime_ns"], self.config.library):
                raise ProjectError(f"a chosen source changed, run again: {item['path']}")
            names[item["rank"]] = f"thumbs/{item['rank']:02d}.png"
            small = fitted(read_image(Path(item["path"]).read_bytes(), self.decoder), *THUMB)
            (out / names[item["rank"]]).write_bytes(encode_png(small))
        return names

    def run(self, scan_only: bool = False) -> Path | None:
        with exclusive(self.state):
            held = self._identity()
            strict = held.get("excluded") and not self.config.recognition.skip_invalid_references
            if strict or held.get("input") != self._reference_digest() or held.get("revision") != self.revision:
                self.enroll()
            self.scan()
            return None if scan_only else self.rank()


def _result_type() -> str:
    return "excluded boolean, exclusion_reason string, category string, summary string, scores map<string, struct<score:double,reason:string>>"
