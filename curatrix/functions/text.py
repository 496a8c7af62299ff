"""Paths, dates and cells of text."""

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The image name endings that count, and the characters by which
# a spreadsheet takes a cell for a formula.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp", "heic", "heif", "avif")
FORMULA_STARTS = "=+-@"

# Fixed value: a date of the years 1900-2099 that no other digit touches; the first one counts.
_DATE = r"(?<![0-9])((?:19|20)[0-9]{2})[-_]?([01][0-9])[-_]?([0-3][0-9])(?![0-9])"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root``; unchanged where it is not below it."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def traversal(path: Column) -> Column:
    """A key that sorts paths as a folder tree is walked: a folder's files by name, then the folders below by name."""
    folders, name = F.regexp_extract(path, "^(.*/)?([^/]*)$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    return F.concat(F.regexp_replace(folders, "([^/]*)/", "1$1\u0001"), F.lit("0"), name)


def date_in_path(path: Column) -> Column:
    """The date that the path's first date-like digits name; null if there is no such day."""
    parts = [F.regexp_extract(path, _DATE, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def exif_date(value: Column) -> Column:
    """The day of an EXIF time such as ``2024:03:01 12:00:00``; null if it is none."""
    return F.try_to_date(F.replace(F.substring(value, 1, 10), F.lit(":"), F.lit("-")), "yyyy-MM-dd")


def capture_date(exif: Column, path: Column) -> tuple[Column, Column]:
    """Day of capture and what tells it: EXIF first, then the path, never the file's own times."""
    told, named = exif_date(exif), date_in_path(path)
    source = F.when(told.isNotNull(), "EXIF").when(named.isNotNull(), "filename/folder").otherwise("unknown")
    return F.coalesce(told, named), source


def guarded(cell: Column) -> Column:
    """A text cell that no spreadsheet takes for a formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def fingerprint(value) -> str:
    """SHA-256 of a value's canonical JSON, on the driver."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_key(sha256: Column, box: Column, signature: Column) -> Column:
    """The key under which an assessment is kept: content, place in it and rubric."""
    return F.sha2(F.to_json(F.struct(sha256.alias("sha"), box.alias("box"), signature.alias("signature"))), 256)
