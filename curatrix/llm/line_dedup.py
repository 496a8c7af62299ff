"""Line dedup (2): overlapping three-line windows, by DataFrame functions alone.

Lines are compared without the spaces round them. Every run of ``WINDOW``
consecutive lines is hashed to 128 bits; a window that occurs again, in the same
text or another, is a repeat. The first occurrence, by id and then position,
stays; the lines that later occurrences cover are merged and removed, and the
remaining lines keep their order and their spaces.

What travels is one narrow row a window, summed up before the shuffle; texts
travel once, to meet the positions found in them. The join back to the windows
is by hash with nothing above it that needs a hash's rows together, so a window
that a third of all texts share is split by the adaptive join.

Defined cases: a null text stays null. A text of fewer lines than a window has
none and stays. A window of blank lines is none. A text whose lines are all
removed becomes empty; its row stays. Rows of equal id and text count as one
place, so all of them keep a first occurrence. A null id comes first, as the least
id there is. Other
columns pass unread, whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import col, fresh

WINDOW = 3
_NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, size: int) -> Column:
    """Array of (at, a, b, n): position, 128-bit hash and length of each window that is not blank."""

    def window(at: Column) -> Column:
        own = [F.get(lines, at + F.lit(j)) for j in range(size)]
        return F.struct(at.alias("at"), F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("b"), *own).alias("b"), F.length(F.concat(*own)).alias("n"))

    found = F.transform(F.sequence(F.lit(0), F.size(lines) - F.lit(size)), window)
    return F.filter(F.when(F.size(lines) >= size, found), lambda w: w["n"] > 0)


def repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, digest, at): the positions of the later occurrences in each text.

    ``key`` is the id, the least value standing for null; ``digest`` a hash of
    the text, so that different texts of one id stay apart.
    """
    text = col(text_col).cast("string")
    rows = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(_NO_ID)).alias("key"), text.alias("text")).where("text IS NOT NULL")
    rows = rows.select("key", F.xxhash64("text").alias("digest"), F.transform(_lines(F.col("text")), lambda x: F.trim(x)).alias("lines"))
    places = rows.select("key", "digest", F.explode(_windows(F.col("lines"), size)).alias("w")).select("key", "digest", "w.at", "w.a", "w.b")
    first = places.groupBy("a", "b").agg(F.min(F.struct("key", "digest", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("a", "b", "first")
    later = places.join(first, ["a", "b"]).where(F.struct("key", "digest", "at") != F.col("first"))
    return later.select("key", "digest", "at")


def deduplicate(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column, Column]:
    """``docs`` with the remaining text, and the columns that count its lines and those removed."""
    key, digest, at, lines, removed = fresh(docs, "key", "digest", "at", "lines", "removed")
    found = repeats(docs, size, id_col, text_col).groupBy("key", "digest").agg(F.collect_set("at").alias("at")).toDF(key, digest, at)
    text = col(text_col).cast("string")
    keyed = docs.withColumns({key: F.coalesce(col(id_col).cast("long"), F.lit(_NO_ID)), digest: F.xxhash64(text)})
    joined = keyed.join(found, [key, digest], "left")
    covered = F.array_distinct(F.flatten(F.transform(F.col(at), lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: p + j))))
    joined = joined.withColumn(lines, _lines(text)).withColumn(removed, covered)
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.col(lines)) - 1), F.col(removed))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    total = F.when(text.isNotNull(), F.size(F.col(lines)).cast("long")).otherwise(F.lit(0).cast("long"))
    gone = F.coalesce(F.size(F.col(removed)).cast("long"), F.lit(0).cast("long"))
    out = joined.withColumns({lines: total, removed: F.when(F.col(removed).isNotNull(), gone).otherwise(F.lit(0).cast("long")), text_col: F.when(F.col(removed).isNull(), text).otherwise(rest)})
    return out.select(*[col(c) for c in docs.columns], F.col(lines), F.col(removed)), F.col(lines), F.col(removed)
