"""Vectors and 64-bit hashes as native expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector shorter than this cannot be brought to unit length.
LEAST_NORM = 1e-8


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """The inner product, in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` at length one, in double; null if its length is not finite or nearly nought."""

    def scaled(x: Column) -> Column:
        length = x["length"]
        usable = (length >= LEAST_NORM) & (length < F.lit(float("inf"))) & ~F.isnan(length)
        return F.when(usable, F.transform(x["v"], lambda e: e.cast("double") / length))

    return bound(v, lambda x: bound(F.struct(x.alias("v"), norm(x).alias("length")), scaled))


def checked_unit(v: Column) -> Column:
    """As ``unit``, but an unusable vector ends the query."""
    return F.coalesce(unit(v), F.raise_error(F.lit("a vector has no usable length")).cast("array<double>"))


def top_two_mean(scores: Column) -> Column:
    """The mean of the two greatest values; of one value, itself; of none, null."""
    mean = lambda best: F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(best), F.lit(0))
    return bound(F.slice(F.sort_array(scores, asc=False), 1, 2), mean)


def median_bits(values: Column, dims: int = 64) -> Column:
    """A 64-bit hash: bit i is set where value i exceeds the median of all but the first.

    Bit 0 stays clear. The unsigned hash is carried in a signed bigint.
    """

    def hashed(x: Column) -> Column:
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        bits = F.transform(x["v"], lambda e, i: F.when((i > 0) & (e > x["middle"]), F.call_function("shiftleft", one, i)).otherwise(none))
        return F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))

    def with_middle(v: Column) -> Column:
        return F.struct(v.alias("v"), F.element_at(F.sort_array(F.slice(v, 2, dims - 1)), dims // 2).alias("middle"))

    return bound(values, lambda v: bound(with_middle(v), hashed))


def hex16(h: Column) -> Column:
    """A hash as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def from_hex16(text: Column) -> Column:
    """The signed bigint with the bits of 16 hexadecimal digits."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
