"""Scalar functions as Column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unquoted(c: Column | str, sign: str = '"') -> Column:
    """Without this sign at both ends."""
    return F.regexp_replace(col(c), f"^{sign}+|{sign}+$", "")


def without_zeros(c: Column | str) -> Column:
    """A number string without leading zeros."""
    return F.regexp_replace(col(c), "^0+", "")


def basket_key(date: Column | str, customer: Column | str) -> Column:
    """M/D/YYYY and a customer as M/D/YY-customer."""
    parts = F.split(col(date), "/")
    return F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"), F.right(parts[2], F.lit(2)), F.lit("-"), col(customer).cast("string"))


def days_since(date: Column | str, as_of: Column | str) -> Column:
    """Whole days from a date to a given day; the day is a parameter, so that results repeat."""
    return F.datediff(F.to_date(as_of if isinstance(as_of, Column) else F.lit(as_of)), F.to_date(col(date)))


def list_length(c: Column | str, nothing: str = "None") -> Column:
    """Entries of a comma string; the word for none, empty and null count 0."""
    c = col(c)
    return F.when(c.isNull() | (c == nothing) | (c == ""), 0).otherwise(F.size(F.split(c, ",")))


def comma_list(c: Column | str) -> Column:
    """A comma string as an array, entries as they are; null gives an empty array."""
    return F.coalesce(F.split(col(c), ","), F.array().cast("array<string>"))


def map_sum(c: Column | str) -> Column:
    """The sum of a map's values; null and empty give 0."""
    return F.coalesce(F.aggregate(F.map_values(col(c)), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0))), F.lit(0).cast("long"))


def affine(x: Column | str, a: int, b: int, m: int) -> Column:
    return F.pmod(col(x) * F.lit(a).cast("long") + F.lit(b).cast("long"), F.lit(m).cast("long"))


def text_mod(c: Column | str, m: int) -> Column:
    """The UTF-8 bytes of a string as one big number modulo m, by Horner's rule; 0 for the empty string."""
    digits = F.hex(F.encode(col(c), "UTF-8"))
    steps = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    fold = F.aggregate(steps, F.lit(0).cast("long"), lambda h, i: F.pmod(h * 256 + F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long"), F.lit(m).cast("long")))
    return F.when(F.length(digits) == 0, F.lit(0).cast("long")).otherwise(fold)


def trailing_zeros(h: Column | str) -> Column:
    """Zero bits at the end of h; 1 for 0, whose binary form is a single zero."""
    h = col(h).cast("long")
    return F.when(h == 0, 1).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(col(a), col(b)))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / both)


def cosine2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Cosine of two two-dimensional vectors; 0 where one is zero."""
    size = F.sqrt(x1 * x1 + y1 * y1) * F.sqrt(x2 * x2 + y2 * y2)
    return F.when(size == 0, 0.0).otherwise((x1 * x2 + y1 * y2) / size)


def blend(rating: Column, parts: list[tuple[float, Column]], weight: float) -> Column:
    """A weighted sum of similarities; it takes the other sign where the rating similarity is 0 or less."""
    total = sum((F.lit(w) * c for w, c in parts), F.lit(weight) * F.abs(rating))
    return F.when(rating <= 0, -total).otherwise(total)


def clipped(c: Column | str, low: float = 1.0, high: float = 5.0) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def quantized(c: Column | str) -> Column:
    """1 to 5 by the steps -3, -1, 1 and 3; a value on a step belongs above it."""
    c = col(c)
    return F.when(c < -3, 1).when(c < -1, 2).when(c < 1, 3).when(c < 3, 4).otherwise(5)


def mahalanobis(x: Column, mean: Column, std: Column, floor: float = 1e-9) -> Column:
    """With a diagonal covariance; standard deviations are at least `floor`."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), std, lambda d, s: d / F.greatest(s, F.lit(floor)))
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v))


def spread(n: Column, total: Column, squares: Column) -> Column:
    """Standard deviations from a count, sums and sums of squares."""
    return F.zip_with(squares, total, lambda q, s: F.sqrt(F.greatest(q / n - F.pow(s / n, F.lit(2.0)), F.lit(0.0))))


def vote(x: Column, y: Column, z: Column) -> Column:
    """The second of three predictions, clipped; rounded where all three round alike (halves to even) and two of them lie near that number, within 0.1, 0.2 and 0.1."""
    near = lambda c, within: (F.abs(c - F.bround(c)) <= within).cast("int")
    alike = (F.bround(x) == F.bround(y)) & (F.bround(z) == F.bround(y))
    agreed = alike & (near(x, 0.1) + near(y, 0.2) + near(z, 0.1) >= 2)
    return clipped(F.when(agreed, F.bround(y)).otherwise(y))


def weighted(w: Column | float, a: Column, b: Column) -> Column:
    w = w if isinstance(w, Column) else F.lit(w)
    return w * a + (1 - w) * b
