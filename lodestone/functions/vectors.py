"""Vector functions as column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import bound, col


def dot(a: Column | str, b: Column | str, size: int | None = None) -> Column:
    """Inner product. size: a known length unrolls the sum, which then stays in generated code."""
    a, b = col(a), col(b)
    if size:
        terms = [F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(size)]
        while len(terms) > 1:
            terms = [reduce(lambda x, y: x + y, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return terms[0]
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(col(a), lambda v: bound(norm(v), lambda n: scaled(v, n)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def last_attended(states: Column | str, mask: Column | str) -> Column:
    """The state at the last position whose mask is 1; null if there is none."""
    places = F.filter(F.transform(col(mask), lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    return F.get(col(states), F.array_max(places))


def bucket_numbers(v: Column | str, cutoffs: Column | str) -> Column:
    """For each component, how many cutoffs are below it."""
    return F.transform(col(v), lambda x: F.size(F.filter(col(cutoffs), lambda c: c < x)))


def packed_bits(numbers: Column | str, bits: int) -> Column:
    """Numbers of so many bits each, lowest bit first, packed eight to a byte with the first bit highest, as hexadecimal text."""
    flat = F.flatten(F.transform(col(numbers), lambda n: F.array(*[F.pmod(F.shiftright(n.cast("int"), i), F.lit(2)) for i in range(bits)])))
    starts = lambda f: F.sequence(F.lit(0), F.size(f).cast("int") - 8, F.lit(8))
    byte = lambda f, s: sum((F.element_at(f, s + 1 + i) * (1 << (7 - i)) for i in range(1, 8)), F.element_at(f, s + 1) * 128)
    return F.array_join(bound(flat, lambda f: F.transform(starts(f), lambda s: F.lpad(F.lower(F.hex(byte(f, s))), 2, "0"))), "")


def unpacked_bits(text: Column | str, bits: int) -> Column:
    """The numbers that packed_bits packed."""
    values = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1, F.lit(2)), lambda i: F.conv(F.substr(x, i, F.lit(2)), 16, 10).cast("int"))
    flat = F.flatten(F.transform(bound(col(text), values), lambda b: F.array(*[F.pmod(F.shiftright(b, 7 - i), F.lit(2)) for i in range(8)])))
    starts = lambda f: F.sequence(F.lit(1), F.size(f).cast("int") - bits + 1, F.lit(bits))
    number = lambda f, s: sum((F.element_at(f, s + i) * (1 << i) for i in range(1, bits)), F.element_at(f, s))
    return bound(flat, lambda f: F.transform(starts(f), lambda s: number(f, s)))
