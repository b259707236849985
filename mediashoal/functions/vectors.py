"""Dense vectors and perceptual hashes as columns, without Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0, null where sizes differ."""
    both = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0)))


def cosine_to(v: Column, query: list[float]) -> Column:
    """To a constant vector, whose norm is taken once."""
    length = sum(float(x) * float(x) for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    own = norm(v)
    score = F.when((own > 0) & F.lit(length > 0), dot(v, q) / (own * F.lit(length))).otherwise(F.lit(0.0))
    return F.when(F.size(v) == len(query), score)


def cosine_f32(a: Column, b: Column) -> Column:
    """In single precision, adding up in index order."""
    zero = F.lit(0).cast("float")
    add = lambda s, x: (s + x).cast("float")
    mul = F.zip_with(a, b, lambda x, y: (x * y).cast("float"))
    length = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: (x * x).cast("float")), zero, add)).cast("float")
    both = (length(a) * length(b)).cast("float")
    return F.when(both > 0, (F.aggregate(mul, zero, add) / both).cast("float")).otherwise(zero)


def l2_normalize(v: Column) -> Column:
    """Rows of norm zero stay."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


#: A text that is one list without lists in it, and nothing else.
_LIST = r"\A[ \t\r\n]*\[[^\[\]]*\][ \t\r\n]*\z"


def legacy_vector(text: Column) -> Column:
    """A vector stored as JSON text; null if the text goes on after the list, which
    ``from_json`` would not look at."""
    return F.from_json(F.when(text.rlike(_LIST), text), "array<float>")


def _float_of_bits(bits: Column) -> Column:
    """The single-precision number of a 32-bit pattern (a bigint from 0)."""
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    normal = (1 + fraction / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
    small = fraction * F.lit(2.0**-149)
    odd = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exponent == 255, odd).when(exponent == 0, small).otherwise(normal)).cast("float")


def little_endian_vector(blob: Column) -> Column:
    """Little-endian single-precision numbers as an array; null if four bytes don't go in evenly."""
    digits = F.hex(blob)

    def number(k: Column) -> Column:
        pairs = [F.substring(digits, k * 8 + 1 + 2 * j, F.lit(2)) for j in (3, 2, 1, 0)]
        return _float_of_bits(F.conv(F.concat(*pairs), 16, 10).cast("bigint"))

    n = (F.length(blob) / 4).cast("int")
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), number)).otherwise(F.array().cast("array<float>"))
    return F.when(F.length(blob) % 4 == 0, made)


def parse_blob(blob: Column) -> Column:
    """A stored vector: a JSON list if it begins with a bracket or four bytes don't go in
    evenly, else little-endian single-precision numbers, which is also what bytes are that
    only begin like a list, or with one. Text that is no list gives null."""
    text = blob.cast("string")
    numbers = little_endian_vector(blob)
    return F.when((F.substring(text, 1, 1) == "[") | (F.length(blob) % 4 != 0), F.coalesce(legacy_vector(text), numbers)).otherwise(numbers)


def vector_blob(v: Column) -> Column:
    """The little-endian bytes of an array of single-precision numbers (zeros keep their
    sign, not-a-numbers are one)."""

    def bits(x: Column) -> Column:
        x = x.cast("double")
        size = F.abs(x)
        negative = (x < 0) | (x.cast("string") == "-0.0")
        exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(-126)).cast("int")
        # the logarithm may round up to the next power of two
        exponent = F.when((size < F.pow(F.lit(2.0), exponent.cast("double"))) & (exponent > -126), exponent - 1).otherwise(exponent)
        scaled = (size * F.pow(F.lit(2.0), (23 - exponent).cast("double"))).cast("bigint")
        finite = F.when(scaled >= 1 << 23, (exponent + 127).cast("bigint") * (1 << 23) + scaled - (1 << 23)).otherwise(scaled)
        pattern = F.when(F.isnan(x), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).otherwise(finite).cast("bigint")
        return pattern + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0)).cast("bigint")

    def text(x: Column) -> Column:
        digits = F.lpad(F.hex(bits(x)), 8, "0")
        return F.concat(*[F.substring(digits, 2 * j + 1, 2) for j in (3, 2, 1, 0)])

    return F.unhex(F.array_join(F.transform(v, text), ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of up to 64 bits; null if either is none."""
    ok = a.rlike("^[0-9a-fA-F]{1,16}$") & b.rlike("^[0-9a-fA-F]{1,16}$")
    value = lambda c: F.conv(c, 16, -10).cast("bigint")
    return F.when(ok, F.bit_count(value(F.when(ok, a)).bitwiseXOR(value(F.when(ok, b)))))
