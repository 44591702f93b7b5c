"""Vector, bit and statistics column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def js_round(value: Column, digits: int = 0) -> Column:
    """Round halves up, towards plus infinity for negatives too."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda v: F.when(n == 0, F.lit(0.0)).otherwise(v.cast("double") / n))


def safe_cosine(a: Column, b: Column) -> Column:
    """Cosine, null for unknown, empty, zero, non-finite or differently long vectors."""
    bad = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & ~bad(a) & ~bad(b)
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def weighted_concat(parts: list[tuple[Column, float]]) -> Column:
    """Join vectors scaled by the square root of their weights, then unit length."""

    def scaled(vector: Column, weight: float) -> Column:
        return F.transform(vector, lambda x: x.cast("double") * math.sqrt(weight))

    return unit(F.concat(*[scaled(v, w) for v, w in parts]))


def blend_similarity(lexical: Column, semantic: Column) -> Column:
    """Mean of both where the semantic one is known, else the lexical one."""
    known = semantic.isNotNull() & ~F.isnan(semantic)
    return F.when(known, (lexical + F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic))) / 2).otherwise(lexical)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_bits(hex16: Column) -> Column:
    """16 hex digits as a signed 64-bit number, bits kept."""
    return F.shiftleft(F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(
        F.conv(F.substring(hex16, 9, 8), 16, 10).cast("long")
    )


def erf(x: Column) -> Column:
    """Error function by the five-term polynomial of Abramowitz and Stegun 7.1.26."""
    p, (a1, a2, a3, a4, a5) = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))


def t975(df: Column) -> Column:
    """97.5 % quantile of Student's t by the Cornish-Fisher expansion."""
    z = 1.959964
    d = F.greatest(F.lit(1.0), df.cast("double"))
    return z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d)


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the known parts only; null where none is known."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    return F.try_divide(value, total)


def ladder(value: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """First label whose inclusive lower bound is reached."""
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return F.when(value.isNotNull(), out.otherwise(lowest))


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number, null unless all four parts are 0-255."""
    octets = F.transform(F.split(F.trim(ip), r"\."), lambda p: p.try_cast("long"))
    shaped = F.trim(ip).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(octets, lambda o: o.between(0, 255))
    return F.when(shaped, F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o))


def ipv6_hex(ip: Column) -> Column:
    """IPv6 address as 32 hex digits, so that ranges compare as text; null when malformed."""
    text = F.lower(F.trim(ip))
    sides = F.split(text, "::")
    group = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = group(F.get(sides, F.lit(0))), group(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
    compressed = F.size(sides) == 2
    shaped = text.rlike("^[0-9a-f:]+$") & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    fits = F.when(compressed, missing >= 1).otherwise(missing == 0)
    return F.when(text.contains(":") & shaped & fits & (F.size(sides) <= 2) & (F.size(full) == 8), digits)


def address_bits(ip: Column) -> Column:
    """An IPv4 address as text of 32 bits, an IPv6 address as text of 128; null when malformed."""
    nibbles = F.transform(F.split(ipv6_hex(ip), ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
    return F.coalesce(F.lpad(F.bin(ipv4_number(ip)), 32, "0"), F.array_join(nibbles, ""))
