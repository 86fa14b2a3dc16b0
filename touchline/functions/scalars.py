"""Small column functions: rounding, signs, clocks, identities, float bits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIE = 1e-12
LENGTH_GUARD = 1e-9
LATERAL_DEGREES = 10.0


def rounded(value: Column, digits: int = 6) -> Column:
    """Round and clear negative zero, for outputs that other engines repeat."""
    return F.round(value, digits) + F.lit(0.0)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def three_way_sign(value: Column) -> Column:
    """negative / zero / positive with a dead band of 1e-12."""
    return (
        F.when(~is_finite(value), F.lit(None).cast("string"))
        .when(value < -TIE, "negative")
        .when(value > TIE, "positive")
        .otherwise("zero")
    )


def pass_direction(length: Column, dx: Column) -> Column:
    bound = F.sin(F.radians(F.lit(LATERAL_DEGREES)))
    ratio = dx / length
    return (
        F.when(length <= LENGTH_GUARD, "degenerate")
        .when(ratio > bound, "forward")
        .when(ratio < -bound, "backward")
        .otherwise("approximately_lateral")
    )


def bin_label(value: Column, cuts: Column) -> Column:
    """bin_<1 + number of cuts strictly below the value>."""
    below = F.size(F.filter(cuts, lambda cut: cut < value))
    return F.concat(F.lit("bin_"), (below + 1).cast("string"))


def clock_microseconds(text: Column) -> Column:
    """MM:SS[.f] or HH:MM:SS[.f] to integer microseconds, null when malformed."""
    shape = r"^(?:(\d+):)?(\d+):(\d+)(?:\.(\d*))?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    whole = lambda c: F.when(c == "", F.lit(0)).otherwise(c.try_cast("long"))
    fraction = F.rpad(F.substring(part(4), 1, 6), 6, "0").cast("long")
    seconds = (whole(part(1)) * 60 + whole(part(2))) * 60 + whole(part(3))
    return F.when(text.rlike(shape), seconds * 1_000_000 + fraction)


def identity_form(value: Column) -> Column:
    """null / empty / whitespace_only / padded / ordinary; the value is not changed."""
    stripped = F.regexp_replace(value, r"^\s+|\s+$", "")
    return (
        F.when(value.isNull(), "null")
        .when(value == "", "empty")
        .when(stripped == "", "whitespace_only")
        .when(stripped != value, "padded")
        .otherwise("ordinary")
    )


def variant_identity_form(value: Column) -> Column:
    """Identity form of a JSON scalar held as VARIANT; only strings and ints qualify."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(~kind.isin("STRING", "BIGINT"), "malformed")
        .otherwise(identity_form(text))
    )


def filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def carrier_of(primary: Column, fallback: Column) -> Column:
    return F.when(filled(primary), primary).when(filled(fallback), fallback).otherwise("")


def carrier_fallback_used(primary: Column, fallback: Column) -> Column:
    return ~filled(primary) & filled(fallback)


def carrier_conflict(primary: Column, fallback: Column) -> Column:
    return filled(primary) & filled(fallback) & (primary != fallback)


def attack_sign(home_team: Column, carrier_team: Column, home_side: Column) -> Column:
    """+1/-1 for the carrier's team, null when the home direction is unknown."""
    home = F.when(home_side == "left_to_right", 1).when(home_side == "right_to_left", -1)
    return F.when(carrier_team == home_team, home).otherwise(-home)


def detection_status(flag: Column) -> Column:
    return F.when(flag.isNull(), "unavailable").when(flag, "detected").otherwise("extrapolated")


def generalised_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[^\]]*\]", "[]")


def tie_key(population_hash: Column, ordinal: Column) -> Column:
    return F.sha2(F.concat(population_hash, F.lit(":"), ordinal.cast("string")), 256)


def float_bits(value: Column) -> Column:
    """The 64 bits of a double as BIGINT, taken inside the JVM."""
    raw = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value)
    return raw.cast("long")


def float_bits_text(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(float_bits(value))), 16, "0")


def signed_zero(value: Column) -> Column:
    return F.when(value == 0.0, F.when(float_bits(value) < 0, "negative").otherwise("positive"))


def _bit_order(bits: Column) -> Column:
    # Negative doubles count down from zero, positive ones count up.
    return F.when(bits < 0, F.lit(-(2**63)) - bits).otherwise(bits)


def ulp_distance(left: Column, right: Column) -> Column:
    wide = lambda c: _bit_order(float_bits(c)).cast("decimal(20,0)")
    gap = F.abs(wide(left) - wide(right))
    return F.when(is_finite(left) & is_finite(right), gap)


def identity_holds(left: Column, right: Column, magnitude: Column) -> Column:
    """|l - r| within 64 machine epsilons of the largest magnitude involved."""
    bound = 64 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), magnitude, F.abs(left), F.abs(right))
    return F.abs(left - right) <= bound
