"""Scalar and array expressions shared by the stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """TIMESTAMP_NTZ, null where the text is no time."""
    return text.try_cast("timestamp_ntz")


def nearest_hour(ts: Column) -> Column:
    """To the nearest hour; half an hour goes to the even hour."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    past = F.date_part(F.lit("MINUTE"), ts) * 60 + F.date_part(F.lit("SECOND"), ts)
    down = (past < 1800) | ((past == 1800) & (F.hour(ts) % 2 == 0))
    return F.when(down, hour).otherwise(hour + F.expr("INTERVAL 1 HOUR"))


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def bin_of(x: Column, edges: Column) -> Column:
    """Number of the right-closed bin from 1 on, the least value included; null outside or without bins."""
    at = F.size(F.filter(edges, lambda e: e < x))
    lowest = x == F.element_at(edges, 1)
    inside = (F.size(edges) > 1) & (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.when(lowest, F.lit(1)).otherwise(at))


def bin_label(number: Column, edges: Column) -> Column:
    """``(a, b]`` with three decimals; the first bin's lower end is shown 0.001 lower."""
    three = lambda x: F.format_string("%.3f", F.round(x, 3))
    low = F.element_at(edges, number)
    shown = F.when(number == 1, low - 0.001).otherwise(low)
    text = F.concat(F.lit("("), three(shown), F.lit(", "), three(F.element_at(edges, number + 1)), F.lit("]"))
    return F.when(number.isNull(), F.lit("nan")).otherwise(text)


def clean_query(text: Column) -> Column:
    """Trimmed, without triple quotes around it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), '^"""', ""), '"""$', "")
    return F.trim(bare)


def type_in_name(stem: Column) -> Column:
    """A1, A2 or A3 between separators, else anywhere in the name, else null."""
    apart = F.regexp_extract(stem, "(^|[_-])(A[123])($|[_-])", 2)
    any_place = F.regexp_extract(stem, "(A[123])", 1)
    return F.coalesce(F.nullif(apart, F.lit("")), F.nullif(any_place, F.lit("")))


def length_in_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|/)route_sliced_(\d+)(?:/|$)", 1), F.lit("")).cast("int")


def plan_name(stem: Column) -> tuple[Column, Column]:
    """(route, type) of a plan's file name."""
    shape = r"^route_(.+)_(A[123])(?:$|[_-])"
    get = lambda i: F.nullif(F.regexp_extract(stem, shape, i), F.lit(""))
    return get(1), get(2)


def json_span(text: Column) -> Column:
    """From the first opening to the last closing brace; empty without both in that order."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def fixed_point(x: Column, places: int, sign: bool = False) -> Column:
    """A double with ``places`` decimals, 6 at most, as Python writes it: its exact binary value is rounded, ties to even.

    The fraction is cut into halves of 26 bits, whose products with the power of ten are exact, so what
    is left over one half of the last place has its right sign. From 2 ** 63 on the digits are those of the
    double's shortest decimal form.
    """
    x = x.cast("double")
    size, power = F.abs(x), 10**places
    fraction = size - F.floor(size)
    high = fraction * 134217729.0 - (fraction * 134217729.0 - fraction)
    whole = F.floor(high * float(power))
    over_half = (high * float(power) - whole - 0.5) + (fraction - high) * float(power)
    up = (over_half > 0) | ((over_half == 0) & (whole % 2 == 1))
    last = F.array(whole + F.when(up, 1).otherwise(0))  # bound once, as it is used three times
    write = lambda n: F.concat(
        (F.floor(size) + F.when(n >= power, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % power).cast("string"), places, "0")
    )
    text = F.when(size < float(1 << 63), F.element_at(F.transform(last, write), 1)).when(size.isNotNull(), F.format_string(f"%.{places}f", size))
    minus = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if sign else "")
    odd = F.when(F.isnan(x), "+nan" if sign else "nan").when(size == float("inf"), F.concat(minus, F.lit("inf")))
    return F.when(F.isnan(x) | (size == float("inf")), odd).otherwise(F.concat(minus, text))


#: Bits of a draw.
DRAW_BITS = 60


def draw(*keys: Column, seed: int | Column) -> Column:
    """60 random bits that depend on the keys and the seed alone, by MD5, which other engines have too."""
    name = F.concat_ws(":", *[k.cast("string") for k in (*keys, seed if isinstance(seed, Column) else F.lit(seed))])
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def uniform(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return draw(*keys, seed=seed).cast("double") / float(1 << DRAW_BITS)


def coin(*keys: Column, seed: int) -> Column:
    """1 or -1 by the keys and the seed."""
    return F.when(draw(*keys, seed=seed) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
