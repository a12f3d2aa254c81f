"""Numbers as columns, with the results that Python gives: rounding, text and closeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a finite number: digits that single underscores may part, a point, an exponent.
NUMBER_TEXT = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_SPLIT = 134217729.0
_EXACT_POWERS = 22


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parsed_number(text: Column) -> Column:
    """The finite number that a text stands for, as a double; else null."""
    x = F.when(text.rlike(NUMBER_TEXT), F.regexp_replace(text, r"[\s_]", "").try_cast("double"))
    return let(x, lambda v: F.when(F.abs(v) < float("inf"), v))


def _split(x: Column) -> tuple[Column, Column]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def rounded_half_even(x: Column, decimals: Column) -> Column:
    """x rounded to so many decimals, ties of its exact binary value to even.

    The product with a power of ten is held as a double and its exact error, so a value is never taken for a tie that only
    looks like one in decimals, such as 2.675. Values too large to have decimals there stay as they are.
    """
    powers = F.array(*(F.lit(float(10**k)) for k in range(_EXACT_POWERS + 1)))

    def rounded(v):
        a, power, p = v["a"], v["power"], v["a"] * v["power"]
        (ah, al), (bh, bl) = _split(a), _split(power)
        error = al * bl - (p - ah * bh - al * bh - ah * bl)
        return let(F.struct(p.alias("p"), error.alias("error"), F.floor(p).cast("double").alias("low"), power.alias("power")), nearest)

    def nearest(v):
        rest = v["p"] - v["low"]
        up = (rest > 0.5) | ((rest == 0.5) & ((v["error"] > 0) | ((v["error"] == 0) & (v["low"] % 2 == 1))))
        return F.when(v["power"].isNotNull() & (v["p"] < float(2**52)), (v["low"] + up.cast("double")) / v["power"])

    value = let(F.struct(F.abs(x).alias("a"), F.get(powers, decimals).alias("power")), rounded)
    return let(value, lambda v: F.when(v.isNull() | F.isnan(x), x).otherwise(F.signum(x) * v))


def is_close(a: Column, b: Column, rel_tol: Column, abs_tol: Column) -> Column:
    """Whether two numbers are equal, or finite and as near as the tolerances say; NaN is near nothing."""
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    near = F.abs(a - b) <= F.greatest(rel_tol * F.greatest(F.abs(a), F.abs(b)), abs_tol)
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & ((a == b) | (finite & near)), F.lit(False))


def double_text(x: Column) -> Column:
    """A double as Python writes it: 10000000.0, 1e-05, nan, inf."""

    def written(v):
        plain, digits, e = v["plain"], v["digits"], v["e"]
        whole, rest = F.substring(F.rpad(digits, e + 1, "0"), F.lit(1), e + 1), F.substring(digits, e + 2, F.length(digits))
        fixed = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        point = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
        scientific = F.concat(point, F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        by_size = F.when(~plain.contains("E"), plain).when((e >= 0) & (e < 16), fixed).when(e == -4, small).otherwise(scientific)
        text = F.when(plain == "NaN", "nan").when(plain == "Infinity", "inf").otherwise(by_size)
        return F.concat(F.when(v["negative"], "-").otherwise(""), text)

    def parts(plain):
        figures = F.regexp_replace(F.split_part(plain, F.lit("E"), F.lit(1)), r"^-|\.0$|\.", "")
        e = F.coalesce(F.nullif(F.split_part(plain, F.lit("E"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0))
        unsigned = F.regexp_replace(plain, "^-", "")
        return let(F.struct(unsigned.alias("plain"), figures.alias("digits"), e.alias("e"), plain.startswith("-").alias("negative")), written)

    return let(x.cast("string"), parts)


def is_plain_double_text(text: Column) -> Column:
    """Whether a text is how Python writes the double that it stands for, so `1.5` but not `1.50`."""
    figures = lambda t: F.regexp_replace(F.regexp_replace(t, r"[eE].*$|[-.]", ""), "^0+|0+$", "")
    form = lambda t: F.regexp_replace(t, r"\d", "0")

    def same(own):
        # the shortest figures that stand for x need not be those that the engine writes, but never are more
        alike = (F.length(figures(text)) <= F.length(figures(own))) & (form(text) == form(own)) & ~text.rlike(r"\s|_|^\+")
        return (text == own) | alike

    x = F.when(text == "nan", float("nan")).when(text == "inf", float("inf")).when(text == "-inf", float("-inf")).otherwise(parsed_number(text))
    return F.coalesce(let(double_text(x), same), F.lit(False))
