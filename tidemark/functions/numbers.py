"""Numbers inside JSON text, printed in one form per value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A string, a number, or what stands between them. Strings are matched without going back, so that
# long ones need no stack.
TOKENS = r'"(?:[^"\\]++|\\.)*+"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+'
# Text without any of these has its numbers in their one form already.
SUSPECTS = r"[0-9][.eE]|-0|[0-9]{22}"
# Whole numbers print in full up to this many digits, fractions up to so many zeros.
WHOLE_DIGITS, FRACTION_ZEROS = 21, 6
# A whole number in its one form.
PLAIN = f"^-?[1-9][0-9]{{0,{WHOLE_DIGITS - 1}}}$"


def _split(token: Column) -> Column:
    """struct<text, parts>: whole digits, fraction and exponent of a number; ``parts`` is null for other
    tokens, and for whole numbers that have their one form already.

    Lambda functions are not compiled and share no results: texts are cut by plain functions, in one
    step after the other, because an expression for every part would be run again wherever it occurs.
    """
    is_number = F.ascii(token).isin(*map(ord, "-0123456789"))
    lower = F.lower(token)
    mantissa = F.substring_index(lower, "e", 1)
    exponent = F.when(F.contains(lower, F.lit("e")), F.substring_index(lower, "e", -1).try_cast("int"))
    parts = F.struct(
        F.ltrim(F.substring_index(mantissa, ".", 1), F.lit("-")).alias("whole"),
        F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("").alias("fraction"),
        F.coalesce(exponent, F.lit(0)).alias("exponent"),
    )
    return F.struct(token.alias("text"), F.when(is_number & ~token.rlike(PLAIN), parts).alias("parts"))


def _stripped(token: Column) -> Column:
    """The same with ``rest``: all digits but the zeros at the left."""
    parts = token["parts"]
    rest = F.ltrim(F.concat(parts["whole"], parts["fraction"]), F.lit("0"))
    return F.struct(token["text"].alias("text"), parts.alias("parts"), F.when(parts.isNotNull(), rest).alias("rest"))


def _point(token: Column) -> Column:
    """struct<text, digits, point>: a number is 0.digits times ten to the power of point; digits have no
    zero at either end. Tokens that stay as they are have null digits."""
    parts, rest = token["parts"], token["rest"]
    # Digits behind the decimal point count back from the exponent, whatever zeros stand before them.
    point = parts["exponent"] + F.length(rest) - F.length(parts["fraction"])
    return F.struct(
        token["text"].alias("text"),
        F.rtrim(rest, F.lit("0")).alias("digits"),
        F.when(parts.isNotNull(), point).alias("point"),
    )


def _number(part: Column) -> Column:
    digits, point = part["digits"], part["point"]
    size = F.length(digits)
    power = point - 1
    rest = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
    scientific = F.concat(
        F.substring(digits, 1, 1), rest, F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string")
    )
    value = (
        F.when((size <= point) & (point <= WHOLE_DIGITS), F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .when(
            (point > 0) & (point <= WHOLE_DIGITS),
            F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)),
        )
        .when((point > -FRACTION_ZEROS) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(scientific)
    )
    signed = F.when(part["text"].startswith("-"), F.concat(F.lit("-"), value)).otherwise(value)
    return F.when(digits.isNull(), part["text"]).when(digits == "", "0").otherwise(signed)


def canonical_numbers(text: Column) -> Column:
    """JSON text in which every number, at any depth, has the one form of its value: 1e2, 100.0 and 100
    are 100, 1e-7 and 0.0000001 are 1e-7, 1e25 in full and in short is 1e+25. Digits are never rounded.

    Strings stay as they are. Null stays null.
    """
    parts = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    for step in (_split, _stripped, _point):
        parts = F.transform(parts, step)
    return F.when(text.rlike(SUSPECTS), F.array_join(F.transform(parts, _number), "")).otherwise(text)
