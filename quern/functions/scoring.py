r"""Columns that compare answers.

Decimal equality is exact for numbers of any length and exponent: both sides
are brought to one spelling (sign, digits without outer zeros, exponent), which
equal numbers share.  All of it stays in the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.answers import filled, let, normal, strip

#: sign, whole part, fraction, exponent (of 18 digits at most) of a number without underscores, lower case
_NUMBER = r"^([+-]?)(?=\.?\d)(\d*)(?:\.(\d*))?(?:e([+-]?\d{1,18}))?\z"
#: the digits of other scripts, and the ASCII digits that they stand for
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def canonical(x: Column) -> Column:
    """One spelling of each finite decimal number, null for anything else.

    Outer white space and underscores don't count; digits of any script do.
    """

    def spelled(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k))
        power = F.coalesce(filled(part(3)).cast("long"), F.lit(0)) - F.length(part(2))
        by = lambda digits, short: F.when(digits == "", "0").otherwise(F.concat(F.replace(part(0), F.lit("+"), F.lit("")), short, F.lit("e"), (power + F.length(digits) - F.length(short)).cast("string")))
        return F.when(F.size(parts) == 4, let(F.ltrim(F.concat(part(1), part(2)), F.lit("0")), lambda digits: let(F.rtrim(digits, F.lit("0")), lambda short: by(digits, short))))

    parted = lambda y: F.when(~y.contains("|"), F.split(F.regexp_replace(y, _NUMBER, "$1|$2|$3|$4"), "[|]", -1))
    plain = F.lower(F.replace(strip(x), F.lit("_"), F.lit("")))
    ascii_ = lambda v: F.when(F.length(v) < F.octet_length(v), F.translate(v, "".join(_DIGITS), _ASCII)).otherwise(v)
    return let(parted(let(plain, ascii_)), spelled)


#: numbers that Spark's own decimals hold; of two of these every rule below says what their values say
_PLAIN = r"^[+-]?(?:\d{1,20}(?:\.\d{0,18})?|\.\d{1,18})\z"


def _both_plain(x: Column, y: Column) -> Column:
    return x.rlike(_PLAIN) & y.rlike(_PLAIN)


def _plain_equal(x: Column, y: Column) -> Column:
    return x.try_cast("decimal(38,18)") == y.try_cast("decimal(38,18)")


def decimal_equal(a: Column, b: Column) -> Column:
    """Whether both are finite decimals of the same value; false where either isn't one."""
    return _pair(a, b, lambda x, y: F.when(_both_plain(x, y), _plain_equal(x, y)).otherwise(canonical(x) == canonical(y)))


def equal_decimals(a: str | None, b: str | None) -> bool:
    """The same rule for one pair outside of Spark."""
    if a is None or b is None:
        return False
    try:
        x, y = Decimal(a), Decimal(b)
    except (InvalidOperation, ValueError):
        return False
    return x.is_finite() and y.is_finite() and x == y


def _pair(a: Column, b: Column, body) -> Column:
    """`body(a, b)`, each computed once; false where it is null."""
    return F.coalesce(let(a, lambda x: let(b, lambda y: body(x, y))), F.lit(False))


def score_hash(predicted: Column, gold: Column) -> Column:
    """Same string, or equal decimals."""
    return _pair(predicted, gold, lambda x, y: F.when(x == y, True).otherwise(decimal_equal(x, y)))


def score_marked(predicted: Column, gold: Column) -> Column:
    """As `score_hash`, on normal forms."""
    return score_hash(normal(predicted), normal(gold))


# -- LaTeX ---------------------------------------------------------------------------

#: fixed rewrites, in order
_BEFORE_UNITS = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))
_AFTER_UNITS = (("\\%", ""), (" .", " 0."), ("{.", "{0."))
_UNITS = "\\text{ "


def _rewrite(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def brace_roots(x: Column) -> Column:
    r"""`\sqrt3` -> `\sqrt{3}`; only the character after the command moves into braces."""
    return let(x, lambda v: F.when(v.contains("\\sqrt"), F.regexp_replace(v, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")).otherwise(v))


def brace_fractions(x: Column) -> Column:
    r"""`\frac12` -> `\frac{1}{2}`, `\frac1{2}` -> `\frac{1}{2}`. A lone character after a `\frac` leaves the whole text alone."""

    def braced(y: Column) -> Column:
        short = let(F.split(y, r"\\frac", -1), lambda parts: F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: (F.length(p) == 1) & (p != "{")))
        done = F.regexp_replace(y, r"(?s)\\frac((?!\\frac)[^{])((?!\\frac)[^{])", r"\\frac{$1}{$2}")
        return F.when(short, y).otherwise(F.regexp_replace(done, r"(?s)\\frac((?!\\frac)[^{])(?=\{)", r"\\frac{$1}"))

    return let(x, lambda v: F.when(v.contains("\\frac"), braced(v)).otherwise(v))


def slash_fraction(x: Column) -> Column:
    r"""`3/4` -> `\frac{3}{4}` for whole numbers as they are usually written."""
    return F.regexp_replace(x, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


def latex_normal(x: Column) -> Column:
    r"""A LaTeX answer in normal form; null where the rules don't apply (`latex_fault`)."""
    return let(x, lambda v: F.when(~latex_fault(v), _latex_rules(v)))


def _latex_rules(x: Column) -> Column:
    y = _rewrite(x, _BEFORE_UNITS)
    y = F.substring_index(y, _UNITS, 1)
    y = _rewrite(y, _AFTER_UNITS)
    y = let(y, lambda v: F.when(v.startswith("."), F.concat(F.lit("0"), v)).otherwise(v))
    right = lambda v, sides: F.when((F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) <= 2), F.get(sides, F.lit(1))).otherwise(v)
    y = let(y, lambda v: let(F.split(v, "=", -1), lambda sides: right(v, sides)))
    y = brace_fractions(F.replace(brace_roots(y), F.lit(" "), F.lit("")))
    return let(y, lambda v: F.when(v == "0.5", F.lit("\\frac{1}{2}")).otherwise(slash_fraction(v)))


def latex_fault(x: Column) -> Column:
    r"""Texts that the rules can't handle: two units, or a `\sqrt` or `\frac` that nothing follows."""

    def faulty(y: Column) -> Column:
        rest = lambda z: z.rlike(r"\\sqrt\z|\\sqrt\\sqrt") | F.replace(z, F.lit(" "), F.lit("")).rlike(r"\\frac\z|\\frac\\frac")
        return (F.size(F.split(y, r"\\text\{ ", -1)) > 2) | let(_rewrite(F.substring_index(y, _UNITS, 1), _AFTER_UNITS), rest)

    return F.coalesce(let(x, lambda v: v.contains("\\") & let(_rewrite(v, _BEFORE_UNITS), faulty)), F.lit(False))


def score_boxed(predicted: Column, gold: Column) -> Column:
    """Same string, same LaTeX normal form, or equal decimals. Texts that can't be normalised fall through."""
    return _pair(predicted, gold, lambda x, y: F.when(x == y, True).when(_both_plain(x, y), _plain_equal(x, y)).when(latex_normal(x) == latex_normal(y), True).otherwise(canonical(x) == canonical(y)))


def normalise_failed(predicted: Column, gold: Column) -> Column:
    """Whether a pair reached the LaTeX rules and one of its sides can't be normalised."""
    return F.coalesce((predicted != gold) & (latex_fault(predicted) | latex_fault(gold)), F.lit(False))


SCORERS = {"hash": score_hash, "marked": score_marked, "boxed": score_boxed}


def scored(df: DataFrame, kind: str, predicted: str, gold: str, out: str = "correct") -> DataFrame:
    """`df` with the verdict `out` of a kind of SCORERS."""
    return df.withColumn(out, SCORERS[kind](F.col(predicted), F.col(gold)))


def graded(predicted: Column, gold: Column) -> Column:
    """struct(parsed_answer, parse_success, final_answer_correct, reason)."""

    def told(given: Column, right: Column) -> Column:
        return F.struct(
            given.alias("parsed_answer"), given.isNotNull().alias("parse_success"), right.alias("final_answer_correct"),
            F.when(given.isNull(), "parse_failure").when(right, "correct").otherwise("answer_mismatch").alias("reason"),
        )

    return let(predicted, lambda given: let(score_marked(given, gold), lambda right: told(given, right)))
