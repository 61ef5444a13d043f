r"""Columns that pull answers out of texts and bring them to a normal form.

Every function is `Column -> Column`, JVM-side, and never raises: where a text
has no answer it gives null.  `strict` turns such nulls into an error.

White space is Unicode white space, as in the corpora these rules come from;
Spark's own `trim` only knows the blank.

A Column that is used twice is computed twice, and a rule that is built of such
rules many times over.  `let` gives a value a name instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "\u2212"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body(x)` with `x` computed once."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def filled(x: Column) -> Column:
    """`x`, null where it is empty."""
    return let(x, lambda v: F.when(v != "", v))


def strip(x: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_extract(x, r"(?Us)^\s*+(\S(?:.*\S)?)?", 1)


def first_token(x: Column) -> Column:
    """The first run of non-space characters, null if there is none."""
    return filled(F.regexp_extract(x, r"(?U)^\s*(\S+)", 1))


def strict(x: Column, what: str) -> Column:
    """`x`, or an error where it is null."""
    return F.when(x.isNull(), F.raise_error(F.lit(f"no {what}"))).otherwise(x)


def after_last(x: Column, mark: str) -> Column:
    """What follows the last `mark`; null where there is none."""
    return F.when(x.contains(mark), F.substring_index(x, mark, -1))


# -- answers after a hash mark ------------------------------------------------


def hash_gold(x: Column) -> Column:
    """Reference answer after the last `####`: first token, no commas, no final stops. Keeps `$` and the Unicode minus."""
    token = F.replace(first_token(after_last(x, "####")), F.lit(","), F.lit(""))
    return filled(F.regexp_replace(token, r"[.,]+\z", ""))


def hash_generated(x: Column) -> Column:
    """Generated answer after the last `####`: Unicode minus read as `-`, leading `$` and final stops dropped, then commas."""
    token = first_token(after_last(F.replace(x, F.lit(MINUS), F.lit("-")), "####"))
    token = F.regexp_replace(F.regexp_replace(token, r"^[$]+", ""), r"[.,]+\z", "")
    return filled(F.replace(token, F.lit(","), F.lit("")))


# -- boxed answers --------------------------------------------------------------


def last_box(x: Column) -> Column:
    r"""The last `\boxed` (else the last `\fbox`) up to the brace that balances its first one; null if none does.

    Only the braces of the tail from that marker are walked, and only the brace that balances counts.
    """
    zero = F.lit(0)

    def balanced(tail: Column) -> Column:
        walk = F.aggregate(
            F.split(tail, "(?<=[{}])", -1),
            F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("end")),
            lambda s, piece: F.struct(
                (s["at"] + F.length(piece)).alias("at"),
                (s["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)).alias("depth"),
                F.when((s["end"] == 0) & piece.endswith("}") & (s["depth"] == 1), s["at"] + F.length(piece)).otherwise(s["end"]).alias("end"),
            ),
            lambda s: s["end"],
        )
        return let(walk, lambda end: F.when(end > 0, F.substr(tail, F.lit(1), end)))

    def tail(text: Column) -> Column:
        found = lambda mark: F.when(text.contains(mark), F.concat(F.lit(mark), F.substring_index(text, mark, -1)))
        return let(F.coalesce(found("\\boxed"), found("\\fbox")), balanced)

    return let(x, tail)


def unwrap_box(x: Column) -> Column:
    r"""Content of `\boxed{...}` or `\fbox{...}`; null for anything else."""
    inside = lambda v, left: F.when(v.startswith(left) & v.endswith("}"), F.substr(v, F.lit(len(left) + 1), F.length(v) - len(left) - 1))
    return let(x, lambda v: F.coalesce(inside(v, "\\boxed{"), inside(v, "\\fbox{")))


def bare_box(x: Column) -> Column:
    r"""`\boxed 42$`: what follows the last `\boxed ` up to the next `$`, trimmed; null if empty."""
    return filled(strip(F.substring_index(after_last(x, "\\boxed "), "$", 1)))


def boxed_gold(x: Column) -> Column:
    r"""Content of the last box, in braces or bare. `\boxed{}` gives the empty string."""
    return let(x, lambda v: F.coalesce(unwrap_box(last_box(v)), bare_box(v)))


def boxed_generated(x: Column) -> Column:
    """As `boxed_gold`, Unicode minus read as `-`, trimmed, one pair of outer `$` dropped; null if empty."""
    undollared = lambda v: F.when((F.length(v) >= 2) & v.startswith("$") & v.endswith("$"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return filled(strip(let(strip(boxed_gold(F.replace(x, F.lit(MINUS), F.lit("-")))), undollared)))


# -- answers after a marker word ---------------------------------------------------

#: the grammar of a marked answer and of a number; fixed, as the digits and blanks of any script count
_MARKED = r"(?dimU)(?:final\s+answer|answer)\s*[:=]\s*(.+)$"
_NUMBER = r"(?i)-?\$?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?(?:e[+-]?\p{Nd}+)?%?"


def normal(x: Column) -> Column:
    """Trim, read the Unicode minus as `-`, drop leading `$`, final `. , ;`, all commas and one final `%`, trim."""
    y = F.replace(strip(x), F.lit(MINUS), F.lit("-"))
    y = F.regexp_replace(F.regexp_replace(y, r"^[$]+", ""), r"[.,;]+\z", "")
    return strip(F.regexp_replace(F.replace(y, F.lit(","), F.lit("")), r"%\z", ""))


def marked(x: Column) -> Column:
    """First token after the last `answer:` (or `final answer =`) line, else the last number in the text, in normal form; else null.

    A marker that only blanks follow counts as none.
    """

    def found(text: Column) -> Column:
        lines = F.regexp_extract_all(text, F.lit(_MARKED), F.lit(1))
        number = F.try_element_at(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), F.lit(-1))
        return F.coalesce(filled(normal(first_token(F.try_element_at(lines, F.lit(-1))))), filled(normal(number)))

    return let(x, found)


# -- difficulty and category ---------------------------------------------------------


def level(x: Column) -> Column:
    """`Level 3` -> 3; `Level ?` and anything else -> null (see `level_fault`)."""
    n = F.try_to_number(F.regexp_extract(x, r"^Level ([1-5])\z", 1), F.lit("9"))
    return n.cast("int")


def level_fault(x: Column) -> Column:
    """True where a level is neither `Level ?` nor `Level 1` to `Level 5`; a null level is a fault."""
    return ~F.coalesce(x.rlike(r"^Level [1-5?]\z"), F.lit(False))


#: fixed words of difficulty
GRADES = {"easy": 1, "basic": 1, "intermediate": 3, "medium": 3, "advanced": 5, "hard": 5}


def difficulty(x: Column) -> Column:
    """Free-text difficulty: a grade word, `level N` or `N`, any case; null unless 1 to 5."""
    low = F.lower(strip(x))
    grade = F.lit(None).cast("int")
    for word, n in GRADES.items():
        grade = F.when(low == word, n).otherwise(grade)
    digits = F.regexp_extract(F.regexp_replace(low, r"(?U)^level \s*", ""), r"^[+]?0*([1-5])\z", 1)
    return F.coalesce(grade, F.nullif(digits, F.lit("")).cast("int"))


def category_slug(x: Column) -> Column:
    """`Counting & Probability` -> `counting_and_probability`."""
    return F.replace(F.replace(F.lower(x), F.lit(" & "), F.lit("_and_")), F.lit(" "), F.lit("_"))


# -- plain variant used for quick looks ------------------------------------------------


def loose(x: Column) -> Column:
    r"""Lower case without `$`, commas, blanks, `\left` and `\right`."""
    y = F.lower(strip(x))
    for part in (",", "$", "\\left", "\\right", " "):
        y = F.replace(y, F.lit(part), F.lit(""))
    return y


def last_number(x: Column) -> Column:
    """The last number in a text, commas aside."""
    return F.try_element_at(F.regexp_extract_all(F.replace(x, F.lit(","), F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1))


def hash_or_number(x: Column) -> Column:
    """Answer after `####`, else the last number."""
    return F.coalesce(hash_gold(x), last_number(x))


def box_or_number(x: Column) -> Column:
    """Boxed answer, else the last flat box, else the last number."""
    flat = F.try_element_at(F.regexp_extract_all(x, F.lit(r"\\boxed\{([^{}]+)\}"), F.lit(1)), F.lit(-1))
    return F.coalesce(boxed_gold(x), flat, last_number(x))
