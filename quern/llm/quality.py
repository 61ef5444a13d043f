r"""Quality rules by weak supervision (operator 2); DataFrame functions only.

Rules on whole texts vote good (1), bad (0) or abstain (null).  Whether a text
is good is not known; it is the hidden class of a two-class model in which a
rule that votes is right with an accuracy of its own on good and on bad texts,
independently of the other rules, and abstains as often on either.  The votes
of the corpus are counted by pattern, and expectation-maximisation over those
counts (at most ``3 ** len(RULES)`` of them, whatever the corpus) estimates the
accuracies and the share of good texts; its likelihood, with the weak prior of
:data:`STRENGTH` texts, never falls.  A rule's accuracies are held to be better
than chance, which tells the classes apart.  A document's posterior
probability of being good is a sum of constants chosen by its votes.  It
replaces "all rules must pass": a vote counts by how well its rule is borne out
by the others, so a bad vote of a rule that the others gainsay rejects nothing.
Documents that fail outright (below) take no part in the fit.

A document fails outright (`base_failed`) with fewer than 50 words, or when
more than half of its words lie in 3-word windows that occur twice or more in
it.  `kept` is false then, else whether the posterior reaches 1/2.

Defined results: null text has no words, so all counts are 0 and it fails.
Very long texts are read whole; the work per text is n, or n log n where a
window repeats.  Repeated rows each get a row.  An empty table gives no rows.
Without any evidence the prior decides.  Columns other than doc_id and text
are ignored by `quality`; `quality_filter` keeps the columns of its input,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import saved

_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LONG = "long"
RULES: Sequence[str] = ("symbols", "marked_words", "letters", "lines", "repeats", "capitals", "bangs", "word_length", "line_ends", "line_words")
#: the weak prior: a share of good texts, a rule's accuracy on good and on bad texts, and how many texts this knowledge weighs
PRIOR_GOOD, PRIOR_ACCURACY, STRENGTH = 0.85, (0.95, 0.6), 10.0


def with_features(docs: DataFrame, text: str = "text", out: str = "f") -> DataFrame:
    """`docs` with a struct `out` of counts."""
    pre = "__q_"
    t, w, h, g, p = (pre + x for x in "twhgp")
    zero = F.lit(0).cast(LONG)
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(F.col(t), _SPACE), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    # hashes of 3-word windows; the last two places have no window
    df = df.withColumn(g, F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))))
    df = df.withColumn(p, F.size(F.array_distinct(g)) < F.size(g))
    # rows that have a repeated window: sort (hash, place), flag places whose neighbour has the same hash, spread each over three words
    pairs, flags = pre + "a", pre + "b"
    df = df.withColumn(pairs, F.when(F.col(p), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn(flags, F.transform(pairs, lambda x, i: F.when((F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["i"])))
    places = F.filter(F.col(flags), lambda x: x.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(x, x + 1, x + 2))))
    without = lambda chars: F.translate(F.col(t), chars, "")
    count = lambda pattern: F.regexp_count(F.col(t), F.lit(pattern)).cast(LONG)
    lines = pre + "l"
    df = df.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(
        out,
        F.struct(
            F.size(w).cast(LONG).alias("n_words"),
            F.length(without(" \t\n\x0b\x0c\r")).cast(LONG).alias("word_chars"),
            (F.octet_length(t) - F.octet_length(without(SYMBOLS))).cast(LONG).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast(LONG).alias("n_dup_lines"),
            F.when(F.col(p), F.size(covered).cast(LONG)).otherwise(zero).alias("n_repeat_words"),
            F.size(lines).cast(LONG).alias("n_lines"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast(LONG).alias("n_capitals"),
            F.length(F.regexp_replace(t, r"\P{L}+", "")).cast(LONG).alias("n_letters"),
            count(r"[#*$%&|<>][^\x20\x09-\x0D]*").alias("n_marked_words"),
            (F.octet_length(t) - F.octet_length(without("!"))).cast(LONG).alias("n_bangs"),
            count(r"[.!?:;\"'”»][\x20\x09\x0B-\x0D]*(?=\n|\z)").alias("n_ended_lines"),
        ),
    )
    return df.drop(t, w, h, g, p, pairs, flags, lines)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def votes(f: Column) -> dict[str, Column]:
    """Each rule's vote: 1 good, 0 bad, null abstains."""
    per_word = lambda x: x / F.greatest(f["n_words"], F.lit(1))
    per_line = lambda x: x / F.greatest(f["n_lines"], F.lit(1))
    per_char = lambda x: x / F.greatest(f["word_chars"], F.lit(1))
    some, lined = f["n_words"] > 0, f["n_lines"] > 0
    length = per_word(f["word_chars"])
    vote = lambda good, bad: F.when(bad, 0).when(good, 1)
    return {
        "symbols": vote(some & (per_word(f["n_symbols"]) <= 0.02), per_word(f["n_symbols"]) > 0.1),
        "marked_words": vote(some & (per_word(f["n_marked_words"]) <= 0.02), per_word(f["n_marked_words"]) > 0.15),
        "letters": vote(some & (per_char(f["n_letters"]) >= 0.9), some & (per_char(f["n_letters"]) < 0.8)),
        "lines": vote((f["n_lines"] >= 4) & (per_line(f["n_dup_lines"]) <= 0.05), (f["n_lines"] >= 4) & (per_line(f["n_dup_lines"]) > 0.2)),
        "repeats": vote(some & (per_word(f["n_repeat_words"]) <= 0.05), per_word(f["n_repeat_words"]) > 0.2),
        "capitals": vote(some & (per_char(f["n_capitals"]) <= 0.1), per_char(f["n_capitals"]) > 0.3),
        "bangs": vote(some & (per_word(f["n_bangs"]) <= 0.02), per_word(f["n_bangs"]) > 0.2),
        "word_length": vote((length >= 4) & (length <= 7), some & ((length < 3) | (length > 10))),
        "line_ends": vote(lined & (per_line(f["n_ended_lines"]) >= 0.5), lined & (per_line(f["n_ended_lines"]) < 0.2)),
        "line_words": vote(lined & (per_line(f["n_words"]) >= 20), lined & (per_line(f["n_words"]) < 10)),
    }


@dataclass(frozen=True)
class Model:
    """Share of good texts; of each rule, how often a vote is right on good and on bad texts; log posterior of the fit after each round."""

    good: float
    right: tuple[tuple[float, float], ...]
    trace: tuple[float, ...] = ()


def _odds(good: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of being good that the prior and each rule's (good, bad) vote speak for."""
    return np.log(good / (1 - good)), np.stack([np.log(right[:, 0] / (1 - right[:, 1])), np.log((1 - right[:, 0]) / right[:, 1])], axis=1)


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 2000, rest: float = 1e-10) -> Model:
    """The model of counted vote patterns, by expectation-maximisation under the weak prior."""
    rules = len(patterns[0][0]) if patterns else len(RULES)
    count = np.array([n for _, n in patterns], float)
    up = np.array([[v == 1 for v in p] for p, _ in patterns], float).reshape(-1, rules)
    down = np.array([[v == 0 for v in p] for p, _ in patterns], float).reshape(-1, rules)
    prior = np.array(PRIOR_ACCURACY)
    good, right, trace = np.float64(PRIOR_GOOD), np.tile(prior, (rules, 1)), []
    for _ in range(rounds):
        bias, each = _odds(good, right)
        on_bad = np.log(1 - good) + up @ np.log(1 - right[:, 1]) + down @ np.log(right[:, 1])
        odds = bias + up @ each[:, 0] + down @ each[:, 1]
        weak = PRIOR_GOOD * np.log(good) + (1 - PRIOR_GOOD) * np.log(1 - good) + (prior * np.log(right) + (1 - prior) * np.log(1 - right)).sum()
        trace.append(float(count @ (on_bad + np.logaddexp(0, odds)) + STRENGTH * weak))
        if len(trace) > 1 and trace[-1] - trace[-2] <= rest * abs(trace[-1]):
            break
        q = count / (1 + np.exp(-odds))
        good = (q.sum() + STRENGTH * PRIOR_GOOD) / (count.sum() + STRENGTH)
        hits = np.stack([q @ up, (count - q) @ down], axis=1) + STRENGTH * prior
        cast = np.stack([q @ (up + down), (count - q) @ (up + down)], axis=1) + STRENGTH
        right = hits / cast
        # a vote for good must be at least as likely on good texts as on bad ones; where it isn't, the best fit within this bound has both alike
        worse = right.sum(axis=1) < 1
        alike = (hits[:, 0] + cast[:, 1] - hits[:, 1]) / cast.sum(axis=1)
        right[worse] = np.stack([alike, 1 - alike], axis=1)[worse]
    return Model(float(good), tuple(map(tuple, right.tolist())), tuple(trace))


def weights(model: Model) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of the prior, and of a good and of a bad vote of each rule. To abstain says nothing."""
    bias, each = _odds(np.float64(model.good), np.array(model.right))
    return float(bias), [tuple(x) for x in each.tolist()]


def probability(model: Model, pattern: Sequence[int | None]) -> float:
    bias, each = weights(model)
    return float(1 / (1 + np.exp(-(bias + sum(w[1 - v] for w, v in zip(each, pattern, strict=True) if v is not None)))))


def posterior(f: Column, model: Model) -> Column:
    bias, each = weights(model)
    odds = F.lit(bias)
    for vote, (up, down) in zip(votes(f).values(), each, strict=True):
        odds = odds + F.when(vote == 1, up).when(vote == 0, down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fitted(measured: DataFrame) -> Model:
    """Fit to all rows of a frame with a struct `f` that don't fail outright: these alone are left to the method."""
    by = votes(F.col("f"))
    counted = measured.where(~base_failed(F.col("f"))).select(*[v.cast("int").alias(k) for k, v in by.items()]).groupBy(*by).count()
    return fit(sorted(((tuple(r[k] for k in by), r["count"]) for r in counted.collect()), key=lambda x: [-1 if v is None else v for v in x[0]]))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, n_bad_votes, posterior, kept."""
    measured = saved(with_features(docs.select("doc_id", "text")).select("doc_id", "f"), "quality")
    model = fitted(measured)
    f = F.col("f")
    return measured.select(
        "doc_id", *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(f).alias("base_failed"), sum((F.when(v == 0, 1).otherwise(0) for v in votes(f).values()), F.lit(0)).alias("n_bad_votes"),
        posterior(f, model).alias("posterior"), (~base_failed(f) & (posterior(f, model) >= 0.5)).alias("kept"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept."""
    measured = saved(with_features(docs.select(F.struct("*").alias("row"), "text")).select("row", "f"), "quality")
    model = fitted(measured)
    return measured.where(~base_failed(F.col("f")) & (posterior(F.col("f"), model) >= 0.5)).select("row.*")
