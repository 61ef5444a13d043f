import random

import pytest
from pyspark.sql import functions as F

from quern.functions import answers as a
from quern.functions import scoring as s
from quern.sources import readers

M = "−"


def run(spark, f, values):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ("x string, y string" if isinstance(values[0], tuple) else "x string"))
    args = [F.col("x")] + ([F.col("y")] if "y" in df.columns else [])
    return [r.out for r in df.select("i", f(*args).alias("out")).orderBy("i").collect()]


CASES = {
    "hash_gold": (a.hash_gold, {"so #### $5": "$5", "#### 1,234.": "1234", "a #### 1 b #### 7 x": "7", "none": None, "####  ": None, "####  12 x": "12", "#### ,.": None, "x\n####\n9\n": "9", None: None}),
    "hash_generated": (a.hash_generated, {"#### $1,234.": "1234", "#### 1 then #### 7": "7", "#### ,.": None, f"#### {M}42": "-42", "": None, "#### $$3,": "3", "no mark 5": None, None: None}),
    "last_box": (a.last_box, {r"\boxed{a}": r"\boxed{a}", r"x \boxed{\frac{1}{2}} y}": r"\boxed{\frac{1}{2}}", r"\boxed{a} \boxed{b": None, r"\fbox{c} z": r"\fbox{c}", r"\fbox{c} \boxed 4": None, "none": None, r"\boxed{}": r"\boxed{}", r"\boxed } {x}": None}),
    "boxed_gold": (a.boxed_gold, {r"\boxed{}": "", r"$\boxed 42$.": "42", r"\boxed{x{y}z}": "x{y}z", r"\boxed{x": None, r"\boxed $": None, r"\fbox{3}": "3"}),
    "boxed_generated": (a.boxed_generated, {r"\boxed{}": None, rf"\boxed{{{M}3}}": "-3", r"\boxed{ $7$ }": "7", r"\boxed{$}": "$", None: None}),
    "marked": (
        a.marked,
        {
            "Final Answer: $1,210.00": "1210.00", "answer = 5%": "5", "Final Answer: The answer is 5": "The", f"total {M}5": "5", f"Answer: {M}5": "-5", "no digits, no marker": None, "Answer:  ": None,
            "ANSWER: 1\nfinal  answer: 2 apples": "2", "the answer: 5\r": "5", "pay 1,000.50 now": "1000.50", "rate 1.5e3%": "1.5e3", "Answer:\n9": "9", "Answer: ,": None, "7 then answer: %": "7", None: None,
        },
    ),
    "normal": (a.normal, {" $$1,000.;": "1000", "5%%": "5%", f"{M}3": "-3", " x ": "x", "": "", "$": ""}),
    "level": (a.level, {"Level 3": 3, "Level ?": None, "level 3": None, "Level 6": None, "3": None, "Level 5\n": None}),
    "level_fault": (a.level_fault, {"Level 3": False, "Level ?": False, "level 3": True, "Level 6": True, "3": True, None: True}),
    "difficulty": (a.difficulty, {"Easy": 1, " hard ": 5, "Intermediate": 3, "level 4": 4, "LEVEL  2": 2, "3": 3, "6": None, "0": None, "x": None, "03": 3, "+2": 2, "": None, None: None}),
    "category_slug": (a.category_slug, {"Counting & Probability": "counting_and_probability", "Number Theory": "number_theory"}),
    "loose": (a.loose, {r" $\left(1,000\right) X ": "(1000)x"}),
    "hash_or_number": (a.hash_or_number, {"#### 4": "4", "it is 1,250.5 or -3": "-3", "none": None}),
    "box_or_number": (a.box_or_number, {r"\boxed{4}": "4", "is 12": "12", r"\boxed{a} then \boxed{b": "a"}),
    "latex_normal": (
        s.latex_normal,
        {
            r"\dfrac{1}{2}": r"\frac{1}{2}", r"\left(1, 2\right)": "(1,2)", r"\frac12": r"\frac{1}{2}", r"\frac1{2}": r"\frac{1}{2}", "0.5": r"\frac{1}{2}", ".5": r"\frac{1}{2}", "3/4": r"\frac{3}{4}", "03/4": "03/4", "-3/4": r"\frac{-3}{4}",
            "x=5": "5", "abc=5": "abc=5", "a=b=c": "a=b=c", r"5\text{ cm}": "5", r"5\text{ cm}\text{ s}": None, r"\sqrt3": r"\sqrt{3}", r"\sqrt{3}": r"\sqrt{3}", r"x\sqrt": None, r"x\frac": None, r"\frac1": r"\frac1", r"45^\circ": "45",
            r"45^{\circ}": "45", r"\$5": "5", r"5\%": "5", r"a .5": "a0.5", r"{.5}": "{0.5}", "": "", "1\n2": "12", r"a\!b": "ab", "1/2/3": "1/2/3", r"\tfrac{1}{2}": r"\frac{1}{2}", r"\frac1\frac23": r"\frac1\frac23",
        },
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_one_text(spark, name):
    f, cases = CASES[name]
    assert dict(zip(cases, run(spark, f, list(cases)), strict=True)) == cases


PAIRS = {
    "hash": (s.score_hash, {("42.0", "42"): True, ("0.1", "0.10"): True, ("4200", "42"): False, ("nan", "nan"): True, ("NaN", "nan"): False, ("", "42"): False, (None, "1"): False, ("a", "a"): True, ("-0", "0"): True, ("1", None): False}),
    "marked": (s.score_marked, {("$5%", "5"): True, ("1,000", "1000.0"): True, ("5", "0.05"): False, (None, "5"): False}),
    "boxed": (s.score_boxed, {(r"\dfrac{1}{2}", r"\frac12"): True, (r"\frac{1}{2}", r"\frac{2}{4}"): False, (r"\left(1, 2\right)", "(1, 2)"): True, ("0.50", ".5"): True, (r"x\text{ a}\text{ b}", "x"): False, (r"x\frac", r"x\frac"): True, (None, "1"): False}),
    "failed": (s.normalise_failed, {(r"x\text{ a}\text{ b}", "x"): True, (r"x\frac", r"x\frac"): False, ("1", "2"): False, (None, "1"): False}),
}


@pytest.mark.parametrize("name", PAIRS)
def test_two_texts(spark, name):
    f, cases = PAIRS[name]
    assert dict(zip(cases, run(spark, f, list(cases)), strict=True)) == cases


def test_exact_residue(spark):
    cases = {
        ("4.2e3", "4200"): True, ("1_000", "1000"): True, ("1e40", "10000000000000000000000000000000000000000"): True, ("0.1234567890123456789012", "0.1234567890123456789013"): False, ("inf", "inf"): True, ("inf", "Infinity"): False,
        ("1", "1.0"): True, ("x", "y"): False, (None, "1"): False, ("1e", "1"): False, ("123456789012345678901", "123456789012345678901.0"): True,
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, a string, b string")
    out = [r.correct for r in s.scored(df, "hash", "a", "b").orderBy("i").collect()]
    assert dict(zip(cases, out, strict=True)) == cases
    assert all(s.equal_decimals(x, y) for (x, y), v in cases.items() if v and x != y)


def test_decimals_as_python_has_them(spark):
    rnd = random.Random(12)
    piece = lambda: "".join(rnd.choice("0001234567890_") for _ in range(rnd.randrange(6)))
    texts = [rnd.choice(("", "", "-", "+", " ", "\u00a0-")) + piece() + rnd.choice(("", ".", ".")) + piece() + rnd.choice(("", "", "e3", "E-2", "e+05", "e", "e-0")) + rnd.choice(("", " ", "\n")) for _ in range(400)]
    texts += ["0", "-0", "0e9", "00.00", ".", "-.5", "5.", "٣٤", "𝟛.5", "1e999999", "1" * 60, "1" * 60 + ".0", "nan", "-inf", "Infinity", "sNaN", "0x10", "1,000", "½", "", "1e-40", "0." + "0" * 39 + "1"]
    pairs = [(x, y) for x in texts for y in rnd.sample(texts, 8)] + [(x, x) for x in texts]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "i int, a string, b string").select("i", s.decimal_equal(F.col("a"), F.col("b")).alias("same"))
    got = [r.same for r in df.orderBy("i").collect()]
    assert [p for p, g in zip(pairs, got, strict=True) if g != s.equal_decimals(*p)] == []
    assert sum(got) > len(texts) // 2


def test_long_runs_of_zeros_are_linear(spark):
    zeros = "1" + "0" * 200_000 + "1"
    df = spark.createDataFrame([(zeros, zeros + ".0"), (zeros, zeros + "1")], "a string, b string")
    assert [r[0] for r in df.select(s.decimal_equal(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_grades_use_exact_decimals(spark):
    rows = [("gsm8k", "#### 1e3", "1000"), ("gsm8k", "#### 4.2e3", "4200"), ("math", "\\boxed{1e3}", "1000"), ("math", "\\boxed{42.0}", "42"), ("finchain", "Answer: 1e3", "1000"), ("finchain", "Answer: 1234567890123456789.50", "1234567890123456789.5"), ("gsm8k", "#### 42.5", "42")]
    out = readers.grade(spark.createDataFrame(rows, "source string, completion string, gold_answer string"))
    assert [r.correct for r in out.collect()] == [True] * 6 + [False]


def test_an_answer_is_extracted_once(spark):
    rows = spark.createDataFrame([("math", "\\boxed{1}", "1")], "source string, completion string, gold_answer string")
    plan = readers.grade(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and len(plan) < 60_000


def test_strict(spark):
    df = spark.createDataFrame([("#### 1",), ("none",)], "x string")
    with pytest.raises(Exception, match="no answer"):
        df.select(a.strict(a.hash_gold(F.col("x")), "answer")).collect()


def test_graded(spark):
    df = spark.createDataFrame([("5", "5.0"), ("4", "5"), (None, "5")], "p string, g string").select(s.graded(F.col("p"), F.col("g")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()] == [("5", True, True, "correct"), ("4", True, False, "answer_mismatch"), (None, False, False, "parse_failure")]
