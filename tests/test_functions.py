"""Golden cases of the Column functions, with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import one
from ravel.functions import answers as A
from ravel.functions import boxed as B
from ravel.functions import rewrite as RW
from ravel.functions import text as TX
from ravel.functions.markers import marker_total
from ravel.operators import filters as FL
from ravel.operators import rewards as RWD
from ravel.sources.io import two_decimals


@pytest.mark.parametrize("s,want", [
    ("no box here", ""),
    ("x \\boxed{5} y", "5"),
    ("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"),
    ("\\boxed{1} then \\boxed{2}", "2"),
    ("\\boxed{}", ""),
    ("\\boxed{unclosed {nested}", "unclosed {nested"),  # never closed: the last character is lost
    ("\\boxed{", ""),
    ("tail \\boxed{ a {b {c}} d }e", "a {b {c}} d"),
    ("\\boxed{é{ü}}\u2028", "é{ü}"),
])
def test_extract_boxed(spark, s, want):
    assert one(spark, B.extract_boxed(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [
    ("\\boxed{a} then \\boxed{b} 7", "a"),
    ("\\boxed{a\u2028b} 7", "a\u2028b"),  # only a newline ends a line
    ("\\boxed{a\rb} 7", "a\rb"),
    ("\\boxed{a\x85b} 7", "a\x85b"),
    ("\\boxed{a\nb} 7", "7"),
    ("1 and 22.", "22"),
])
def test_fallback(spark, s, want):
    assert one(spark, B.extract_answer_fallback(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [("x = 5", "5"), ("a=b=  c ", "c"), ("none", "none"), (" spaced ", "spaced")])
def test_after_equals(spark, s, want):
    assert one(spark, B.after_equals(F.col("s")), s=s) == want


@pytest.mark.parametrize("s", ["\u00a0 padded\u2028 ", "\x1c\x1dx\x1f", "  ", "a b"])
def test_py_strip(spark, s):
    assert one(spark, TX.py_strip(F.col("s")), s=s) == s.strip()


@pytest.mark.parametrize("s,want", [
    ("Does  Not Exist", "dne"), ("does not exist.", "does not exist."), (" DOES\u00a0not exist ", "dne"),
    ("it does not exist", "it does not exist"), ("does\x1cnot exist", "dne"), ("does\u2028not\x1f\x1e exist\n", "dne"),
])
def test_normalize_dne(spark, s, want):
    assert one(spark, A.normalize_dne(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [
    ("\\boxed{A\x1cx}", "\\boxed{A}"), ("\\boxed{b)}", "\\boxed{B}"), ("\\boxed{c\u2028}", "\\boxed{C}"), ("\\boxed{Ax}", "\\boxed{Ax}"),
    ("\\boxed{Ax\n}", "\\boxed{Ax\n}"), ("\\boxed{{B}, x}", "\\boxed{{B}, x}"), ("\\boxed{x d\n} and \\boxed{5}", "\\boxed{D} and \\boxed{5}"),
])
def test_fix_choice_box(spark, s, want):
    assert one(spark, B.fix_choice_box(F.col("s")), s=s) == want


@pytest.mark.parametrize("s,want", [
    ("plain text, naïve café", 1.0), ("10 \u2126", 0.0), ("5 \u00b5m", 0.0), ("why\u037e", 1.0), ("\u03c0", 0.0), ("x² ½ ﬁ", 1.0),
    ("$\\alpha \u03b1$ and \\(\u03b2\\)", 1.0), ("\u1f00", 0.0), ("㍍", 0.0), ("\u0430", 0.0), ("", 1.0),
])
def test_flag_script(spark, s, want):
    assert one(spark, RWD.flag_script(F.col("s")), s=s) == want


@pytest.mark.parametrize("x,want", [(0.125, "0.12"), (2.675, "2.67"), (1.005, "1.00"), (0.375, "0.38"), (1234567.895, "1234567.90"), (0.0, "0.00"), (66.66666666666667, "66.67"), (100.0, "100.00")])
def test_two_decimals_as_in_c(spark, x, want):
    assert one(spark, two_decimals("x"), x=x) == want == "%.2f" % x


def test_text_cmd_and_choice(spark):
    assert one(spark, A.normalize_text_cmd(F.col("s")), s="\\text{DNE} or \\text{Yes}") == "dne or yes"
    assert one(spark, A.choice_letter(F.col("s")), s=" \\text{b} ") == "B"
    assert one(spark, A.choice_letter(F.col("s")), s="c") == "C"
    q = "Pick one. A. 5 B. 7 C) 9 D: 11"
    assert one(spark, A.choice_value(F.lit("C"), F.col("q")), q=q) == "9"
    assert one(spark, A.choice_value(F.lit("D"), F.col("q")), q=q) == "11"
    assert one(spark, A.choice_value(F.lit("A"), F.col("q")), q="no labels") == ""


@pytest.mark.parametrize("pred,gold,want", [
    ("5", "5", True), ("\\frac{10}{2}", "5", True), ("x = 5", "5", True), ("\\text{DNE}", "Does not exist", True),
    ("B", "7", True), ("2.50", "\\dfrac{5}{2}", True), ("4", "5", False), ("", "5", False),
])
def test_grade(spark, pred, gold, want):
    q = "Which? A. 5 B. 7 C. 9 D. 11"
    rows = spark.createDataFrame([(q, pred, gold)], "q string, p string, g string")
    assert A.with_grade(rows, "q", "p", "g").first().is_correct is want


def test_grade_ignore_unparseable(spark):
    rows = spark.createDataFrame([("", "anything", "   ")], "q string, p string, g string")
    assert A.with_grade(rows, "q", "p", "g", ignore_not_parseable=True).first().is_correct is True


def test_one_box_fold_in_reward_plans(spark):
    rows = spark.createDataFrame([("\\boxed{5}", "5")], "content string, solution string")
    plan = RWD.with_correct(rows)._jdf.queryExecution().optimizedPlan().toString()
    folds = [line.count("aggregate(") for line in plan.splitlines() if "aggregate(" in line]
    assert len(folds) == 2  # one projection reads expressions, one the box
    assert folds[-1] <= 2 and folds[0] <= 10  # the box fold's state is read twice at most; expressions are one tree for all sides and points


def test_normalize_gold(spark):
    assert one(spark, A.normalize_gold(F.col("g")), g="work\nmore\n#### 72 ") == "72"


def test_rewrite_steps(spark):
    got = one(spark, RW.rewrite_steps(F.col("s")), s="Intro\n1. first\n  2. second\n")
    assert got == "Intro\n\n---\n\n### Step 1:  first\n\n---\n\n### Step 2:  second"
    got = one(spark, RW.rewrite_steps(F.col("s")), s="a\n\x1c3. b")
    assert got == "a\n\n---\n\n### Step 3:  b"


def test_box_answer_signal(spark):
    got = one(spark, RW.box_answer_signal(F.col("a"), "#### "), a="work\n#### 42")
    assert got == "work\nThe answer is: \\boxed{42}"
    # an empty signal always matches
    assert one(spark, RW.box_answer_signal(F.col("a"), ""), a="only") == "The answer is: \\boxed{only}"


def test_split_think_answer(spark):
    t, a = RW.split_think_answer(F.col("s"))
    row = spark.range(1).select(F.lit(" think </think> answer ").alias("s")).select(t.alias("t"), a.alias("a")).first()
    assert (row.t, row.a) == ("think", "answer")


def test_strip_tags(spark):
    got = one(spark, TX.strip_outer_tags(F.col("s")), s="  <think>\ninner </b> text </think>  ")
    assert got == "inner </b> text"
    assert one(spark, TX.strip_named_tags(F.col("s"), ["think"]), s="<THINK a=1>x</think><thinking>") == "x<thinking>"
    assert one(spark, TX.strip_named_tags(F.col("s"), ["think"]), s="<think\u0301 a>x<think_ a></think\u0b83>") == "x<think_ a></think\u0b83>"


def test_low_quality_patterns(spark):
    lq = FL.low_quality(F.col("p"), F.col("t"), F.col("r"))
    assert one(spark, lq, p="q", t="fine", r="so \\boxed {1}") is False
    assert one(spark, lq, p="see [image\u2028 x]", t="fine", r="\\boxed{1}") is True  # '.' crosses U+2028
    assert one(spark, lq, p="see [image\n x]", t="fine", r="\\boxed{1}") is False  # '.' stops at \n only
    assert one(spark, lq, p="see [image x]", t="fine", r="\\boxed{1}") is True
    assert one(spark, lq, p="q", t="a . . . b", r="\\boxed{1}") is True
    assert one(spark, lq, p="q", t="a ..\x1c. b", r="\\boxed{1}") is True
    assert one(spark, lq, p="q", t="ok", r="</think> no box") is True


def test_step_and_thinking(spark):
    assert one(spark, FL.step_by_step(F.col("r")), r="a\n1. x\n 2. y") is True
    assert one(spark, FL.step_by_step(F.col("r")), r="a\n\x1c1. x\n2. y") is True
    assert one(spark, FL.step_by_step(F.col("r")), r="1. x\n2 y") is False
    gt = FL.good_thinking(F.col("t"), F.col("r"), 5)
    assert one(spark, gt, t="so\n\nthen", r="ok") is True
    assert one(spark, gt, t="so long segment\n\nthen", r="ok") is False
    assert one(spark, FL.good_thinking(F.lit(None).cast("string"), F.col("r")), r="\\begin{x}") is False


def test_topic(spark):
    m = FL.topic_match(F.col("p"))
    assert one(spark, m, p="Evaluate the integral of x") is True
    assert one(spark, m, p="Give the integral part of x") is False
    assert one(spark, m, p="Is f continuous at 0") is True
    assert one(spark, m, p="A continuous line") is False
    assert one(spark, m, p="Solve the ODE") is True
    assert one(spark, m, p="the code runs") is False
    assert one(spark, m, p="\u0130limit") is True  # lowercased to i + combining dot: a border before "limit"


@pytest.mark.parametrize("t,want", [
    ("", 0.0), ("a b", 0.0), ("a b c", 0.0),
    ("the cat the cat the cat", -0.25),  # 4 trigrams, 2 of them distinct
    ("A a a\u00a0A a", -1 / 3),  # 3 trigrams, all the same once lower-cased
])
def test_repetition(spark, t, want):
    assert math.isclose(one(spark, RWD.reward_repetition(F.col("t")), t=t), want, abs_tol=1e-12)


def test_format_steps_formula_markers(spark):
    c = "<think>\n- formula 2: x\nmore\n\nWait, But Butter\n</think>\nStep 1: First, 1. x"
    assert one(spark, RWD.reward_format(F.col("c")), c=c) == 1.0
    assert one(spark, RWD.reward_steps(F.col("c")), c=c) == 1.0  # a dash line, "Step 1:" and "First,"
    assert one(spark, RWD.reward_formula(F.col("c")), c=c) == 1.0
    assert one(spark, marker_total(F.col("c")), c=c) == 2  # Wait, But; not Butter
    assert one(spark, marker_total(F.col("c")), c="Wait\u0301 Waiting") == 1


def test_cosine_bounds(spark):
    rows = spark.createDataFrame([("\\boxed{5}", "5"), ("x" * 20000 + "\\boxed{4}", "5")], "content string, solution string")
    scored = RWD.with_correct(rows).select("content", RWD.reward_cosine_length("content", F.col("_correct")).alias("r"))
    short, long = (row.r for row in scored.orderBy(F.length("content")).collect())
    assert short == pytest.approx(1.0, abs=1e-6)
    assert long == pytest.approx(-0.5, abs=1e-9)  # the wrong bounds are swapped: the longest wrong answer gets the lower one
