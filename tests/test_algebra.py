"""Answers that are equal after some algebra, and answers that are not."""

import pytest
from pyspark.sql import functions as F

from ravel.functions import algebra
from ravel.functions import answers as A

EQUAL = [
    ("x+1", "1+x"), ("2(x+1)", "2x+2"), (r"\frac{1}{6}x+\frac{5}{6}", "(x+5)/6"), ("(x+1)^{2}", "x^2+2x+1"), (r"2\sqrt{2}", r"\sqrt{8}"),
    (r"\frac{x^2-1}{x-1}", "x+1"), (r"2\sin x\cos x", r"\sin(2x)"), ("(e^x)^2", "e^{2x}"), (r"\sin^2 x+\cos^{2}x", "1"), ("x^{-1}", r"\frac{1}{x}"),
    ("2^{3}", "8"), ("x^{1/2}", r"\sqrt{x}"), (r"\sqrt[3]{x}", "x^{1/3}"), ("ab", "ba"), ("0.5x", "x/2"), ("x-x", "0"), (r"\ln(e)", "1"), (r"\pi r^2", r"r^2\pi"),
    (r"\frac{\frac{1}{2}}{x}", r"\frac{1}{2x}"), ("--x", "x"), (r"2\cdot 3^2", "18"), ("a/bc", "a/(bc)"), ("x2", "2x"), ("{1+x}", "[x+1]"), (r"\tan x", r"\frac{\sin x}{\cos x}"),
    ("x^{4}/x", "x^3"), ("-(-2)n", "2n"), ("e^{-x}", r"\frac{1}{e^{x}}"), (r"\ln 2x", r"\ln(2)+\ln x"), ("y = x+1", "1+x"), (r"-\frac{x-1}{2}", r"\frac{1-x}{2}"), (r"\sinh x", r"\frac{e^x-e^{-x}}{2}"),
    (r"\left(x+1\right)^2", "(1+x)^{2}"), ("x^{2+1}", "x^3"), ("2^{-2}", "0.25"), ("10^{10}+x", "x+10000000000"),
]
DIFFERENT = [
    ("x+2", "1+x"), ("-x^2", "(-x)^2"), ("dne", "end"), ("(1,2)", "(2,1)"), ("1/0", "2/0"), ("x/(y-y)", "x/(y-y)+1"), ("x^{2147483646}", "1"), ("3.14", r"\pi"), ("((x", "x"), ("x+", "x"), ("", "x"),
    (r"\frac{1}2", "1/2"), ("(x+1]", "x+1"), ("10^{10}+x", "10^{10}+x+1"), (r"\sqrt{-1}", "1-1"), (r"\ln(-1)", "0"), ("x<1", "1>x"), ("and", "nda"), (r"\mat x", "x"), ("()", "0"), ("*x", "x"), ("x^", "x"), ("|x|", "x"),
    ("9" * 60 + "x", "x"), ("x=1,2", "1"),
]


def test_algebraic_grades(spark):
    cases = [(p, g, True) for p, g in EQUAL] + [(g, p, True) for p, g in EQUAL if "=" not in p] + [(p, g, False) for p, g in DIFFERENT]
    df = spark.createDataFrame([(i, "", p, g) for i, (p, g, _) in enumerate(cases)], "i long, q string, p string, g string")
    got = {r.i: r.is_correct for r in A.with_grade(df, "q", "p", "g").collect()}
    assert [(p, g) for i, (p, g, want) in enumerate(cases) if got[i] is not want] == []


@pytest.mark.parametrize("s,want", [
    ("2x^3-1", "2 x 3 ^ * 1 -"), ("-x^2", "x 2 ^ neg"), ("a/bc", "a b c * /"), (r"\frac{a}{b}c", "a b / c *"), (r"\sqrt[3]{x+1}", r"3 x 1 + \root"), (r"\sin2x\cosx", r"2 x * \sin x \cos *"),
    ("2^{3^x}", "2 3 x ^ ^"), ("x^-1y", "x 1 neg ^ y *"), (r"\sin^2(x)", r"x \sin^2"), ("x+", None), ("(x", None), ("x)", None), ("x$", None), ("", None), ("{}", None), (r"\frac{a}", None),
])
def test_postfix(spark, s, want):
    got = spark.range(1).select(algebra.postfix(F.lit(s)).alias("r")).first().r
    assert (None if got is None else " ".join(got)) == want


def test_long_expressions(spark):
    many = "+".join(f"{i}x" for i in range(400))
    df = spark.createDataFrame([("", many, f"{sum(range(400))}x"), ("", many + "+1", f"{sum(range(400))}x"), ("", "(" * 200 + "x" + ")" * 200, "x")], "q string, p string, g string")
    assert [r.is_correct for r in A.with_grade(df, "q", "p", "g").collect()] == [True, False, True]
