"""Equality of answers that need algebra, as Column expressions (no Python in tasks, no solver).

An answer is cut into tokens, put into postfix order by operator precedence in
one fold over the tokens, and evaluated by a second fold at fixed points:

* modulo the prime 2**31 - 1, which is exact for rational expressions, and
* in real numbers, for roots, powers and functions.

Two rational expressions are equal when all residues agree.  If they differ, their
difference is a fraction whose numerator of degree d vanishes at a random point
with a probability of at most d / (2**31 - 1) (Schwartz-Zippel); with ``POINTS`` = 3 independent
points the odds of a false "equal" are below 1e-19 up to degree 1000.  The points are pseudo-random and
fixed, so the same rows always get the same answer.  Where either side holds a function, a root or a power that is no
integer up to ``MAX_POWER``, both are compared as real numbers: equal when they agree to ``REAL_TOLERANCE`` at all points.

Letters (and Greek commands) are variables, pi and e are themselves among real numbers and
variables among residues.  Juxtaposition is a product that binds tighter than ``/``;
a function applies to the product that follows it, up to the next function.  Not read, and so never equal to
anything by this test: relations, lists, intervals, matrices, absolute values, words of three letters and more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravel.functions.text import col_

PRIME = 2**31 - 1
POINTS = 3
MAX_POWER = 4096
REAL_TOLERANCE = 1e-9
_SMALL = 10**6  # integers up to here are followed exactly, for exponents

FUNCTIONS = ("arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "sin", "cos", "tan", "sec", "csc", "cot", "ln", "log", "exp")
GREEK = ("alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "nu", "rho", "sigma", "tau", "phi",
         "varphi", "omega", "psi", "pi", "infty")
_NAMES = "|".join(FUNCTIONS)
# white space is gone when an answer is read, so a known command ends where its name ends: \\sinx is \\sin x
_KNOWN = "|".join((*FUNCTIONS, *GREEK, "frac", "sqrt", "cdot(?!s)", "times", "div"))
_TOKEN = rf"\\(?:{_NAMES})\^(?:\d|\{{\d+\}})|\\(?:{_KNOWN})|\\[A-Za-z]+|\d+(?:\.\d+)?|\.\d+|[A-Za-z]|[-+*/^(){{}}\[\]·×÷−]"
_WORD = r"[A-Za-z]{3,}"
_RPN = "array<string>"
_OPS = "array<struct<p:int,s:string>>"
_VALUE = "struct<m:bigint,r:double,n:bigint,q:boolean>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _case(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = reduce(lambda c, x: c.when(*x), pairs[1:], F.when(*pairs[0]))
    return out.otherwise(otherwise)


def looks_algebraic(c: Column | str) -> Column:
    """Only characters that an expression can hold, and no word."""
    s = col_(c)
    bare = F.regexp_replace(s, r"\\[A-Za-z]+", " ")
    return (s != "") & s.rlike(r"\A[-A-Za-z0-9.+*/^(){}\[\]\\·×÷−]+\z") & ~bare.rlike(_WORD)


def _tokens(s: Column) -> Column:
    """Kind, text and precedence of every token; kind ``x`` is not understood."""
    def classified(t: Column) -> Column:
        t = _case([(t.isin("\\cdot", "\\times", "·", "×"), F.lit("*")), (t.isin("\\div", "÷"), F.lit("/")), (t == "−", F.lit("-"))], t)

        def kind(t: Column) -> Column:
            return _case([
                (t.isin("(", "{", "["), F.lit("(")), (t.isin(")", "}", "]"), F.lit(")")),
                (t.isin("+", "-", "*", "/", "^"), F.lit("b")), (t == "\\frac", F.lit("F")), (t == "\\sqrt", F.lit("s")),
                (t.rlike(rf"\A\\(?:{_NAMES})(?:\^.*)?\z"), F.lit("f")),
                (~t.startswith("\\") | t.isin(*[f"\\{g}" for g in GREEK]), F.lit("o")),
            ], F.lit("x"))

        prec = lambda t: _case([(t.isin("+", "-"), F.lit(10)), (t.isin("*", "/"), F.lit(20)), (t == "^", F.lit(50))], F.lit(0))
        return _let(t, lambda t: F.struct(kind(t).alias("k"), t.alias("s"), prec(t).alias("p")))

    found = F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0))
    whole = _let(found, lambda f: F.when(F.array_join(f, "") == s, f).otherwise(F.array(F.lit("\\"))))
    return F.transform(whole, classified)


_FUNC, _IMPLICIT, _UNARY, _ROOT = 25, 30, 40, 45


def postfix(c: Column | str) -> Column:
    """The tokens in postfix order (``neg`` is the unary minus), null where the text is no expression."""
    op = lambda p, s: F.struct((F.lit(p) if isinstance(p, int) else p).cast("int").alias("p"), (F.lit(s) if isinstance(s, str) else s).alias("s"))

    def state(out, ops, want, ok) -> Column:
        return F.struct(out.alias("out"), ops.alias("ops"), (F.lit(want) if isinstance(want, bool) else want).alias("want"), ok.alias("ok"))

    def names(ops: Column) -> Column:
        return F.transform(F.reverse(ops), lambda x: x["s"])

    def after(ops: Column, at: Column) -> Column:
        return F.slice(ops, at + 1, F.size(ops) - at)

    def step(a: Column, t: Column) -> Column:
        k, s = t["k"], t["s"]
        implicit = ~a["want"] & k.isin("o", "(", "f", "s", "F")
        binary = ~a["want"] & (k == "b")
        power = _case([(implicit & (k == "f"), F.lit(20)), (implicit, F.lit(_IMPLICIT)), (binary, t["p"])], F.lit(None).cast("int"))
        sign = F.when(binary, s).otherwise("*")
        # where a is waiting for the second part of a fraction or the body of a root, only a brace will do
        waiting = F.coalesce(F.get(a["ops"], F.size(a["ops"]) - 1)["s"].isin("F0", "F1", "\\root"), F.lit(False))
        ok = a["ok"] & (k != "x") & ~(a["want"] & waiting & (s != "{")) & ~((k == ")") & a["want"])
        ok = ok & ~(a["want"] & (k == "b") & ~s.isin("+", "-"))

        def with_sign(o: Column) -> Column:
            bound = F.when(o["s"] == "^", o["p"] + 1).otherwise(o["p"])
            cut = F.when(o["p"].isNull(), F.size(a["ops"])).otherwise(
                _let(bound, lambda b: F.coalesce(F.array_max(F.transform(a["ops"], lambda x, i: F.when(x["p"] < b, i + 1))), F.lit(0))))
            return _let(cut, lambda at: F.struct(
                F.concat(a["out"], names(after(a["ops"], at))).alias("out"),
                F.concat(F.slice(a["ops"], 1, at), F.when(o["p"].isNotNull(), F.array(op(o["p"], o["s"]))).otherwise(F.array().cast(_OPS))).alias("ops")))

        def closed(u: Column) -> Column:
            def at_open(j: Column) -> Column:
                opened = F.get(u["ops"], j - 1)["s"]
                fits = F.coalesce(F.concat(opened, s).isin("()", "{}", "[]"), F.lit(False))
                out = F.concat(u["out"], names(after(u["ops"], F.coalesce(j, F.lit(0)))))
                rest = F.slice(u["ops"], 1, F.greatest(F.coalesce(j, F.lit(1)) - 1, F.lit(0)))

                def done(r: Column) -> Column:
                    top = F.get(r["rest"], F.size(r["rest"]) - 1)
                    below = F.slice(r["rest"], 1, F.greatest(F.size(r["rest"]) - 1, F.lit(0)))
                    good = ok & fits
                    return _case([
                        (top["s"] == "F0", state(r["out"], F.concat(below, F.array(op(0, "F1"))), True, good & (s == "}"))),
                        (top["s"] == "F1", state(F.concat(r["out"], F.array(F.lit("/"))), below, False, good & (s == "}"))),
                        ((top["s"] == "\\sqrt") & (s == "]"), state(r["out"], F.concat(below, F.array(op(_ROOT, "\\root"))), True, good)),
                        (top["p"].isin(_FUNC, _ROOT), state(F.concat(r["out"], F.array(top["s"])), below, False, good)),
                    ], state(r["out"], r["rest"], False, good))

                return _let(F.struct(out.alias("out"), rest.alias("rest")), done)

            return _let(F.array_max(F.transform(u["ops"], lambda x, i: F.when(x["p"] == 0, i + 1))), at_open)

        def taken(u: Column) -> Column:
            push = lambda p, name: state(u["out"], F.concat(u["ops"], F.array(op(p, name))), True, ok)
            return _case([
                (k == "o", state(F.concat(u["out"], F.array(s)), u["ops"], False, ok)),
                (k == "(", push(0, s)),
                (k == ")", closed(u)),
                (k == "f", push(_FUNC, s)),
                (k == "s", push(_ROOT, s)),
                (k == "F", push(0, "F0")),
                (a["want"] & (s == "-"), push(_UNARY, "neg")),
            ], state(u["out"], u["ops"], True, ok))

        return F.when(~a["ok"], a).otherwise(_let(op(power, sign), lambda o: _let(with_sign(o), taken)))

    def finish(a: Column) -> Column:
        whole = a["ok"] & ~a["want"] & ~F.exists(a["ops"], lambda x: (x["p"] == 0) | (x["s"] == "\\root"))
        return F.when(whole, F.concat(a["out"], names(a["ops"])))

    start = state(F.array().cast(_RPN), F.array().cast(_OPS), True, F.lit(True))
    return F.aggregate(_tokens(col_(c)), start, step, finish)


def _value(m: Column, r: Column, n: Column | None = None, q: Column | bool = True) -> Column:
    none = F.lit(None).cast("bigint")
    return F.struct(m.cast("bigint").alias("m"), r.cast("double").alias("r"), (none if n is None else n.cast("bigint")).alias("n"),
                    (F.lit(q) if isinstance(q, bool) else q).alias("q"))


def _modpow(base: Column, exponent: Column) -> Column:
    """``base`` to a power of 0 and more, modulo the prime: the bits of the power from the highest on."""
    bits = F.split(F.bin(exponent), "")
    start = F.struct(F.lit(1).cast("bigint").alias("x"), base.alias("b"))

    def square(a: Column, bit: Column) -> Column:
        twice = (a["x"] * a["x"]) % PRIME
        return F.struct(F.when(bit == "1", (twice * a["b"]) % PRIME).otherwise(twice).alias("x"), a["b"].alias("b"))

    return F.aggregate(bits, start, square, lambda a: a["x"])


def _inverse(m: Column) -> Column:
    """Inverse modulo the prime, null for 0."""
    return F.when(m != 0, _modpow(m, F.lit(PRIME - 2).cast("bigint")))


def _operand(t: Column, point: Column) -> Column:
    """A number, a constant or the point's value of a variable."""
    digits, decimals = F.regexp_replace(t, r"\.", ""), F.length(F.regexp_extract(t, r"\.(\d+)", 1))
    whole = digits.try_cast("decimal(38,0)")
    m = (whole % F.lit(PRIME).cast("decimal(38,0)")).cast("bigint")
    scaled = F.when(decimals == 0, m).otherwise((m * _inverse(_modpow(F.lit(10).cast("bigint"), decimals.cast("bigint")))) % PRIME)
    number = _value(scaled, t.try_cast("double"), F.when((decimals == 0) & (whole <= _SMALL), whole.cast("bigint")))
    drawn = F.pmod(F.xxhash64(t, point), F.lit(PRIME - 1)) + 1
    real = _case([(t == "e", F.lit(2.718281828459045)), (t == "\\pi", F.lit(3.141592653589793))], 0.5 + 1.5 * drawn / PRIME)
    return F.when(t.rlike(r"\A[\d.]"), number).otherwise(_value(drawn, real))


def _applied(t: Column, a: Column) -> Column:
    """A function of one argument, or a power of one: ``\\sin``, ``\\sin^2``."""
    x = a["r"]
    name, power = F.regexp_extract(t, r"\\([a-z]+)", 1), F.regexp_extract(t, r"(\d+)", 1)
    over = lambda y: F.lit(1.0) / F.nullif(y, F.lit(0.0))
    y = _case([
        (name == "sin", F.sin(x)), (name == "cos", F.cos(x)), (name == "tan", F.tan(x)), (name == "sec", over(F.cos(x))),
        (name == "csc", over(F.sin(x))), (name == "cot", over(F.tan(x))), (name == "arcsin", F.asin(x)), (name == "arccos", F.acos(x)),
        (name == "arctan", F.atan(x)), (name == "sinh", F.sinh(x)), (name == "cosh", F.cosh(x)), (name == "tanh", F.tanh(x)), (name == "ln", F.ln(x)), (name == "log", F.log10(x)), (name == "exp", F.exp(x)), (name == "sqrt", F.sqrt(x)),
    ], F.lit(None).cast("double"))
    return _value(F.lit(0), F.when(power == "", y).otherwise(F.pow(y, power.cast("double"))), q=False)


def _joined(t: Column, a: Column, b: Column) -> Column:
    small = (F.abs(a["n"]) <= _SMALL) & (F.abs(b["n"]) <= _SMALL)
    both = a["q"] & b["q"]
    whole = a["q"] & (F.abs(b["n"]) <= MAX_POWER)
    raised = _modpow(a["m"], F.abs(b["n"]))
    return _case([
        (t == "+", _value((a["m"] + b["m"]) % PRIME, a["r"] + b["r"], F.when(small, a["n"] + b["n"]), both)),
        (t == "-", _value((a["m"] - b["m"] + PRIME) % PRIME, a["r"] - b["r"], F.when(small, a["n"] - b["n"]), both)),
        (t == "*", _value((a["m"] * b["m"]) % PRIME, a["r"] * b["r"], F.when(small, a["n"] * b["n"]), both)),
        (t == "/", _value((a["m"] * F.when(both, _inverse(b["m"])).otherwise(0)) % PRIME, a["r"] / F.nullif(b["r"], F.lit(0.0)), None, both)),
        ((t == "^") & whole, _value(F.when(b["n"] < 0, _inverse(raised)).otherwise(raised), F.pow(a["r"], b["r"]))),
        (t == "^", _value(F.lit(0), F.pow(a["r"], b["r"]), q=False)),
        (t == "\\root", _value(F.lit(0), F.pow(b["r"], F.lit(1.0) / F.nullif(a["r"], F.lit(0.0))), q=False)),
    ], F.lit(None).cast(_VALUE))


def _evaluated(rpn: Column, point: Column) -> Column:
    """The value at one point; null for a division by zero or a number too long to read."""
    def step(st: Column, t: Column) -> Column:
        n = F.size(st)
        a, b = F.get(st, n - 2), F.get(st, n - 1)
        keep = lambda k: F.slice(st, 1, F.greatest(n - k, F.lit(0)))
        negative = lambda v: _value((PRIME - v["m"]) % PRIME, -v["r"], -v["n"], v["q"])
        return _case([
            (t.isin("+", "-", "*", "/", "^", "\\root"), F.concat(keep(2), F.array(_joined(t, a, b)))),
            (t == "neg", F.concat(keep(1), F.array(negative(b)))),
            (t.rlike(rf"\A\\(?:{_NAMES}|sqrt)(?:\^.*)?\z"), F.concat(keep(1), F.array(_applied(t, b)))),
        ], F.concat(st, F.array(_operand(t, point))))

    return F.aggregate(rpn, F.array().cast(f"array<{_VALUE}>"), step, lambda st: F.get(st, 0))


def values(texts: Column | str) -> Column:
    """For every text of an array, its values at all points; null for a null text and for one that is no expression."""
    def at_points(rpn: Column) -> Column:
        points = F.array(*[F.lit(k) for k in range(POINTS)])
        return F.when(rpn.isNotNull(), F.transform(points, lambda k: _evaluated(rpn, k)))

    # one tree of expressions for all texts and points: they are large, and plans copy them
    return F.transform(col_(texts), lambda s: F.when(s.isNotNull(), _let(postfix(s), at_points)))


def same_values(a: Column, b: Column) -> Column:
    """Equality of two elements of :func:`values`; false where either side has no value."""
    def close(x: Column, y: Column) -> Column:
        exact = x["m"] == y["m"]
        bound = F.lit(REAL_TOLERANCE) * F.greatest(F.lit(1.0), F.abs(y["r"]))
        near = ~F.isnan(x["r"]) & ~F.isnan(y["r"]) & (F.abs(x["r"]) < 1e300) & (F.abs(x["r"] - y["r"]) <= bound)
        return F.coalesce(F.when(x["q"] & y["q"], exact).otherwise(near), F.lit(False))

    return F.coalesce(F.forall(F.zip_with(a, b, close), lambda x: x), F.lit(False))
