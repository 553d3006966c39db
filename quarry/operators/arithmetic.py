"""Answers to arithmetic questions: tokens, and a fold over them with a stack of values and one of operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number, an operator, a parenthesis.
TOKEN = r"\d+\.?\d*|\.\d+|[-+*/()]"
#: How strongly an operator binds: signs above products above sums; an open parenthesis ends all.
BINDS = {"(": 0, "+": 1, "-": 1, "*": 2, "/": 2, "u+": 3, "u-": 3}


def _struct(vals: Column, ops: Column, want: Column, ok: Column) -> Column:
    return F.struct(vals.alias("vals"), ops.alias("ops"), want.alias("want"), ok.alias("ok"))


def _top(s: Column) -> Column:
    return F.coalesce(F.element_at(F.concat(F.array(F.lit("(")), s.ops), -1), F.lit("("))


def _less(x: Column, n: int) -> Column:
    return F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0)))


def _applied(s: Column) -> Column:
    """The state after the topmost operator has been applied to the topmost values."""
    op, padded = _top(s), F.concat(F.array(F.lit(0.0), F.lit(0.0)), s.vals)
    a, b = F.element_at(padded, -2), F.element_at(padded, -1)
    sign = op.isin("u+", "u-")
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b)).when(op == "u-", -b).otherwise(b)
    vals = F.concat(_less(s.vals, 1), F.array(value))
    vals = F.when(sign, vals).otherwise(F.concat(_less(s.vals, 2), F.array(value)))
    return _struct(vals, _less(s.ops, 1), s.want, s.ok & value.isNotNull())


def _while(s: Column, least: Column, most: int) -> Column:
    """The state after all operators that bind at least so strongly have been applied, down to an open parenthesis."""
    binds = F.create_map(*[F.lit(x) for pair in BINDS.items() for x in pair])
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), s, lambda t, _: F.when((F.size(t.ops) > 0) & (binds[_top(t)] >= F.greatest(least, F.lit(1))), _applied(t)).otherwise(t))


def value(expression: Column, most: int) -> Column:
    """The value of an expression of numbers, + - * /, signs and parentheses; null where it is none, has more than most operators, or divides by zero."""
    bare = F.regexp_replace(expression, r"\s+", "")
    tokens = F.regexp_extract_all(expression, F.lit(TOKEN), 0)

    def step(s: Column, token: Column) -> Column:
        number = token.rlike(r"\d")
        fine = number & s.want & ~token.rlike(r"^0\d*[1-9]\d*$")
        bad = _struct(s.vals, s.ops, s.want, F.lit(False))
        binds = F.when(token.isin("*", "/"), 2).otherwise(1)
        pushed = _struct(F.concat(s.vals, F.array(token.try_cast("double"))), s.ops, F.lit(False), s.ok)
        opened = _struct(s.vals, F.concat(s.ops, F.array(token)), F.lit(True), s.ok)
        signed = _struct(s.vals, F.concat(s.ops, F.array(F.concat(F.lit("u"), token))), F.lit(True), s.ok)
        done = _while(s, F.when(token == ")", 1).otherwise(binds), most)
        # the stacks after what binds as strongly has been applied
        inner = F.transform(F.array(done), lambda d: F.when(token == ")", _struct(d.vals, _less(d.ops, 1), F.lit(False), d.ok & (F.size(d.ops) > 0))).otherwise(_struct(d.vals, F.concat(d.ops, F.array(token)), F.lit(True), d.ok)))[0]
        return (
            F.when(~s.ok, s)
            .when(number, F.when(fine, pushed).otherwise(bad))
            .when(token == "(", F.when(s.want, opened).otherwise(bad))
            .when(s.want, F.when(token.isin("+", "-"), signed).otherwise(bad))
            .otherwise(inner)
        )

    start = _struct(F.array().cast("array<double>"), F.array().cast("array<string>"), F.lit(True), F.lit(True))
    end = F.aggregate(tokens, start, step, lambda s: F.transform(F.array(_while(s, F.lit(1), most)), lambda d: F.when(d.ok & ~d.want & (F.size(d.ops) == 0) & (F.size(d.vals) == 1), F.get(d.vals, F.lit(0))))[0])
    whole = (F.array_join(tokens, "") == bare) & ~expression.rlike(r"[\d.]\s+[\d.]")
    few = F.length(F.regexp_replace(expression, r"[^-+*/]", "")) <= most
    return F.when(whole & few & (F.size(tokens) > 0), end)


def _eighths(part: Column) -> Column:
    """A part of one as hundred-millionths, of two as near the even one, by the double's exact value: its bits down to 2^-90 as a whole number."""
    whole = lambda x: F.floor(x).cast("decimal(10,0)")
    a = part * float(1 << 30)
    b = (a - F.floor(a)) * float(1 << 30)
    c = (b - F.floor(b)) * float(1 << 30)
    n = lambda k: F.lit(str(k)).cast(f"decimal({len(str(k))},0)")
    bits = (whole(a) * n(1 << 60) + whole(b) * n(1 << 30) + whole(c)) * n(10**8)
    rest = bits % n(1 << 90)
    down = ((bits - rest) / n(1 << 90)).cast("long")
    return down + ((rest > n(1 << 89)) | ((rest == n(1 << 89)) & (down % 2 == 1))).cast("long")


def shown(number: Column) -> Column:
    """A whole number as it is, another with eight places at most."""
    def one(x: Column) -> Column:
        below = F.floor(F.abs(x))
        part = F.transform(F.array(_eighths(F.abs(x) - below)), lambda e: F.concat((below + F.when(e == 10**8, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((e % 10**8).cast("string"), 8, "0")))[0]
        cut = F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(F.regexp_replace(part, "0+$", ""), r"\.$", ""))
        return F.when(x.isNull() | (F.abs(x) >= 1e37), F.lit(None)).when(F.abs(x - F.round(x)) < 1e-9, F.round(x).cast("decimal(38,0)").cast("string")).otherwise(cut)

    return F.transform(F.array(number), one)[0]


def answer(question: Column, most: int = 2) -> Column:
    """The answer to a question of digits, operators, parentheses, = and ? alone; null for every other."""
    asked = F.trim(F.coalesce(question, F.lit("")))
    fits = asked.rlike(r"\d") & asked.rlike(r"^[\d\s+\-*/().=?]+$")
    return F.when(fits, shown(value(F.trim(F.regexp_replace(asked, "[=?]", " ")), most)))
