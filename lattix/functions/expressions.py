"""The column expression language: text to an AST, then to DataFrame columns.

Loosest to tightest: XOR, OR, AND, NOT, comparison, + -, * /, ^, unary minus, call or literal.
NOT and the right side of ^ take everything that follows; unary minus binds tighter than ^.  Unlike the
evaluator this language comes from, trailing tokens are an error and undefined operands give undefined results.
Booleans are 1.0 and 0.0; whole-column functions become aggregates computed once; lag(w, x) and counts(w) are joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import finite, literal, ratio, scalars

TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|\"(?P<str>[^\"]*)\"|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|[-+*/^()<>=,&|!]))")
ALIAS = {"&": "AND", "|": "OR", "!": "NOT", "!=": "<>"}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # num, name, str, call, op
    value: object
    args: tuple = ()


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        at = m.end()
        if m["num"]:
            out.append(("num", float(m["num"])))
        elif m["str"] is not None:
            out.append(("str", m["str"]))
        elif m["name"]:
            up = m["name"].upper()
            out.append(("op", up) if up in ("AND", "OR", "NOT", "XOR") else ("name", m["name"]))
        else:
            out.append(("op", ALIAS.get(m["op"], m["op"])))
    return out


class Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def peek(self) -> object:
        t = self.toks[self.at] if self.at < len(self.toks) else ("end", None)
        return t[1] if t[0] == "op" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise ExpressionError(f"expected {op}")
        self.at += 1

    def parse(self) -> Node:
        n = self.level(0)
        if self.at < len(self.toks):
            raise ExpressionError(f"unexpected {self.toks[self.at][1]!r} after the expression")
        return n

    LEVELS = (("XOR",), ("OR",), ("AND",), None, ("<", "<=", ">", ">=", "=", "<>"), ("+", "-"), ("*", "/"))

    def level(self, i: int) -> Node:
        if i == len(self.LEVELS):
            return self.power()
        if self.LEVELS[i] is None:
            if self.peek() == "NOT":
                self.at += 1
                return Node("op", "NOT", (self.level(0),))
            return self.level(i + 1)
        left = self.level(i + 1)
        while self.peek() in self.LEVELS[i]:
            op = self.peek()
            self.at += 1
            left = Node("op", op, (left, self.level(i + 1)))
        return left

    def power(self) -> Node:
        left = self.primary()
        if self.peek() == "^":
            self.at += 1
            return Node("op", "^", (left, self.level(0)))
        return left

    def primary(self) -> Node:
        if self.peek() in ("-", "+"):
            op = self.peek()
            self.at += 1
            inner = self.primary()
            return Node("op", "neg", (inner,)) if op == "-" else inner
        if self.peek() == "(":
            self.at += 1
            inner = self.level(0)
            self.take(")")
            return inner
        if self.at >= len(self.toks):
            raise ExpressionError("unexpected end")
        kind, value = self.toks[self.at]
        if kind == "op":
            raise ExpressionError(f"unexpected {value!r}")
        self.at += 1
        if kind == "name" and self.peek() == "(":
            self.at += 1
            args = []
            while self.peek() != ")":
                args.append(self.level(0))
                if self.peek() == ",":
                    self.at += 1
                elif self.peek() != ")":
                    raise ExpressionError("expected , or )")
            self.at += 1
            return Node("call", value.lower(), tuple(args))
        return Node(kind, value)


def _bool(c: Column) -> Column:
    return c.cast("double")


def _true(c: Column) -> Column:
    return c != 0


SIMPLE = {
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "cos": F.cos, "sin": F.sin, "tan": F.tan, "acos": F.acos, "asin": F.asin, "atan": F.atan, "abs": F.abs, "fabs": F.abs,
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x: F.round(x), "log": lambda x: F.when(x > 0, F.ln(x)),
    "ln": lambda x: F.when(x > 0, F.ln(x)), "log10": lambda x: F.when(x > 0, F.log10(x)), "pow": F.pow,
}
WHOLE = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "stddev": F.stddev_samp, "max": F.max, "min": F.min}
ORDERED = ("rot_up", "rot_down", "enumerate", "shuffle")
TESTS = {"is_defined", "is_finite", "is_nan", "is_pos_inf", "is_neg_inf", "is_inf"}


class Compiler:
    """Compiles nodes against a DataFrame; joins and aggregates are added to self.df as they are met."""

    def __init__(self, df: DataFrame, key: str, weights: dict[str, DataFrame], seed: int = 1):
        self.df, self.key, self.weights, self.seed, self.count = df, key, weights, seed, 0

    def fresh(self, c: Column) -> str:
        self.count += 1
        name = f"__e{self.count}"
        self.df = self.df.withColumn(name, c)
        return name

    def raw(self, n: Node) -> Column:
        """Like column(), but division keeps infinities (for the is_* tests)."""
        if n.kind == "op" and n.value == "/":
            a, b = (self.column(x) for x in n.args)
            return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a == 0, float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
        return self.column(n)

    def column(self, n: Node) -> Column:
        if n.kind == "num":
            return F.lit(n.value)
        if n.kind == "name":
            if n.value not in self.df.columns:
                raise ExpressionError(f"unknown variable {n.value}")
            return F.col(n.value).cast("double")
        if n.kind == "str":
            raise ExpressionError("a string is no number")
        if n.kind == "op":
            args = [self.column(a) for a in n.args]
            return self.operator(n.value, args)
        return self.call(n)

    def operator(self, op: str, a: list[Column]) -> Column:
        if op == "neg":
            return -a[0]
        if op == "NOT":
            return _bool(~_true(a[0]))
        x, y = a
        if op in ("AND", "OR"):
            return _bool(_true(x) & _true(y) if op == "AND" else _true(x) | _true(y))
        return {
            "XOR": lambda: _bool(_true(x) != _true(y)), "<": lambda: _bool(x < y), "<=": lambda: _bool(x <= y), ">": lambda: _bool(x > y), ">=": lambda: _bool(x >= y), "=": lambda: _bool(x == y),
            "<>": lambda: _bool(x != y), "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: ratio(x, y), "^": lambda: finite(F.pow(x, y)),
        }[op]()

    def call(self, n: Node) -> Column:
        f, args = n.value, n.args
        if f in ("lag", "counts"):
            w = self.weights.get(str(args[0].value))
            if w is None:
                raise ExpressionError(f"unknown weights {args[0].value}")
            from lattix.operators.weights import neighbour_counts

            self.count += 1
            name = f"__e{self.count}"
            if f == "counts":
                side = neighbour_counts(self.df, self.key, w).withColumnRenamed("n", name)
            else:
                x = self.fresh(self.column(args[1]))
                v = self.df.select(F.col(self.key).alias("dst"), F.col(x).alias("x"))
                side = w.join(v, "dst").groupBy(F.col("src").alias(self.key)).agg(F.avg("x").alias(name))
            self.df = self.df.join(side, self.key, "left")
            return F.col(name).cast("double")
        if f in TESTS:
            x = self.raw(args[0])
            nan, inf = F.isnan(x), F.abs(x) == float("inf")
            out = {"is_defined": x.isNotNull(), "is_finite": ~nan & ~inf, "is_nan": nan, "is_pos_inf": x == float("inf"), "is_neg_inf": x == float("-inf"), "is_inf": inf & ~nan}[f]
            return _bool(F.coalesce(out, F.lit(False)))
        if f in ("unif_dist", "norm_dist"):
            from lattix.operators import calculators

            self.seed += 2
            if f == "unif_dist":
                return calculators.uniform(F.col(self.key), self.seed)
            mean, sd = (self.constant(a) for a in args[1:3]) if len(args) == 3 else (0.0, 1.0)
            if sd < 0:
                raise ExpressionError("a standard deviation of 0 or more is needed")
            return calculators.normal(F.col(self.key), self.seed, mean, sd)
        if f in ORDERED:
            from lattix.operators import calculators

            x = self.fresh(self.column(args[0]))
            self.count += 1
            name = f"__e{self.count}"
            if f == "enumerate":
                self.df = calculators.enumerate_rows(self.df, self.key, name, *[self.constant(a) for a in args[1:]])
            elif f == "shuffle":
                self.df = calculators.shuffle(self.df, self.key, x, name, self.seed)
            else:
                self.df = calculators.rotate(self.df, self.key, x, name, up=f == "rot_up")
            return F.col(name)
        if f in WHOLE or f in ("dev_fr_mean", "standardize"):
            x = self.fresh(finite(self.column(args[0])))
            if f in WHOLE:
                return literal(scalars(self.df, v=WHOLE[f](x))["v"])
            s = scalars(self.df, m=F.avg(x), sd=F.stddev_samp(x))
            dev = F.col(x) - literal(s["m"])
            return dev if f == "dev_fr_mean" else ratio(dev, literal(s["sd"]))
        if f in SIMPLE:
            return finite(SIMPLE[f](*[self.column(a) for a in args]))
        raise ExpressionError(f"unknown function {f}")

    def constant(self, n: Node) -> float:
        if n.kind == "num":
            return n.value
        if n.kind == "op" and n.value == "neg":
            return -self.constant(n.args[0])
        raise ExpressionError("a number is needed")


def evaluate(df: DataFrame, key: str, text: str, into: str, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """df with the expression's value as a column (non-finite results are undefined)."""
    c = Compiler(df, key, weights or {})
    tree = Parser(text).parse()
    try:
        value = c.column(tree)
    except (IndexError, TypeError) as e:
        raise ExpressionError(f"wrong number or kind of arguments in {text!r}") from e
    return c.df.withColumn("__value", finite(value)).select(*df.columns, F.col("__value").alias(into))


def select(df: DataFrame, key: str, text: str, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows for which the expression is defined and not zero."""
    return evaluate(df, key, text, "__keep", weights).where(F.col("__keep") != 0).drop("__keep")
