"""Value sources and the expression language, as column expressions.

Numbers are doubles with their usual arithmetic: division by zero is an infinity
or not a number, never an error and never null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")
#: Kilometres of the mean earth radius.
EARTH_KM = 6371.0087714


def const(x: float | str) -> Column:
    return F.lit(x)


def field(name: str) -> Column:
    return F.col(name)


def enum_name(column: Column, names: Mapping[int, str]) -> Column:
    """The name of an enumeration's number; null for one that has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), column)


def first_of(*values: Column) -> Column:
    return F.coalesce(*values)


def if_(condition: Column, then: Column, other: Column) -> Column:
    """``then`` where the condition is true or a number other than 0; a missing condition is false."""
    return F.when(F.coalesce(condition.cast("boolean"), F.lit(False)), then).otherwise(other)


def exists(value: Column) -> Column:
    return value.isNotNull()


def not_(value: Column) -> Column:
    return ~value.cast("boolean")


def all_true(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, [v.cast("boolean") for v in values])


def any_true(*values: Column) -> Column:
    return reduce(lambda a, b: a | b, [v.cast("boolean") for v in values])


def divide(a: Column, b: Column) -> Column:
    """a / b in doubles."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF)).otherwise(F.lit(_NAN))
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(b.isNull() | a.isNull(), None).otherwise(F.when(F.isnan(a), F.lit(_NAN)).otherwise(at_zero))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def linear(x: Column, slope: float, intercept: float) -> Column:
    return x * slope + intercept


def total(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, values)


def product(*values: Column) -> Column:
    return reduce(lambda a, b: a * b, values)


def largest(*values: Column) -> Column:
    """The largest; missing values do not count."""
    return F.greatest(*values) if len(values) > 1 else values[0]


def smallest(*values: Column) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def reciprocal(x: Column, m: float, a: float, b: float) -> Column:
    """a / (m x + b)."""
    return divide(F.lit(a), x * m + b)


def edge_reciprocal(distance: Column, edge: float) -> Column:
    """What falls from 1 at distance 0 to a tenth at ``edge``: c / (d + c)."""
    c = edge * 0.1
    return c / (distance + c)


def scaled(rows: DataFrame, column: str, low: float, high: float, out: str = "scaled") -> DataFrame:
    """``rows`` with ``column`` mapped linearly so that its range over all rows becomes low to high; one range aggregate, no window."""
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    return rows.withColumn(out, F.when(b == a, F.lit(float(low))).otherwise((F.col(column) - a) / F.nullif(b - a, F.lit(0)) * (high - low) + low))


def max_doc(docs: DataFrame, key: str = "doc_id") -> Column:
    return docs.agg(F.max(key) + 1).scalar()


def num_docs(docs: DataFrame) -> Column:
    return docs.agg(F.count("*")).scalar()


def vector(*values: Column) -> Column:
    return F.array(*values)


# --- expressions

_TOKEN = re.compile(r"""\s*(?:(0[xX][0-9a-fA-F]+)|((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*|\[(?:\d+|"[^"]*"|'[^']*')\])*)|(>>>|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%<>!~&^|?:(),]))""")


def haversin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


#: Functions of expressions by name, with how many arguments they take.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    **{name: (1, getattr(F, name)) for name in "abs acos acosh asin asinh atan atanh cos cosh exp floor log10 sin sinh sqrt tan tanh".split()},
    "ceil": (1, F.ceil),
    "ln": (1, F.ln),
    "atan2": (2, F.atan2),
    "logn": (2, lambda base, x: F.ln(x) / F.ln(base)),
    "max": (2, F.greatest),
    "min": (2, F.least),
    "pow": (2, F.pow),
    "haversin": (4, haversin),
}
#: Binary operators by how loosely they bind.
_LEVELS = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", "<=", ">", ">="], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]


class _Parser:
    """Recursive descent over one expression; every value is a double, truth is 1 or 0."""

    def __init__(self, source: str, bindings: Callable[[str], Column]):
        self.source, self.bindings, self.items, at = source, bindings, [], 0
        while at < len(source.rstrip()):
            hit = _TOKEN.match(source, at)
            if not hit:
                raise ValueError(f"not an expression at {at}: {source}")
            self.items.append((hit.lastindex, hit[hit.lastindex]))
            at = hit.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] == 4 else None

    def take(self, what: str) -> None:
        if self.peek() != what:
            raise ValueError(f"{what} expected in {self.source}")
        self.at += 1

    def parse(self) -> Column:
        out = self.choice()
        if self.at != len(self.items):
            raise ValueError(f"more than an expression: {self.source}")
        return out

    def choice(self) -> Column:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.at += 1
        then = self.choice()
        self.take(":")
        return F.when(test != 0, then).otherwise(self.choice())

    def binary(self, level: int) -> Column:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while (op := self.peek()) in _LEVELS[level]:
            self.at += 1
            left = _apply(op, left, self.binary(level + 1))
        return left

    def unary(self) -> Column:
        op = self.peek()
        if op not in ("-", "+", "!", "~"):
            return self.primary()
        self.at += 1
        x = self.unary()
        return {"-": lambda: -x, "+": lambda: x, "!": lambda: _truth(x == 0), "~": lambda: F.bitwise_not(x.cast("long")).cast("double")}[op]()

    def primary(self) -> Column:
        if self.peek() == "(":
            self.at += 1
            out = self.choice()
            self.take(")")
            return out
        if self.at >= len(self.items) or self.items[self.at][0] == 4:
            raise ValueError(f"a value is missing in {self.source}")
        kind, text = self.items[self.at]
        self.at += 1
        if kind == 1:
            return F.lit(float(int(text, 16)))
        if kind == 2:
            octal = len(text) > 1 and text[0] == "0" and text.isdigit() and not set("89") & set(text)
            return F.lit(float(int(text, 8) if octal else float(text)))
        if self.peek() != "(":
            return self.bindings(text).cast("double")
        if text not in FUNCTIONS:
            raise ValueError(f"no such function: {text}")
        self.at += 1
        given = []
        while self.peek() != ")":
            given.append(self.choice())
            if self.peek() == ",":
                self.at += 1
        self.at += 1
        n, f = FUNCTIONS[text]
        if len(given) != n:
            raise ValueError(f"{text} takes {n} arguments")
        return f(*given).cast("double")


def _truth(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _apply(op: str, a: Column, b: Column) -> Column:
    whole = lambda x: x.cast("long")
    if op in ("<<", ">>", ">>>"):
        name = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[op]
        return F.call_function(name, whole(a), b.cast("int")).cast("double")
    return {
        "||": lambda: _truth((a != 0) | (b != 0)),
        "&&": lambda: _truth((a != 0) & (b != 0)),
        "|": lambda: whole(a).bitwiseOR(whole(b)).cast("double"),
        "^": lambda: whole(a).bitwiseXOR(whole(b)).cast("double"),
        "&": lambda: whole(a).bitwiseAND(whole(b)).cast("double"),
        "==": lambda: _truth(a == b),
        "!=": lambda: _truth(a != b),
        "<": lambda: _truth(a < b),
        "<=": lambda: _truth(a <= b),
        ">": lambda: _truth(a > b),
        ">=": lambda: _truth(a >= b),
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: divide(a, b),
        "%": lambda: F.when(b == 0, F.lit(_NAN)).otherwise(a % F.nullif(b, F.lit(0.0))),
    }[op]()


def _bound(bindings: Mapping[str, Column] | None) -> Callable[[str], Column]:
    def find(name: str) -> Column:
        if bindings and name in bindings:
            return bindings[name]
        parts = re.findall(r"[A-Za-z_$][\w$]*|\[\d+\]|\[\"[^\"]*\"\]|\['[^']*'\]", name)
        column = bindings[parts[0]] if bindings and parts[0] in bindings else F.col(parts[0])
        for p in parts[1:]:
            column = column.getItem(int(p[1:-1])) if p[0] == "[" and p[1].isdigit() else column.getItem(p[2:-2]) if p[0] == "[" else column.getField(p)
        return column

    return find


def expression(source: str, bindings: Mapping[str, Column] | None = None) -> Column:
    """The column that an expression of the JavaScript kind stands for.

    Names are looked up in ``bindings`` and then as columns; ``a.b``, ``a[0]`` and ``a["k"]`` reach into them.
    """
    return _Parser(source, _bound(bindings)).parse()
