"""The image expression language: a string becomes one value over the voxels.

Operators: * and / bind first; + - > < = share one level and associate to the left, so x+1>2 is (x+1)>2 and x>2+1 is
(x>2)+1. Parentheses group; name(...) calls an image operator. White space isn't skipped. A number may meet an image on
either side, two numbers may not, and the whole must contain the image.

Element-wise parts stay Column trees, so Catalyst fuses them into one projection; only called operators add stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layout import Grid
from ..operators.elementwise import divide


class ExpressionError(ValueError):
    pass


#: An operand: a number, or the name of a column that holds an image.
Operand = float | str


class Evaluator:
    def __init__(self, grid: Grid, calls: dict[str, Callable[[Grid], Grid]]):
        self.grid, self.calls, self.n = grid, calls, 0
        self.columns = {"x": F.col("v").cast("double")}
        self.base = grid

    def run(self, text: str) -> Grid:
        value = self._expr(text)
        if not isinstance(value, Column):
            raise ExpressionError("an expression needs the image x")
        return self.base.map(value)

    def _tokens(self, text: str) -> list:
        out, i = [], 0
        while i < len(text):
            c = text[i]
            if c in "+-*/><=":
                out.append(c)
                i += 1
                continue
            j = i
            while j < len(text) and text[j] not in "+-*/><=(":
                j += 1
            name = text[i:j]
            if j < len(text) and text[j] == "(":
                depth, k = 1, j + 1
                while k < len(text) and depth:
                    depth += {"(": 1, ")": -1}.get(text[k], 0)
                    k += 1
                if depth:
                    raise ExpressionError("parentheses don't match")
                out.append((name, text[j + 1 : k - 1]))
                i = k
            else:
                if ")" in name:
                    raise ExpressionError("parentheses don't match")
                out.append((name, None))
                i = j
        return out

    def _operand(self, token) -> Column | float:
        if isinstance(token, str):
            raise ExpressionError(f"an operand is missing before {token}")
        name, inner = token
        if inner is None:
            if name == "x":
                return self.columns["x"]
            try:
                return float(name)
            except ValueError:
                raise ExpressionError(f"unknown name {name!r}") from None
        value = self._expr(inner)
        if not name:
            return value
        if name not in self.calls:
            raise ExpressionError(f"unknown function {name!r}")
        if not isinstance(value, Column):
            raise ExpressionError(f"{name} needs an image")
        return self._call(name, value)

    def _call(self, name: str, value: Column) -> Column:
        """Run an image operator; its result becomes a column beside the image, joined by position."""
        self.n += 1
        out = f"__e{self.n}"
        result = self.calls[name](self.base.with_df(self.base.df.select("img", "x", "y", "z", "idx", value.alias("v"))))
        if result.shape != self.base.shape:
            raise ExpressionError(f"{name} changes the shape")
        df = self.base.df.join(result.df.select("img", "idx", F.col("v").cast("double").alias(out)), ["img", "idx"])
        self.base = self.base.with_df(df)
        return F.col(out)

    def _expr(self, text: str) -> Column | float:
        tokens = self._tokens(text)
        if not tokens:
            raise ExpressionError("an empty expression")
        for level in ("*/", "+-><="):
            tokens = self._fold(tokens, level)
        if len(tokens) != 1:
            raise ExpressionError(f"{text!r} can't be read")
        t = tokens[0]
        return t if isinstance(t, Column | float) else self._operand(t)

    def _fold(self, tokens: list, level: str) -> list:
        """Apply the operators of one level from left to right. A minus that comes first belongs to its number."""
        is_op = lambda t: isinstance(t, str)
        out: list = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if is_op(t) and t == "-" and not out and i + 1 < len(tokens) and isinstance(tokens[i + 1], tuple) and tokens[i + 1][1] is None and tokens[i + 1][0] != "x":
                tokens = [*tokens[:i], ("-" + tokens[i + 1][0], None), *tokens[i + 2 :]]
                continue
            if is_op(t) and t in level:
                if not out or is_op(out[-1]):
                    raise ExpressionError(f"an operand is missing before {t}")
                if i + 1 >= len(tokens):
                    raise ExpressionError(f"an operand is missing after {t}")
                out.append(self._apply(t, self._value(out.pop()), self._value(tokens[i + 1])))
                i += 2
            else:
                out.append(t)
                i += 1
        return out

    def _value(self, t) -> Column | float:
        return t if isinstance(t, Column | float) else self._operand(t)

    @staticmethod
    def _apply(op: str, a: Column | float, b: Column | float) -> Column:
        if not isinstance(a, Column) and not isinstance(b, Column):
            raise ExpressionError("two numbers meet")
        a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))
        if op == "/":
            return divide(a, b)
        if op in "+-*":
            return a + b if op == "+" else a - b if op == "-" else a * b
        return (a > b if op == ">" else a < b if op == "<" else a == b).cast("double")


def evaluate(grid: Grid, text: str, calls: dict[str, Callable[[Grid], Grid]] | None = None) -> Grid:
    """The grid's values after the expression over x."""
    return Evaluator(grid, calls or {}).run(text)
