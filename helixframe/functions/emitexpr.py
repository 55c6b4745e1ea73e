"""The emission-context language: expressions over the arrays x (observed bases), s (state bases), y (qualities).

::

    context   = condition { "," condition }
    condition = [ "all" | "any" | "count" ] sum [ comparison sum ]
    sum       = term { ("+" | "-") term }
    term      = number | "k" | name [ "[" sum [ ".." sum ] "]" ]

Conditions are digits of a mixed-radix number, the first one highest: a comparison
or a quantifier counts two, ``count`` over n places n + 1. Ranges include both
ends; a bare name is the whole array, of which ``count`` needs a known length. A
comparison over ranges holds place by place; without a quantifier it means ``all``.
The result is a Column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+)|(\.\.|!=|<=|>=|[=<>+\-\[\],])|([a-z]+))")
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class ExpressionError(ValueError):
    pass


@dataclass
class _Value:
    """A scalar (``at(i)`` ignores i), or ``size`` values by place; ``constant`` where known."""

    at: object
    size: int | None
    constant: int | None = None


class _Parser:
    def __init__(self, text: str, arrays: dict[str, str], k: int, length: int | None):
        self.arrays, self.k, self.length, self.place = arrays, k, length, 0
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r}")
            self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.place] if self.place < len(self.tokens) else None

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if t is None or wanted and t not in wanted:
            raise ExpressionError(f"expected {' or '.join(wanted) or 'more'}, found {t}")
        self.place += 1
        return t

    def term(self) -> _Value:
        t = self.take()
        if t.isdigit() or t == "k":
            n = self.k if t == "k" else int(t)
            return _Value(lambda i: F.lit(n), None, n)
        if t not in self.arrays:
            raise ExpressionError(f"unknown name {t}")
        array = F.col(self.arrays[t])
        if self.peek() != "[":
            if self.length is None:
                raise ExpressionError(f"{t} needs a range")
            return _Value(lambda i: F.get(array, i), self.length)
        self.take("[")
        low = self.sum()
        if self.peek() == "..":
            self.take("..")
            high = self.sum()
            if low.constant is None or high.constant is None or high.constant < low.constant:
                raise ExpressionError("a range needs constant, rising ends")
            self.take("]")
            return _Value(lambda i: F.get(array, F.lit(low.constant) + i), high.constant - low.constant + 1)
        self.take("]")
        return _Value(lambda i: F.get(array, low.at(i)), None)

    def sum(self) -> _Value:
        left = self.term()
        while self.peek() in ("+", "-"):
            plus = self.take() == "+"
            left = self._combined(left, self.term(), (lambda a, b: a + b) if plus else (lambda a, b: a - b))
        return left

    def _combined(self, a: _Value, b: _Value, f) -> _Value:
        if a.size and b.size and a.size != b.size:
            raise ExpressionError("ranges of different length")
        constant = f(a.constant, b.constant) if a.constant is not None and b.constant is not None else None
        return _Value(lambda i: f(a.at(i), b.at(i)), a.size or b.size, constant)

    def condition(self) -> tuple[Column, int]:
        how = self.take() if self.peek() in ("all", "any", "count") else None
        left = self.sum()
        if self.peek() in COMPARE:
            f = COMPARE[self.take()]
            value = self._combined(left, self.sum(), f)
        else:
            value = _Value(lambda i: left.at(i) != 0, left.size)
        if value.size is None:
            return F.coalesce(value.at(F.lit(0)), F.lit(False)).cast("int"), 2
        held = F.transform(F.sequence(F.lit(0), F.lit(value.size - 1)), lambda i: F.coalesce(value.at(i), F.lit(False)))
        if how == "count":
            return F.size(F.filter(held, lambda h: h)), value.size + 1
        if how == "any":
            return F.exists(held, lambda h: h).cast("int"), 2
        return F.forall(held, lambda h: h).cast("int"), 2

    def context(self) -> tuple[Column, int]:
        total, radix = self.condition()
        while self.peek() is not None:
            self.take(",")
            digit, n = self.condition()
            total, radix = total * n + digit, radix * n
        return total, radix


def compile_context(text: str, arrays: dict[str, str], *, k: int = 0, length: int | None = None) -> Column:
    """The context index of an expression as a Column. arrays: the columns that x, s and y stand for."""
    return _Parser(text, arrays, k, length).context()[0]


def radix(text: str, arrays: dict[str, str], *, k: int = 0, length: int | None = None) -> int:
    """How many contexts an expression tells apart."""
    return _Parser(text, arrays, k, length).context()[1]
