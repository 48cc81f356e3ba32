"""Spreadsheet formulas: + - * / ^ %, unary signs, ABS and aggregates over cells and ranges.

A sign binds before ^, and ^ groups from the left, as spreadsheets do. A cell that refers to itself through others, a
formula that doesn't parse and a division by zero give an error text instead of a value.

Rows of sheets share their formulas, so the tokens and references of a text are found once in a task, not once a row.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from tessera.plans.staging import partitions

FUNCTIONS = ("ABS", "SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "PRODUCT")
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?:(?:'([^']+)'|([A-Za-z0-9_]+))!)?\$?([A-Z]{1,3})\$?(\d+)(?![\w(])|([A-Za-z]+)(?=\s*\()|(.))")
REFERENCE = re.compile(r"(?<![A-Za-z0-9_])(?:(?:'([^']+)'|([A-Za-z0-9_]+))!)?\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?(?![\w(])")
MOST_CELLS, MOST_DEPTH = 100_000, 200
#: Rows of sheets whose formulas leave a task at a time.
SHEETS = 1_000


class FormulaError(ValueError):
    pass


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


#: Formulas whose tokens and references a task keeps.
KEPT = 4_096


@lru_cache(KEPT)
def _references(formula: str, sheet: str) -> tuple[tuple[str, str], ...]:
    out = []
    for q, s, c, r, c2, r2 in REFERENCE.findall(formula):
        out.append((q or s or sheet, f"{c}{r}" + (f":{c2}{r2}" if c2 else "")))
    return tuple(dict.fromkeys(out))


def references(formula: str, sheet: str) -> list[tuple[str, str]]:
    """(sheet, cell or range) of every reference, each once."""
    return list(_references(formula, sheet))


@lru_cache(KEPT)
def _tokens(text: str, sheet: str) -> tuple[tuple[str, object], ...]:
    out: list[tuple[str, object]] = []
    for number, quoted, plain, column, row, name, other in TOKEN.findall(text):
        if number:
            out.append(("number", float(number)))
        elif column:
            out.append(("cell", (quoted or plain or sheet, column, int(row))))
        elif name:
            out.append(("name", name.upper()))
        elif other.strip():
            out.append(("sign", other))
    return tuple(out)


class Workbook:
    """cells: (sheet, cell) to a number, a text, or a formula that starts with =."""

    def __init__(self, cells: dict[tuple[str, str], object]):
        self.cells, self.known, self.open = cells, {}, []

    def value(self, sheet: str, cell: str):
        key = (sheet, cell)
        if key in self.known:
            return self.known[key]
        if key in self.open:
            raise FormulaError("cycle")
        if len(self.open) >= MOST_DEPTH:
            raise FormulaError("too deep")
        raw = self.cells.get(key)
        if not (isinstance(raw, str) and raw.startswith("=")):
            return raw
        self.open.append(key)
        try:
            self.known[key] = Parser(self, sheet, raw[1:]).whole()
        finally:
            self.open.pop()
        return self.known[key]

    def evaluated(self) -> dict[tuple[str, str], tuple[object, str | None]]:
        """(value, error) of every formula."""
        out = {}
        for (sheet, cell), raw in self.cells.items():
            if isinstance(raw, str) and raw.startswith("="):
                try:
                    out[sheet, cell] = (self.value(sheet, cell), None)
                except (FormulaError, ArithmeticError) as e:
                    out[sheet, cell] = (None, str(e) or type(e).__name__)
        return out


class Parser:
    def __init__(self, book: Workbook, sheet: str, text: str):
        self.book, self.sheet, self.tokens, self.at = book, sheet, _tokens(text, sheet), 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, sign: str) -> bool:
        if self.peek() == ("sign", sign):
            self.at += 1
            return True
        return False

    def whole(self) -> float:
        out = self.sum()
        if self.peek()[0] != "end":
            raise FormulaError("syntax")
        return out

    def sum(self) -> float:
        out = self.product()
        while True:
            if self.take("+"):
                out += self.product()
            elif self.take("-"):
                out -= self.product()
            else:
                return out

    def product(self) -> float:
        out = self.power()
        while True:
            if self.take("*"):
                out *= self.power()
            elif self.take("/"):
                d = self.power()
                if d == 0:
                    raise FormulaError("division by zero")
                out /= d
            else:
                return out

    def power(self) -> float:
        out = self.signed()
        while self.take("^"):
            out = out ** self.signed()
            if isinstance(out, complex) or not math.isfinite(out):
                raise FormulaError("number")
        return out

    def signed(self) -> float:
        if self.take("-"):
            return -self.signed()
        if self.take("+"):
            return self.signed()
        out = self.atom()
        while self.take("%"):
            out /= 100
        return out

    def atom(self) -> float:
        kind, x = self.peek()
        self.at += 1
        if kind == "number":
            return x
        if kind == "cell":
            v = self.book.value(x[0], f"{x[1]}{x[2]}")
            if v is None or v == "":
                return 0.0
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise FormulaError("value")
            return float(v)
        if kind == "name" and x in FUNCTIONS and self.take("("):
            values = self.arguments()
            return self.called(x, values)
        if (kind, x) == ("sign", "("):
            out = self.sum()
            if self.take(")"):
                return out
        raise FormulaError("syntax")

    def arguments(self) -> list:
        out: list = []
        while not self.take(")"):
            kind, x = self.peek()
            if kind == "cell" and self.tokens[self.at + 1 : self.at + 2] == (("sign", ":"),) and self.tokens[self.at + 2 : self.at + 3] and self.tokens[self.at + 2][0] == "cell":
                _, (_, c2, r2) = self.tokens[self.at + 2]
                a, b = sorted((column_number(x[1]), column_number(c2)))
                top, bottom = sorted((x[2], r2))
                if (b - a + 1) * (bottom - top + 1) > MOST_CELLS:
                    raise FormulaError("range too large")
                out += [self.book.value(x[0], f"{column_letters(c)}{r}") for r in range(top, bottom + 1) for c in range(a, b + 1)]
                self.at += 3
            else:
                out.append(self.sum())
            if not self.take(",") and not self.take(";") and self.peek() != ("sign", ")"):
                raise FormulaError("syntax")
        return out

    def called(self, name: str, values: list) -> float:
        numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if name == "COUNTA":
            return float(sum(v not in (None, "") for v in values))
        if name == "COUNT":
            return float(len(numbers))
        if name == "ABS":
            if len(numbers) != 1:
                raise FormulaError("value")
            return abs(numbers[0])
        if name == "SUM":
            return math.fsum(numbers)
        if name == "PRODUCT":
            return math.prod(numbers) if numbers else 0.0
        if name == "AVERAGE":
            if not numbers:
                raise FormulaError("division by zero")
            return math.fsum(numbers) / len(numbers)
        return (min if name == "MIN" else max)(numbers, default=0.0)


def evaluated_rows(rows, keys: list[str], cells: str = "cells", sheet: str = "Sheet1"):
    """keys, cell, value and refers for every formula of rows(keys, cells as a map of cell names to texts): the value as text, null on an error, and the cells that it names.

    Rows are dealt over the session's shuffle partitions first: small files of many sheets would else be read by a few tasks.
    """
    import numpy as np
    import pyarrow as pa

    def read(x: str) -> object:
        try:
            return x if x is None or x.startswith("=") else float(x)
        except ValueError:
            return x

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SHEETS):
                part = batch.slice(start, SHEETS)
                names, values, refers, formulas = [], [], [], []
                for own in part.column(cells).to_pylist():
                    own = dict(own or ())
                    book = Workbook({(sheet, c): read(v) for c, v in own.items()})
                    before = len(names)
                    for cell, raw in own.items():
                        if raw and raw.startswith("="):
                            try:
                                value = book.value(sheet, cell)
                            except (FormulaError, ZeroDivisionError, OverflowError):
                                value = None
                            names.append(cell)
                            values.append(None if value is None else repr(round(value, 9)) if isinstance(value, float) else str(value))
                            refers.append([c for _, c in _references(raw, sheet)])
                    formulas.append(len(names) - before)
                at = pa.array(np.repeat(np.arange(part.num_rows), formulas))
                found = {"cell": pa.array(names, pa.string()), "value": pa.array(values, pa.string()), "refers": pa.array(refers, pa.list_(pa.string()))}
                yield pa.record_batch([*(part.column(k).take(at) for k in keys), *found.values()], names=[*keys, *found])

    kinds = dict(rows.dtypes)
    dealt = rows.select(*keys, cells).repartition(partitions(rows.sparkSession))
    return dealt.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", cell string, value string, refers array<string>")
