"""The residue selection language, compiled to a Column that Catalyst can push into the scan.

    expr := expr "or" expr | expr "and" expr | "not" expr | "(" expr ")" | "resid" items | "resname" items
    items := item+       item := value | value "-" value

`or` binds weakest, `not` strongest. A minus sign starts a number only after an operator, a keyword, an
opening parenthesis or another minus. Errors raise SelectionError; with compat=True a malformed expression
selects nothing, what follows a complete expression is ignored and a range of names means its two ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("and", "or", "not", "resid", "resname")


class SelectionError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    field: str
    items: tuple  # of value or (low, high)


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


_TOKEN = re.compile(r"\s*(?:([()])|([0-9]+(?![A-Za-z0-9_'*]))|([A-Za-z0-9_'*+]+)|(-))")


def tokenize(text: str) -> list[str]:
    out: list[str] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SelectionError(f"unexpected character {text[at]!r} at {at}")
        token = m.group(m.lastindex)
        at = m.end()
        number = re.match(r"[0-9]+", text[at:]) if token == "-" else None
        if number and (not out or out[-1] in (*KEYWORDS, "(", "-")):
            token = f"-{number.group()}"
            at += number.end()
        out.append(token.lower() if token.lower() in KEYWORDS else token)
    return out


class _Parser:
    def __init__(self, tokens: list[str], compat: bool):
        self.tokens, self.at, self.compat = tokens, 0, compat

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        token = self.peek()
        if token is None:
            raise SelectionError("the expression ends too early")
        self.at += 1
        return token

    def either(self, op: str = "or"):
        below = (lambda: self.either("and")) if op == "or" else self.unary
        left = below()
        while self.peek() == op:
            self.take()
            left = Both(op, left, below())
        return left

    def unary(self):
        token = self.take()
        if token == "not":
            return Not(self.unary())
        if token == "(":
            inner = self.either()
            if self.take() != ")":
                raise SelectionError("a parenthesis is not closed")
            return inner
        if token in ("resid", "resname"):
            return Term(token, self.items(token))
        raise SelectionError(f"unknown term {token!r}")

    def value(self, field: str):
        token = self.take()
        if token in (*KEYWORDS, "(", ")", "-"):
            raise SelectionError(f"a value is missing before {token!r}")
        if field == "resname":
            return token
        try:
            return int(token)
        except ValueError:
            raise SelectionError(f"{token!r} is not a residue number") from None

    def items(self, field: str) -> tuple:
        found = []
        while not found or self.peek() not in (None, ")", "and", "or"):
            first = self.value(field)
            if self.peek() == "-":
                self.take()
                second = self.value(field)
                if field == "resname" and not self.compat:
                    raise SelectionError("a range of names")
                found += [first, second] if field == "resname" else [(first, second)]
            else:
                found.append(first)
        return tuple(found)


def parse(text: str, compat: bool = False):
    """The syntax tree."""
    parser = _Parser(tokenize(text), compat)
    tree = parser.either()
    if parser.peek() is not None and not compat:
        raise SelectionError(f"unexpected {parser.peek()!r} after the expression")
    return tree


def to_column(tree, resid: str = "resid", resname: str = "resname") -> Column:
    if isinstance(tree, Not):
        return ~to_column(tree.of, resid, resname)
    if isinstance(tree, Both):
        left, right = to_column(tree.left, resid, resname), to_column(tree.right, resid, resname)
        return left & right if tree.op == "and" else left | right
    column = F.col(resid if tree.field == "resid" else resname)
    plain = [x for x in tree.items if not isinstance(x, tuple)]
    tests = [column.isin(*plain)] if plain else []
    tests += [column.between(*x) for x in tree.items if isinstance(x, tuple)]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def selection(text: str, compat: bool = False, resid: str = "resid", resname: str = "resname") -> Column:
    """The expression as a boolean Column."""
    try:
        return to_column(parse(text, compat), resid, resname)
    except SelectionError:
        if compat:
            return F.lit(False)
        raise


def select_atoms(atoms: DataFrame, text: str, compat: bool = False) -> DataFrame:
    return atoms.where(selection(text, compat))
