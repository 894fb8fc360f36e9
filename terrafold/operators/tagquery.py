"""The tag-query language, as in ``na[amenity=pub][!fee],w[highway~"(primary|trunk)"]``, compiled to one Column.

    query    := selector ("," selector)*
    selector := types? clause*            at least one of both
    types    := "*" | letters of n, w, a, r, each once at most
    clause   := "[" "!" key "]" | "[" key "]" | "[" key op operand ("," operand)* "]"
    op       := = == != ~ !~ < <= > >=

Operands of = and != are bare or quoted texts (with * at either end as wildcard) and bare numbers; of ~ and !~
quoted regular expressions, matched in full; of comparisons one number. Text operands never match values that
count as numbers, and numbers match whatever number a value begins with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tags import number, stored_number, tag

LETTERS = "nwar"
IDENT = re.compile(r"[A-Za-z_:\u0080-\U0010ffff][A-Za-z0-9_:\u0080-\U0010ffff]*")
KEY = re.compile(r"[A-Za-z0-9_:\u0080-\U0010ffff]+")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
BLANK = re.compile(r"[\x01-\x20]*")


class QueryError(ValueError):
    """A malformed query; says where."""


@dataclass(frozen=True)
class Operand:
    kind: str  # text, prefix, suffix, part, regex, number
    text: str = ""
    number: float = 0.0


@dataclass(frozen=True)
class Clause:
    key: str
    op: str  # has, =, !=, ~, !~, <, <=, >, >=, lacks
    operands: tuple[Operand, ...] = ()


@dataclass(frozen=True)
class Selector:
    types: str  # letters, "" for all
    clauses: tuple[Clause, ...]


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        raise QueryError(f"{what} at {self.at}: {self.text[: self.at]} <here> {self.text[self.at :]}")

    def blank(self) -> None:
        self.at = BLANK.match(self.text, self.at).end()

    def take(self, *options: str) -> str:
        self.blank()
        for o in options:
            if self.text.startswith(o, self.at):
                self.at += len(o)
                return o
        return ""

    def match(self, pattern: re.Pattern) -> str:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m[0] if m else ""

    def query(self) -> tuple[Selector, ...]:
        found = [self.selector()]
        while self.take(","):
            found.append(self.selector())
        self.blank()
        if self.at < len(self.text):
            self.fail("unexpected character")
        return tuple(found)

    def selector(self) -> Selector:
        self.blank()
        types, seen = "", False
        if self.take("*"):
            seen = True
        else:
            while self.at < len(self.text) and self.text[self.at] in LETTERS:
                if self.text[self.at] in types:
                    self.fail("repeated type")
                types += self.text[self.at]
                self.at += 1
        clauses = []
        while self.take("["):
            clauses.append(self.clause())
        if not clauses and not types and not seen:
            self.fail("expected types or [")
        return Selector(types, tuple(clauses))

    def key(self) -> str:
        self.blank()
        found = self.quoted() if self.text[self.at : self.at + 1] in ("'", '"') else self.match(KEY)
        if not found:
            self.fail("expected a key")
        return found

    def quoted(self) -> str:
        quote, at = self.text[self.at], self.at + 1
        while at < len(self.text) and self.text[at] != quote:
            at += 2 if self.text[at] == "\\" else 1
        if at >= len(self.text):
            self.fail("unclosed quote")
        found, self.at = self.text[self.at + 1 : at], at + 1
        return found

    def clause(self) -> Clause:
        if self.take("!"):
            found = Clause(self.key(), "lacks")
        else:
            key = self.key()
            op = self.take("==", "=", "!=", "!~", "~", "<=", "<", ">=", ">")
            if not op:
                found = Clause(key, "has")
            elif op in ("=", "==", "!="):
                found = Clause(key, "!=" if op == "!=" else "=", self.operands(self.value))
            elif op in ("~", "!~"):
                found = Clause(key, op, self.operands(self.regex))
            else:
                found = Clause(key, op, (self.number(),))
        if not self.take("]"):
            self.fail("expected ]")
        return found

    def operands(self, one) -> tuple[Operand, ...]:
        found = [one()]
        while self.take(","):
            found.append(one())
        return tuple(found)

    def number(self) -> Operand:
        self.blank()
        found = self.match(NUMBER)
        if not found:
            self.fail("expected a number")
        return Operand("number", found, float(found))

    def regex(self) -> Operand:
        self.blank()
        if self.text[self.at : self.at + 1] not in ("'", '"'):
            self.fail("expected a quoted pattern")
        pattern = self.quoted()
        try:
            re.compile(pattern)
        except re.error as e:
            self.fail(f"bad pattern ({e})")
        return Operand("regex", pattern)

    def value(self) -> Operand:
        self.blank()
        if self.text[self.at : self.at + 1] in ("'", '"'):
            text = self.quoted()
            return wild(text[1:] if text.startswith("*") else text, text.startswith("*"), text.endswith("*") and len(text) > 1)
        first = bool(self.take("*"))
        text = self.match(IDENT)
        if not text and not first:
            return self.number()
        if not text:
            return Operand("part", "")
        last = self.text.startswith("*", self.at)
        self.at += last
        return wild(text + "*" * last, first, last)


def wild(text: str, first: bool, last: bool) -> Operand:
    text = text[:-1] if last else text
    return Operand("part" if first and last else "suffix" if first else "prefix" if last else "text", text)


def parse(text: str) -> tuple[Selector, ...]:
    return Parser(text).query()


def type_column(letters: str) -> Column:
    """Rows of the types of a selector; w is ways that aren't areas, r relations that aren't."""
    kind, area = F.col("type"), F.col("is_area")
    if not letters or set(letters) == set(LETTERS):
        return F.lit(True)
    tests = {"n": kind == 0, "w": (kind == 1) & ~area, "a": area, "r": (kind == 2) & ~area}
    return reduce(Column.__or__, [tests[c] for c in letters])


def operand_column(v: Column, o: Operand) -> Column:
    """True or false, never null."""
    if o.kind == "number":
        found = number(v) == o.number
    else:
        test = {
            "text": lambda: v == o.text,
            "prefix": lambda: v.startswith(o.text),
            "suffix": lambda: v.endswith(o.text),
            "part": lambda: v.contains(o.text),
            "regex": lambda: v.rlike(rf"\A(?:{o.text})\z"),
        }[o.kind]()
        found = test & ~stored_number(v)
    return F.coalesce(found, F.lit(False))


def clause_column(c: Clause) -> Column:
    v = tag(c.key)
    if c.op in ("has", "lacks"):
        set_ = F.coalesce(v != "no", F.lit(False))
        return set_ if c.op == "has" else ~set_
    if c.op in ("=", "~", "!=", "!~"):
        any_ = reduce(Column.__or__, [operand_column(v, o) for o in c.operands])
        return ~any_ if c.op[0] == "!" else any_
    n, limit = number(v), c.operands[0].number
    return F.coalesce({"<": n < limit, "<=": n <= limit, ">": n > limit, ">=": n >= limit}[c.op], F.lit(False))


def selector_column(s: Selector) -> Column:
    return reduce(Column.__and__, [type_column(s.types), *map(clause_column, s.clauses)])


def query_kinds(text: str) -> frozenset:
    """Types of features that a query can match: 0 nodes, 1 ways, 2 relations."""
    of = {"n": {0}, "w": {1}, "a": {1, 2}, "r": {2}}
    return frozenset(k for s in parse(text) for c in s.types or LETTERS for k in of[c])


def required_keys(query: tuple[Selector, ...]) -> list[set[str]]:
    """Of each selector, the keys that a match must have."""
    needs = ("has", "=", "~", "<", "<=", ">", ">=")
    return [{c.key for c in s.clauses if c.op in needs} for s in query]


def compile_query(text: str, key_bits: dict[str, int] | None = None) -> Column:
    """A boolean Column. With key_bits (key -> bit of the key_bits column) a test of integers stands before the
    tests of tags: it reaches the Parquet scan, which tests of a map don't. It is left out unless every selector
    needs an indexed key."""
    query = parse(text)
    found = reduce(Column.__or__, map(selector_column, query))
    masks = [[1 << (key_bits or {})[k] for k in keys if k in (key_bits or {})] for keys in required_keys(query)]
    if all(masks):
        bits = reduce(Column.__or__, [F.col("key_bits").bitwiseAND(sum(m)) == sum(m) for m in masks])
        found = bits & found
    return found
