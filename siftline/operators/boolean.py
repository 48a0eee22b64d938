"""Boolean queries: AND, OR, NOT, parentheses, phrases; compiled to one Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    kind: str  # term, and, or, not
    term: str = ""
    left: Node | None = None
    right: Node | None = None


def tokenize(query: str) -> list[str]:
    """Operators, parentheses, quoted phrases and words; other characters are dropped."""
    return [m.group() for m in re.finditer(r'"[^"]*"|[()]|\w+', query)]


class _Parser:
    def __init__(self, query: str):
        self.rest = tokenize(query)[::-1]

    def peek(self) -> str:
        return self.rest[-1].upper() if self.rest else ""

    def either(self) -> Node:
        node = self.both()
        while self.peek() == "OR":
            self.rest.pop()
            node = Node("or", left=node, right=self.both())
        return node

    def both(self) -> Node:
        node = self.one()
        while self.peek() not in ("", "OR", ")"):
            if self.peek() == "AND":
                self.rest.pop()
            node = Node("and", left=node, right=self.one())
        return node

    def one(self) -> Node:
        if not self.rest:
            raise ValueError("the query ends where a term is expected")
        t = self.rest.pop()
        if t.upper() == "NOT":
            return Node("not", left=self.one())
        if t == "(":
            node = self.either()
            if self.peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            self.rest.pop()
            return node
        if t == ")" or t.upper() in ("AND", "OR"):
            raise ValueError(f"unexpected {t}")
        return Node("term", term=t.strip('"'))


def parse(query: str) -> Node:
    """NOT binds before AND before OR; neighbours are joined by AND."""
    p = _Parser(query)
    node = p.either()
    if p.rest:
        raise ValueError(f"unexpected {p.rest[-1]}")
    return node


def terms(node: Node) -> list[str]:
    if node.kind == "term":
        return [node.term]
    return [t for side in (node.left, node.right) if side for t in terms(side)]


def predicate(node: Node | str, text: Column) -> Column:
    """Case-insensitive substring predicate over a text."""
    if isinstance(node, str):
        node = parse(node)
    if node.kind == "term":
        return F.lower(text).contains(node.term.lower())
    if node.kind == "not":
        return ~predicate(node.left, text)
    a, b = predicate(node.left, text), predicate(node.right, text)
    return a & b if node.kind == "and" else a | b
