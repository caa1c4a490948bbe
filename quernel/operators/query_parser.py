"""The query language: words, "phrases", +must, -not, AND, OR, NOT, parentheses, ^boost and the field `content:`."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r'\s*(?:(?P<op>[()+\-])|(?P<phrase>"[^"]*")|(?P<word>[^\s()"^]+)|(?P<boost>\^[0-9.]+))')


@dataclass
class Leaf:
    text: str
    phrase: bool = False
    boost: float = 1.0


@dataclass
class Group:
    must: list
    should: list
    never: list
    boost: float = 1.0


def parse(query: str) -> Group | Leaf:
    """The query's tree; ValueError if it can't be read."""
    tokens, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"failed to parse query: {query!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tree, rest = _either(tokens, 0, query)
    if rest != len(tokens):
        raise ValueError(f"failed to parse query: {query!r}")
    return tree


def _either(tokens: list, i: int, query: str) -> tuple[Group, int]:
    """Clauses up to a closing bracket; those joined by AND are required together."""
    runs: list[list[tuple[str, object]]] = [[]]
    joined = False
    while i < len(tokens) and tokens[i] != ("op", ")"):
        kind, value = tokens[i]
        if kind == "word" and value in ("AND", "OR"):
            if not runs[-1] or joined:
                raise ValueError(f"failed to parse query: {query!r}")
            joined, i = value == "AND", i + 1
            if i == len(tokens):
                raise ValueError(f"failed to parse query: {query!r}")
            continue
        sign = ""
        if value in ("+", "-") and kind == "op" or (kind == "word" and value == "NOT"):
            sign, i = "-" if value in ("-", "NOT") else "+", i + 1
        node, i = _one(tokens, i, query)
        if joined:
            runs[-1].append((sign, node))
        else:
            runs.append([(sign, node)])
        joined = False
    group = Group([], [], [])
    for run in runs:
        if len(run) > 1:
            group.should.append(Group([n for s, n in run if s != "-"], [], [n for s, n in run if s == "-"]))
        for sign, node in run if len(run) == 1 else []:
            (group.must if sign == "+" else group.never if sign == "-" else group.should).append(node)
    if len(group.should) == 1 and not group.must and not group.never:
        return group.should[0], i
    return group, i


def _one(tokens: list, i: int, query: str) -> tuple[Group | Leaf, int]:
    if i >= len(tokens):
        raise ValueError(f"failed to parse query: {query!r}")
    kind, value = tokens[i]
    if (kind, value) == ("op", "("):
        node, i = _either(tokens, i + 1, query)
        if i >= len(tokens) or tokens[i] != ("op", ")"):
            raise ValueError(f"failed to parse query: {query!r}")
    elif kind == "phrase":
        node = Leaf(value[1:-1], True)
    elif kind == "word":
        field, _, text = value.rpartition(":")
        if field == "content" and not text and i + 1 < len(tokens) and tokens[i + 1][0] == "phrase":
            node, i = Leaf(tokens[i + 1][1][1:-1], True), i + 1
        elif field not in ("", "content") or "*" in text or re.match(r"[\[{]", text):
            raise ValueError(f"failed to parse query: unsupported {value!r}")
        else:
            node = Leaf(text)
    else:
        raise ValueError(f"failed to parse query: {query!r}")
    i += 1
    if i < len(tokens) and tokens[i][0] == "boost":
        node.boost *= float(tokens[i][1][1:])
        i += 1
    return node, i
