"""License scans: notice phrases and identifier tags found by one Aho-Corasick automaton, licence expressions by a shunting-yard parser.

One pass over the texts, no shuffle. Words are runs of other characters than [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after
A-Z are lower-cased; the automaton reads the words joined by single spaces, so a phrase is found wherever its words
stand consecutively. What follows an identifier tag in the text, up to the line's end or the next tag, is parsed as an expression of identifiers, AND, OR, WITH and parentheses.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare_workers

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own notices, their labels and how much each counts.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "isc license": ("isc", 0.7),
    "bsd license": ("bsd", 0.7),
    "2 clause bsd": ("bsd", 0.7),
    "3 clause bsd": ("bsd", 0.7),
    "bsd 2 clause": ("bsd", 0.7),
    "bsd 3 clause": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc0": ("cc0", 0.6),
    "all rights reserved": ("all-rights-reserved", 0.5),
    "released into the public domain": ("public-domain", 0.7),
}
PHRASE_WEIGHT, TAG_WEIGHT = 0.7, 0.95
_TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*", re.ASCII | re.IGNORECASE)
_LINE = re.compile(r"[^\r\n]*")
_FAMILIES = ("lgpl", "agpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "bsl", "isc", "cc0", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "unlicense")
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*PHRASES, *NOTICES, _TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def to_postfix(expression: str) -> list[str]:
    """An expression's longest valid beginning in postfix order (operators lower-cased); [] if there is none."""
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] = 0, []  # how many of out, and the operators behind them
    opened = 0
    wants = True  # an operand comes next
    for m in re.finditer(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|\S", expression):
        token = m[0]
        low = token.lower()
        if wants and token == "(":
            stack.append(token)
            opened += 1
        elif wants and re.match(r"[A-Za-z0-9]", token) and low not in _BINDS:
            out.append(token)
            wants = False
        elif not wants and low in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            wants = True
        elif not wants and token == ")" and opened:
            opened -= 1
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
        if not wants and not opened:
            best = len(out), stack[::-1]  # at most one operator of each kind
    return out[: best[0]] + best[1]


def alternatives(expression: str) -> list[frozenset[str]]:
    """The sets of licences that fulfil an expression: OR gives either, AND both together, WITH binds an exception.

    Their number may double with each part of an expression; scans take factored() instead.
    """
    stack: list[list[frozenset[str]]] = []
    for token in to_postfix(expression):
        if token not in _BINDS:
            stack.append([frozenset([token.lower()])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif token == "and":
            stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
        else:
            name = " ".join(sorted(right[0]))
            stack.append([frozenset(f"{x} with {name}" for x in a) for a in left])
    return stack[0] if stack else []


def _joined(op: str, left: str | tuple, right: str | tuple) -> tuple:
    """(op, parts), with the parts of a side of the same operator among them; the longer side is extended in place."""
    a, b = (x[1] if x[0] == op else deque([x]) for x in (left, right))
    if len(a) < len(b):
        b.extendleft(reversed(a))
        return op, b
    a.extend(b)
    return op, a


def factored(expression: str) -> tuple[str, set[str]]:
    """An expression with | for OR and & for AND, as it is bracketed, and its licences without exceptions; lower-cased.

    Names that stand twice in one group are given once, and those of an AND group in order, before groups in brackets.
    """
    stack: list[tuple] = []  # (op, parts), or ("", name)
    names: list[set[str]] = []
    for token in to_postfix(expression):
        if token not in _BINDS:
            stack.append(("", token.lower()))
            names.append({token.lower()})
            continue
        right, left, own, other = stack.pop(), stack.pop(), names.pop(), names.pop()
        if token == "with":
            stack.append(("", f"{left[1]} with {right[1]}") if left[0] == right[0] == "" else ("with", deque([left, right])))
            names.append(other)  # the left side's
        else:
            stack.append(_joined(token, left, right))
            small, large = sorted((own, other), key=len)
            large |= small
            names.append(large)
    if not stack:
        return "", set()
    out: list[str] = []
    rest: list[str | tuple] = [stack[0]]
    while rest:
        node = rest.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        op, parts = node
        if not op:
            out.append(parts)
            continue
        if op == "and":
            parts = [*sorted({p for p in parts if not p[0]}), *(p for p in parts if p[0])]
        elif op == "or":
            parts = list({n if p[0] else p: p for n, p in enumerate(parts)}.values())  # a group for itself, a name once
        mark = {"or": " | ", "and": " & ", "with": " with "}[op]
        for n, p in enumerate(reversed(parts)):
            if n:
                rest.append(mark)
            bare = not p[0] or (op == "or" and p[0] != "or")
            rest += [p] if bare else [")", p, "("]
    return "".join(out), names[0]


def family(identifier: str) -> str:
    base = identifier.split(" with ")[0]
    return next((f for f in _FAMILIES if base.startswith(f)), base)


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    joined = b" ".join([b"", *words, b""])
    places, base, labels, miss, tagged = [], set(), set(), 1.0, False
    for end, phrase in _automaton().iter(joined.decode("latin-1")):
        if phrase == _TAG:
            tagged = True
        if phrase in PHRASES:
            places.append(end - len(phrase) - 1)
            if PHRASES[phrase] not in base:
                miss *= 1 - PHRASE_WEIGHT
            base.add(PHRASES[phrase])
        if phrase in NOTICES and NOTICES[phrase][0] not in labels:
            labels.add(NOTICES[phrase][0])
            miss *= 1 - NOTICES[phrase][1]
    first = last = None
    if places:  # from places in the joined words to words
        first, last = joined.count(b" ", 0, min(places)), joined.count(b" ", 0, max(places))
    expressions = []
    tags = list(_TAGGED.finditer(text)) if tagged else []
    for m, end in zip(tags, [*(m.start() for m in tags[1:]), len(text)]):
        expression, names = factored(_LINE.match(text, m.end(), end)[0])
        if names:
            labels |= set(map(family, names))
            expressions.append(expression)
    if expressions:
        miss *= 1 - TAG_WEIGHT
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - miss, expressions


_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan_text(x.as_py() or "") for x in b.column(1)]
        columns = zip(*rows) if rows else [[]] * (len(_FIELDS) - 1)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS[1:]))], [n for n, _ in _FIELDS])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts and places of the fixed phrases, labels, score, expressions.

    score is 1 minus the product of (1 - weight) over the labels found and a parsed tag: 0 without any. A null text is an empty
    one; repeated rows give repeated rows; a null doc_id stays null; other columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
