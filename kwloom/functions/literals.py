"""Many literals against a text at once: one automaton a list, whatever its length."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def automaton(groups: Sequence[Sequence[str]]) -> ahocorasick.Automaton | None:
    """Every distinct literal with its (group, place) pairs; empty literals are in every text and are left out."""
    places: dict[str, list[tuple[int, int]]] = {}
    for group, literals in enumerate(groups):
        for place, literal in enumerate(literals):
            if literal:
                places.setdefault(literal, []).append((group, place))
    if not places:
        return None
    out = ahocorasick.Automaton()
    for literal, where in places.items():
        out.add_word(literal, where)
    out.make_automaton()
    return out


def first_literals(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<int>: for each group the first of its literals, as listed, that occurs in the text; null for none.

    Occurrence is as a substring. The text is read once, however many literals there are.
    """
    lists = [list(g) for g in groups]

    @F.arrow_udf("array<int>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = automaton(lists)
        blank = np.array([min((i for i, x in enumerate(g) if not x), default=-1) for g in lists], dtype=np.int32)
        none = np.iinfo(np.int32).max
        start = np.where(blank < 0, none, blank).tolist()
        for batch in batches:
            rows = []
            for line in batch.to_pylist():
                if line is None:
                    rows.append(None)
                    continue
                best = start.copy()
                for _, where in found.iter(line) if found is not None else ():
                    for group, place in where:
                        if place < best[group]:
                            best[group] = place
                rows.append([None if b == none else b for b in best])
            yield pa.array(rows, pa.list_(pa.int32()))

    return scan(text)


def needed(pattern: str) -> list[str] | None:
    """Literals one of which every match of a pattern has; None if the pattern shows none.

    Runs of plain characters count, and alternatives that all have one.
    """
    try:
        return _needed(re._parser.parse(pattern))  # noqa: SLF001  the parse tree has no other door
    except (re.error, AttributeError):
        return None


def _needed(tokens) -> list[str] | None:
    options: list[list[str]] = []
    run = ""
    for kind, value in [*tokens, (None, None)]:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        if run:
            options.append([run])
            run = ""
        inner: list[str] | None = None
        if name == "SUBPATTERN":
            inner = _needed(value[-1])
        elif name == "MAX_REPEAT" and value[0] > 0:
            inner = _needed(value[2])
        elif name == "BRANCH":
            parts = [_needed(b) for b in value[1]]
            inner = [x for p in parts for x in p] if all(parts) else None
        if inner:
            options.append(inner)
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)
