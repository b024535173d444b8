"""Seed definitions, and the names of columns that are derived from one.

A definition is known by a few words in any case, parted by blanks, hyphens or underscores. All its
names are its words joined by underscores and a suffix that says what the column holds.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Definition(NamedTuple):
    words: tuple[str, ...]
    title: str

    @property
    def mode(self) -> str:
        return "-".join(self.words)

    def column(self, what: str, test: bool = False) -> str:
        return "_".join([*self.words, SUFFIXES[what], *(["test"] if test and what in TESTED else [])])

    @property
    def seed(self) -> str:
        """The sparse property that marks the definition's seeds."""
        return "_".join(["seed", *self.words])


#: What a column of a definition may hold, and which of these a trial run keeps apart.
SUFFIXES = {"hops": "min_hops", "reachable": "reachable", "reach_count": "reach_count", "forward_reach_count": "forward_reach_count", "score": "par", "backward_count": "backward_count", "graph": "reachability", "anchor": "anchor"}
TESTED = {"hops", "reachable"}

DEFINITIONS = tuple(
    Definition(tuple(words.split()), title)
    for words, title in (
        ("all assignees", "papers cited by founding patents"),
        ("corporate", "by patents of companies"),
        ("young firm", "by patents of young companies"),
        ("young firm university", "by patents of young companies or universities"),
        ("patent", "papers paired with a patent"),
        ("legacy startup", "papers paired with a patent of a startup, as defined formerly"),
    )
)
CANONICAL = DEFINITIONS[:4]


def find(text: str) -> Definition:
    """The definition of that name; a name that only begins or ends several is an error that lists them."""
    asked = tuple(re.findall(r"[a-z]+", text.lower()))
    exact = [d for d in DEFINITIONS if d.words == asked]
    if exact:
        return exact[0]
    near = [d.mode for d in DEFINITIONS if asked and set(asked) <= set(d.words)]
    raise ValueError(f"no seed definition {text!r}" + (f"; did you mean {' or '.join(near)}?" if near else f"; there are {', '.join(d.mode for d in DEFINITIONS)}"))


def columns(definition: Definition, test: bool = False) -> dict[str, str]:
    return {what: definition.column(what, test) for what in SUFFIXES}


def identifier(value: str) -> str:
    """value, if it may stand in a query unquoted."""
    if not value.isidentifier() or not value.isascii():
        raise ValueError(f"not an identifier: {value!r}")
    return value
