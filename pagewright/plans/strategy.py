"""Strategies: the replaceable parts of parsing. A part builds columns or DataFrames, so swapping one
rewrites the plan and Catalyst still optimises it."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from pagewright.functions import text as tx
from pagewright.operators import segment


@dataclass(frozen=True)
class Strategy:
    """Each of the first four parts is (rows, key) -> rows with further columns: find_body adds body and
    inside, find_title title_pos, split_notes is_body and is_note, drop_preamble start. The others take
    the columns they judge; title_block takes a title's lines and gives its struct."""

    name: str
    find_body: Callable[[DataFrame, str], DataFrame] = segment.find_body
    find_title: Callable[[DataFrame, str], DataFrame] = segment.find_title
    split_notes: Callable[[DataFrame, str], DataFrame] = segment.split_notes
    drop_preamble: Callable[[DataFrame, str], DataFrame] = segment.drop_contents
    title_block: Callable[[Column], Column] = tx.title_block
    is_heading: Callable[[Column], Column] = segment.is_heading
    chapter_numeral: Callable[[Column], Column] = tx.chapter_numeral
    is_dateline: Callable[[Column], Column] = segment.is_dateline
    is_signature: Callable[[Column], Column] = tx.is_signature

    def replace(self, **changes) -> Strategy:
        return dataclasses.replace(self, **changes)


DEFAULT = Strategy("default")
PERMISSIVE = DEFAULT.replace(name="permissive", drop_preamble=segment.keep_all)
DEFAULT_CHAIN = (DEFAULT, PERMISSIVE)

_known: dict[str, Strategy] = {}


def register(strategy: Strategy) -> None:
    """Make a strategy known by its name; the last of a name counts."""
    _known[strategy.name] = strategy


def get(name: str) -> Strategy:
    if name not in _known:
        raise KeyError(f"unknown strategy {name!r}; known: {', '.join(sorted(_known))}")
    return _known[name]


for _strategy in DEFAULT_CHAIN:
    register(_strategy)
