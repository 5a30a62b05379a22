"""Names of columns that an operator adds to a table beside the table's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def free(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all that are taken, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def set_aside(frame: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its columns of these names called otherwise, and what gives them, in a frame made from it, their
    names and places back."""
    lower, columns = {n.lower() for n in names}, frame.columns
    moved: dict[str, str] = {}
    for c in columns:
        if c.lower() in lower:
            moved[c] = free([*columns, *names, *moved.values()], f"{c}_kept")
    out = frame.select(*[frame[c].alias(moved[c]) if c in moved else frame[c] for c in columns]) if moved else frame
    return out, lambda made: made.select(*[made[moved.get(c, c)].alias(c) for c in columns])
