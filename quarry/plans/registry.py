"""Named diagnostics that run over walk-forward windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.spec import SpecError, Window

#: A diagnostic takes what came before the test and the test, and gives rows.
Diagnostic = Callable[[DataFrame, DataFrame], DataFrame]
_known: dict[str, Diagnostic] = {}


def register(name: str) -> Callable[[Diagnostic], Diagnostic]:
    def add(f: Diagnostic) -> Diagnostic:
        if name in _known:
            raise SpecError(f"diagnostic {name} exists")
        _known[name] = f
        return f

    return add


def names() -> list[str]:
    return sorted(_known)


def run(name: str, panel: DataFrame, windows: Sequence[Window], date: str = "snapshot_date") -> DataFrame:
    """The rows of a diagnostic for each window; thresholds it learns come from before the test alone."""
    if name not in _known:
        raise SpecError(f"no diagnostic {name}")
    out = None
    for w in windows:
        split = w.split(F.col(date))
        rows = _known[name](panel.where(split.isin("train", "validation")), panel.where(split == "test")).withColumn("window", F.lit(w.name))
        out = rows if out is None else out.unionByName(rows)
    return out
