"""Freezing candidates and evaluating them on periods that they have never seen."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.spec import Spec, SpecError, Window
from quarry.sources.sinks import data_fingerprint, fingerprint


@dataclass(frozen=True)
class Candidate:
    """A specification that may no longer change, with the day up to which it was searched for."""

    spec: Spec
    discovery_cutoff: date
    frozen_at: date
    fingerprint: str = ""
    notes: dict[str, Any] = field(default_factory=dict)


def freeze(spec: Spec, discovery_cutoff: date, frozen_at: date, **notes: Any) -> Candidate:
    if frozen_at <= discovery_cutoff:
        raise SpecError("a candidate is frozen after its discovery ends")
    return Candidate(spec, discovery_cutoff, frozen_at, fingerprint(asdict(spec)), notes)


def intact(c: Candidate) -> bool:
    return c.fingerprint == fingerprint(asdict(c.spec))


def separated(c: Candidate, start: date, end: date) -> None:
    """Evaluation begins after discovery and does not run backwards."""
    if start > end:
        raise SpecError("the evaluation ends before it starts")
    if start <= c.discovery_cutoff:
        raise SpecError(f"the evaluation starts {start}, discovery ends {c.discovery_cutoff}")
    if not intact(c):
        raise SpecError("the candidate has changed since it was frozen")


def rolling(as_of: date, days: tuple[int, ...] = (5, 20, 60)) -> list[tuple[str, date, date]]:
    """Windows that end on a day: name, first and last day."""
    return [(f"last_{n}d", as_of - timedelta(n - 1), as_of) for n in days]


def half_years(start: date, end: date) -> list[tuple[str, date, date]]:
    """Calendar half-years within a range, cut to it."""
    out, y, h = [], start.year, 1 if start.month <= 6 else 2
    while (a := date(y, 1 if h == 1 else 7, 1)) <= end:
        b = date(y, 6, 30) if h == 1 else date(y, 12, 31)
        out.append((f"{y}H{h}", max(a, start), min(b, end)))
        y, h = (y, 2) if h == 1 else (y + 1, 1)
    return out


def ordered(windows: list[Window]) -> None:
    """Training ends before validation, validation before test, and windows move forward."""
    for w in windows:
        if not w.train_end < w.validation_end < w.test_end:
            raise SpecError(f"{w.name}: its days are out of order")
    if any(a.test_end > b.test_end for a, b in zip(windows, windows[1:], strict=False)):
        raise SpecError("windows run backwards")


def not_optimised(before: dict[str, Any], after: dict[str, Any]) -> list[str]:
    """Settings that changed between freezing and evaluation."""
    return sorted(k for k in before.keys() | after.keys() if before.get(k) != after.get(k))


def same_run(runs: list[dict[str, Any]], spec_fingerprint: str, data_fingerprint: str, window: tuple[date, date]) -> dict[str, Any] | None:
    """An earlier run of the same candidate on the same data and window."""
    return next((r for r in runs if r["spec"] == spec_fingerprint and r["data"] == data_fingerprint and tuple(map(str, r["window"])) == tuple(map(str, window))), None)


def evaluate(c: Candidate, panel: DataFrame, start: date, end: date, runs: list[dict[str, Any]], date_col: str = "snapshot_date") -> tuple[DataFrame | None, dict[str, Any]]:
    """Run a frozen candidate on a period that its search has not seen: its rows and the run's manifest. A
    run of the same candidate on the same rows and period is not repeated: no rows, and its manifest."""
    from quarry.plans import research

    separated(c, start, end)
    rows = panel.where(F.col(date_col).between(F.lit(start), F.lit(end)))
    spec_print, data_print = fingerprint(asdict(c.spec)), data_fingerprint(rows)
    if (before := same_run(runs, spec_print, data_print, (str(start), str(end)))) is not None:
        return None, {**before, "status": "duplicate"}
    # the whole period is one window whose test it is; tails are of whole cross-sections all the same
    window = Window("evaluation", str(start - timedelta(2)), str(start - timedelta(1)), str(end))
    spec = replace(c.spec, windows=(), splits=("test",))
    manifest = {"spec": spec_print, "data": data_print, "window": (str(start), str(end)), "id": c.spec.id, "discovery_cutoff": str(c.discovery_cutoff), "status": "done"}
    return research.run(panel, spec, [window]), manifest


def next_candidate(grid: list[dict[str, Any]], done: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The first untried combination, in the grid's order."""
    tried = {fingerprint(d) for d in done}
    return next((g for g in grid if fingerprint(g) not in tried), None)


def outcome(rows: list[dict[str, Any]], least: int = 100) -> str:
    """Whether validation rows with enough observations agree on a sign: supported, rejected, mixed or
    insufficient."""
    ok = [r["absolute_difference"] for r in rows if r.get("split") == "validation" and r.get("n", 0) >= least and r.get("absolute_difference") is not None]
    if len(ok) < 2:
        return "insufficient"
    return "supported" if all(v > 0 for v in ok) else "rejected" if all(v <= 0 for v in ok) else "mixed"
