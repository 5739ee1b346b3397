"""Research specifications and the expression language of derived metrics."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many signals each analysis takes: least, most.
ARITY: dict[str, tuple[int, int | None]] = {
    "tail": (1, None),
    "interaction": (2, 2),
    "regime_comparison": (2, 2),
    "multi_regime_comparison": (3, None),
    "nested_regime_comparison": (3, 3),
    "conditional_regime_comparison": (2, None),
    "stratified_regime_comparison": (3, 3),
    "stratified_interaction": (3, 3),
    "incremental_model": (2, 2),
}


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Signal:
    name: str
    direction: str = "upper"
    bins: tuple[float, ...] = (0.1,)

    def __post_init__(self) -> None:
        if self.direction not in ("upper", "lower"):
            raise SpecError(f"{self.name}: direction {self.direction!r}")
        if not self.bins or any(not 0 < b <= 1 for b in self.bins):
            raise SpecError(f"{self.name}: bins {self.bins}")


@dataclass(frozen=True)
class Target:
    """A binary outcome of a return column: above is strict, below inclusive; or the number itself."""

    column: str
    threshold: float = 0.0
    side: str = "above"

    def build(self) -> Column:
        r = F.col(self.column)
        if self.side == "number":
            return r.cast("double")
        return F.when(r.isNotNull(), (r > self.threshold if self.side == "above" else r <= self.threshold).cast("double"))


#: The catalogue of outcomes.
TARGETS: dict[str, Target] = {
    **{f"positive_{h}d": Target(f"forward_return_{h}d") for h in (5, 20, 60)},
    **{f"up_5pct_{h}d": Target(f"forward_return_{h}d", 0.05) for h in (5, 20)},
    "up_10pct_60d": Target("forward_return_60d", 0.10),
    **{f"down_{p}pct_5d": Target("forward_return_5d", -p / 100, "below") for p in (3, 5, 7, 10)},
    "down_5pct_20d": Target("forward_return_20d", -0.05, "below"),
    "down_10pct_60d": Target("forward_return_60d", -0.10, "below"),
    "down_severity_5d": Target("min_return_5d", side="number"),
    "up_severity_5d": Target("max_return_5d", side="number"),
}

#: The catalogue of signals: name -> panel column.
SIGNALS: dict[str, str] = {
    **{f"price_momentum_{n}d": f"price_return_{n}d" for n in (5, 20, 60)},
    "price_volatility_20d": "price_volatility_20d",
    **{f"distance_from_{n}d_high": f"price_distance_from_{n}d_high" for n in (20, 60)},
    "short_interest_level": "short_interest_pct",
    "short_interest_change": "short_interest_delta_pp",
    "short_interest_acceleration": "short_interest_acceleration_pp",
    **{f"price_return_{n}d_relative_{k}": f"price_return_{n}d_relative_{k}" for k in ("market", "sector") for n in (5, 20, 60)},
}


@dataclass(frozen=True)
class Window:
    """A walk-forward window by its last days of training, validation and test."""

    name: str
    train_end: str
    validation_end: str
    test_end: str

    def split(self, date: Column) -> Column:
        d = lambda s: F.lit(s).cast("date")
        return F.when(date <= d(self.train_end), "train").when(date <= d(self.validation_end), "validation").when(date <= d(self.test_end), "test")


@dataclass(frozen=True)
class Spec:
    id: str
    signals: tuple[Signal, ...]
    targets: tuple[str, ...]
    analysis: str
    windows: tuple[str, ...] = ()
    splits: tuple[str, ...] = ("validation", "test")
    question: str = ""
    mode: str = "scan"
    bootstrap: bool = False
    bootstrap_iterations: int = 2000
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.id:
            raise SpecError("a specification needs an id")
        if self.mode not in ("scan", "deep"):
            raise SpecError(f"{self.id}: mode {self.mode!r}")
        if self.analysis not in ARITY:
            raise SpecError(f"{self.id}: analysis {self.analysis!r}")
        least, most = ARITY[self.analysis]
        if len(self.signals) < least or most is not None and len(self.signals) > most:
            raise SpecError(f"{self.id}: {self.analysis} takes {least} to {most or 'any number of'} signals, not {len(self.signals)}")
        for t in self.targets:
            if t not in TARGETS:
                raise SpecError(f"{self.id}: target {t!r}")
        if self.analysis.startswith("stratified") and any(len(s.bins) < 3 for s in self.signals[:2]):
            raise SpecError(f"{self.id}: three bins at least in the two bands")
        bad = set(self.splits) - {"train", "validation", "test"}
        if bad or not self.targets:
            raise SpecError(f"{self.id}: splits {sorted(bad)}, targets {self.targets}")


def from_dict(d: dict[str, Any]) -> Spec:
    signals = tuple(Signal(s["name"], s.get("direction", "upper"), tuple(float(b) for b in s.get("bins", (0.1,)))) for s in d.get("signals", ()))
    a = d.get("analysis") or {}
    return Spec(
        str(d.get("id") or ""), signals, tuple(d.get("targets", ())), a.get("type", ""), tuple(d.get("windows", ())), tuple(d.get("splits", ("validation", "test"))),
        str(d.get("question", "")).strip(), d.get("mode", "scan"), bool(a.get("bootstrap", False)), int(a.get("bootstrap_iterations", 2000)), dict(d.get("metadata") or {}),
    )


def load(text: str) -> Spec:
    import yaml

    d = yaml.safe_load(text)
    if not isinstance(d, dict):
        raise SpecError("a specification is a mapping")
    return from_dict(d)


def load_all(texts: list[str], mode: str | None = None) -> list[Spec]:
    specs = [load(t) for t in texts]
    ids = [s.id for s in specs]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise SpecError(f"ids repeat: {twice}")
    return [s for s in specs if mode is None or s.mode == mode]


# --- derived metrics -------------------------------------------------------------------------

_OPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.when(b != 0, a / b)}


def expression(text: str, names: dict[str, Column]) -> Column:
    """A formula of names, numbers, + - * / and signs as a column; null spreads, x / 0 is null.
    Anything else, a call above all, is an error: text never reaches a SQL parser."""
    try:
        tree = ast.parse(" ".join(text.split()), mode="eval").body
    except SyntaxError as why:
        raise SpecError(f"formula {text!r}: {why.msg}") from None

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd | ast.USub):
            v = walk(n.operand)
            return -v if isinstance(n.op, ast.USub) else v
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in names:
                raise SpecError(f"formula {text!r}: unknown name {n.id}")
            return names[n.id].cast("double")
        raise SpecError(f"formula {text!r}: {type(n).__name__} is not allowed")

    return walk(tree)
