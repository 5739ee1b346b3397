"""Running a research specification: one pass for the ranks, one aggregate for all its cells.

Every tail that any of the specifications needs is a boolean column, made once. Rows are repeated
per walk-forward window, which are a handful, and each specification is a single grouped aggregate
over (window, split); its targets and bins become columns of that aggregate and then rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranks import bands, pct_rank, tail
from quarry.functions.stats import lift, ratio
from quarry.operators.inference import with_intervals
from quarry.plans.spec import SIGNALS, TARGETS, Signal, Spec, SpecError, Window, expression

DATE = "snapshot_date"


def tails_needed(specs: Sequence[Spec]) -> set[tuple[str, str, float]]:
    """Tails that the specifications share: (signal, direction, fraction)."""
    return {(s.name, s.direction, b) for spec in specs for s in spec.signals for b in s.bins}


def tail_name(signal: str, direction: str, fraction: float) -> str:
    return f"tail__{signal}__{direction}__{fraction:g}".replace(".", "p")


def prepare(panel: DataFrame, specs: Sequence[Spec], date: str = DATE) -> DataFrame:
    """The panel with a percentile rank per signal, all tails, and the targets, and nothing else.
    Tails are ranked over whole cross-sections, before any window is cut out."""
    signals = sorted({s.name for spec in specs for s in spec.signals})
    unknown = [s for s in signals if s not in SIGNALS]
    if unknown:
        raise SpecError(f"unknown signals {unknown}")
    targets = sorted({t for spec in specs for t in spec.targets})
    ranks = {f"rank__{s}": pct_rank(F.col(SIGNALS[s]), [date]) for s in signals}
    df = panel.withColumns(ranks)
    masks = {tail_name(*t): tail(F.col(f"rank__{t[0]}"), t[2], t[1]) for t in sorted(tails_needed(specs))}
    df = df.withColumns({**masks, **{f"target__{t}": TARGETS[t].build() for t in targets}})
    return df.select(date, *ranks, *masks, *[f"target__{t}" for t in targets], *[SIGNALS[s] for s in signals])


def in_windows(df: DataFrame, windows: Sequence[Window], splits: Sequence[str], date: str = DATE) -> DataFrame:
    """One copy of a row for each window and split that it falls into."""
    parts = F.array(*[F.struct(F.lit(w.name).alias("window"), w.split(F.col(date)).alias("split")) for w in windows])
    keep = F.filter(parts, lambda p: p["split"].isin(list(splits)))
    return df.withColumn("_w", F.explode(keep)).withColumn("window", F.col("_w.window")).withColumn("split", F.col("_w.split")).drop("_w")


def _mask(s: Signal, fraction: float | None = None) -> Column:
    return F.col(tail_name(s.name, s.direction, s.bins[0] if fraction is None else fraction))


def _counts(target: str, where: Column, everything: bool = False) -> list[Column]:
    """n and events under a mask; rows without a target count only if everything."""
    y = F.col(f"target__{target}")
    n = F.count_if(where if everything else where & y.isNotNull())
    return [n, F.count_if(where & F.coalesce(y > 0, F.lit(False)))]


def _cells(rows: DataFrame, cells: list[tuple[dict, str, dict[str, Column]]], everything: bool = False) -> DataFrame:
    """One aggregate for all cells, then one row a cell: window, split, target, labels, and for each
    regime name its n and events. cells: labels, target, masks by regime name."""
    items = [F.struct(*[F.lit(v).alias(k) for k, v in labels.items()], F.lit(target).alias("target"), *[c.alias(f"{name}_{part}") for name, m in masks.items() for part, c in zip(("n", "events"), _counts(target, m, everything), strict=True)]) for labels, target, masks in cells]
    return rows.groupBy("window", "split").agg(F.array(*items).alias("_c")).select("window", "split", F.explode("_c").alias("_c")).select("window", "split", "_c.*")


def _rates(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"{n}_rate": ratio(F.col(f"{n}_events"), F.col(f"{n}_n")) for n in names})


def _compared(df: DataFrame, a: str, b: str) -> DataFrame:
    """Difference and lift of regime a over regime b."""
    return _rates(df, [a, b]).withColumns({"absolute_difference": F.col(f"{a}_rate") - F.col(f"{b}_rate"), "lift": lift(F.col(f"{a}_rate"), F.col(f"{b}_rate"))})


def _tail(rows: DataFrame, spec: Spec) -> DataFrame:
    true = F.lit(True)
    cells = [({"signal": s.name, "direction": s.direction, "bin": float(b)}, t, {"tail": _mask(s, b), "base": true}) for s in spec.signals for b in s.bins for t in spec.targets]
    return _compared(_cells(rows, cells), "tail", "base")


def _interaction(rows: DataFrame, spec: Spec) -> DataFrame:
    a, b = (_mask(s) for s in spec.signals)
    cells = [({}, t, {"p11": a & b, "p10": a & ~b, "p01": ~a & b, "p00": ~a & ~b}) for t in spec.targets]
    out = _rates(_cells(rows, cells, everything=True), ["p11", "p10", "p01", "p00"])
    return out.withColumn("additive_interaction", F.col("p11_rate") - F.col("p10_rate") - F.col("p01_rate") + F.col("p00_rate"))


def _regimes(rows: DataFrame, spec: Spec) -> DataFrame:
    first = _mask(spec.signals[0])
    every = first
    for s in spec.signals[1:]:
        every = every & _mask(s)
    return _compared(_cells(rows, [({}, t, {"incremental": every, "baseline": first}) for t in spec.targets]), "incremental", "baseline")


def _nested(rows: DataFrame, spec: Spec) -> DataFrame:
    a, b, c = (_mask(s) for s in spec.signals)
    return _compared(_cells(rows, [({}, t, {"incremental": a & b & c, "baseline": a & b & ~c}) for t in spec.targets]), "incremental", "baseline")


def _conditional(rows: DataFrame, spec: Spec) -> DataFrame:
    cells = []
    for combination in product(*(s.bins for s in spec.signals)):
        masks = [_mask(s, f) for s, f in zip(spec.signals, combination, strict=True)]
        base = masks[0]
        for m in masks[1:-1]:
            base = base & m
        label = {"bins": "/".join(f"{f:g}" for f in combination)}
        cells += [(label, t, {"incremental": base & masks[-1], "baseline": base & ~masks[-1]}) for t in spec.targets]
    return _compared(_cells(rows, cells), "incremental", "baseline")


def _banded(rows: DataFrame, spec: Spec) -> DataFrame:
    first, second = (bands(F.col(f"rank__{s.name}"), sorted(s.bins), s.direction) for s in spec.signals[:2])
    return rows.withColumns({"first_band": first, "second_band": second}).where("first_band is not null and second_band is not null")


def _by_band(rows: DataFrame, spec: Spec, everything: bool) -> DataFrame:
    """Cells of two bands, the third signal on and off, by target."""
    third = _mask(spec.signals[2])
    items = [F.struct(F.lit(t).alias("target"), *[c.alias(f"{n}_{p}") for n, m in (("high", third), ("normal", ~third)) for p, c in zip(("n", "events"), _counts(t, m, everything), strict=True)]) for t in spec.targets]
    out = _banded(rows, spec).groupBy("window", "split", "first_band", "second_band").agg(F.array(*items).alias("_c")).withColumn("_c", F.explode("_c"))
    return _compared(out.select("window", "split", "first_band", "second_band", "_c.*"), "high", "normal")


def _labels(s: Signal) -> list[str]:
    edges = sorted(s.bins)
    return [f"{s.direction}_{low:g}_{high:g}" for low, high in zip([0.0, *edges], edges, strict=False)]


def _stratified_interaction(rows: DataFrame, spec: Spec) -> DataFrame:
    """Contrasts of the third signal's effect between weak (outermost) and strong (innermost) bands: with
    the second band fixed, with the first band fixed, and jointly."""
    counts = ("high_n", "high_events", "normal_n", "normal_events")
    cells = _by_band(rows, spec, everything=True).select("window", "split", "target", "first_band", "second_band", F.struct(F.col("absolute_difference").alias("effect"), *counts).alias("cell"))
    one, two = (_labels(s) for s in spec.signals[:2])
    pairs = [("first_weak_vs_strong", one[0], b, one[-1], b) for b in two] + [("second_weak_vs_strong", a, two[0], a, two[-1]) for a in one] + [("joint_weak_vs_strong", one[0], two[0], one[-1], two[-1])]
    every = cells.groupBy("window", "split", "target").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("__", "first_band", "second_band"), "cell"))).alias("cells"))
    items = F.array(*[F.struct(F.lit(k).alias("contrast"), F.lit(f"{a}__{b}").alias("reference"), F.lit(f"{c}__{d}").alias("comparison")) for k, a, b, c, d in pairs])
    out = every.withColumn("_p", F.explode(items)).select("window", "split", "target", "_p.*", F.try_element_at("cells", F.col("_p.reference")).alias("_r"), F.try_element_at("cells", F.col("_p.comparison")).alias("_c"))
    out = out.withColumns({"reference_effect": F.col("_r.effect"), "comparison_effect": F.col("_c.effect")}).withColumn("difference_in_differences", F.col("comparison_effect") - F.col("reference_effect"))
    if spec.bootstrap:
        out = out.withColumns({f"{side}_{k}": F.col(f"_{side[0]}.{k}") for side in ("comparison", "reference") for k in counts})
    return out.drop("_r", "_c")


#: What each analysis compares, by its columns, and whether the first is a part of the second.
_COMPARED = {
    "tail": (["tail", "base"], True), "interaction": (["p11", "p10", "p01", "p00"], False), "regime_comparison": (["incremental", "baseline"], True), "multi_regime_comparison": (["incremental", "baseline"], True),
    "nested_regime_comparison": (["incremental", "baseline"], False), "conditional_regime_comparison": (["incremental", "baseline"], False), "stratified_regime_comparison": (["high", "normal"], False),
    "stratified_interaction": (["comparison_high", "comparison_normal", "reference_high", "reference_normal"], False),
}
_LABELS = ("signal", "bin", "bins", "first_band", "second_band", "contrast", "reference", "comparison")


def intervals(rows: DataFrame, spec: Spec) -> DataFrame:
    """The rows of a specification with bootstrap intervals of what they compare, drawn from their counts."""
    names, nested = _COMPARED[spec.analysis]
    keys = ["window", "split", "target", *[c for c in _LABELS if c in rows.columns]]
    return with_intervals(rows.withColumn("_id", F.lit(spec.id)), names, ["_id", *keys], nested, spec.bootstrap_iterations).drop("_id")


_ANALYSES = {
    "tail": _tail, "interaction": _interaction, "regime_comparison": _regimes, "multi_regime_comparison": _regimes, "nested_regime_comparison": _nested,
    "conditional_regime_comparison": _conditional, "stratified_regime_comparison": lambda r, s: _by_band(r, s, everything=False), "stratified_interaction": _stratified_interaction,
}


def run(panel: DataFrame, spec: Spec, windows: Sequence[Window], date: str = DATE) -> DataFrame:
    """The rows of one specification."""
    return run_all(panel, [spec], windows, date)[spec.id]


def run_all(panel: DataFrame, specs: Sequence[Spec], windows: Sequence[Window], date: str = DATE) -> dict[str, DataFrame]:
    """The rows of several specifications; their ranks and tails are shared."""
    ready = prepare(panel, specs, date)
    out = {}
    for spec in specs:
        if spec.analysis not in _ANALYSES:
            raise SpecError(f"{spec.id}: {spec.analysis} is run by quarry.plans.models")
        chosen = [w for w in windows if not spec.windows or w.name in spec.windows]
        rows = _ANALYSES[spec.analysis](in_windows(ready, chosen, spec.splits, date), spec)
        out[spec.id] = intervals(rows, spec) if spec.bootstrap else rows
    return out


def derive(rows: DataFrame, formulas: dict[str, str], targets: Sequence[str], regimes: tuple[str, ...] = ("baseline", "incremental")) -> DataFrame:
    """Derived metrics of a specification's rows, by window and split. A first pass knows
    <target>_events, <target>_n and <target>_rate within each regime and gives <metric>_<regime>; a
    second one may refer to those."""
    picked = {f"{r}__{t}_{p}": F.first(F.when(F.col("target") == t, F.col(f"{r}_{p}")), ignorenulls=True) for r in regimes for t in targets for p in ("n", "events", "rate")}
    wide = rows.groupBy("window", "split").agg(*[c.alias(k) for k, c in picked.items()])
    made: dict[str, Column] = {}
    for name, text in formulas.items():
        for r in regimes:
            names = {k.split("__", 1)[1]: F.col(k) for k in picked if k.startswith(f"{r}__")}
            try:
                made[f"{name}_{r}"] = expression(text, names)
            except SpecError as why:
                if "unknown name" not in str(why):
                    raise
    wide = wide.withColumns(made)
    cross = {name: expression(text, {k: F.col(k) for k in made}) for name, text in formulas.items() if f"{name}_{regimes[0]}" not in made}
    return wide.withColumns(cross).select("window", "split", *made, *cross)
