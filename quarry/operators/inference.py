"""Resampling: bootstraps and permutations, parallel over groups and draws, reproducible by seed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import stats


def stable_seed(*parts: object) -> int:
    """A seed from any values, the same on every machine."""
    digest = hashlib.sha256("|".join(map(str, parts)).encode()).digest()
    return int.from_bytes(digest[:8], "little") % (2**32 - 1)


def _interval(draws: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    low, high = np.percentile(draws, [50 * (1 - level), 50 * (1 + level)])
    return float(low), float(high)


def bootstrap_mean(x: np.ndarray, seed: int, iterations: int = 2000, least: int = 20, chunk: int = 100) -> tuple[float | None, float | None]:
    """Percentile interval of the mean; none for fewer than `least` values. Draws are made in chunks,
    so memory is chunk times the values."""
    x = np.sort(x[np.isfinite(x)])
    if len(x) < least:
        return None, None
    rng, out = np.random.default_rng(seed), []
    for s in range(0, iterations, chunk):
        out.append(x[rng.integers(0, len(x), size=(min(chunk, iterations - s), len(x)))].mean(1))
    return _interval(np.concatenate(out))


def bootstrap_mean_difference(x: np.ndarray, y: np.ndarray, seed: int, iterations: int = 2000, least: int = 20) -> tuple[float | None, float | None]:
    x, y = np.sort(x[np.isfinite(x)]), np.sort(y[np.isfinite(y)])
    if min(len(x), len(y)) < least:
        return None, None
    rng = np.random.default_rng(seed)
    mean = lambda v: np.concatenate([v[rng.integers(0, len(v), size=(100, len(v)))].mean(1) for _ in range(-(-iterations // 100))])[:iterations]
    return _interval(mean(x) - mean(y))


def rates_from_counts(cells: list[tuple[int, int]], signs: list[int], seed: int, iterations: int = 2000) -> tuple[float, float] | tuple[None, None]:
    """Interval of a signed sum of independent rates, from (events, n) of each cell. Resampling a 0/1
    column is a binomial draw, so the rows are not needed."""
    if any(n == 0 for _, n in cells):
        return None, None
    rng = np.random.default_rng(seed)
    total = sum(s * rng.binomial(n, k / n, iterations) / n for (k, n), s in zip(cells, signs, strict=True))
    return _interval(total)


def joint_cells(cells: dict[tuple[int, int], tuple[int, int]], seed: int, iterations: int = 2000) -> np.ndarray:
    """Draws of p11 - p10 - p01 + p00 with all rows resampled together: cells and events are one
    multinomial draw. Draws in which a cell is empty are left out."""
    keys = [(1, 1), (1, 0), (0, 1), (0, 0)]
    counts = np.array([v for k in keys for v in (cells[k][0], cells[k][1] - cells[k][0])], dtype=float)
    rng = np.random.default_rng(seed)
    draw = rng.multinomial(int(counts.sum()), counts / counts.sum(), iterations).astype(float)
    n = draw[:, 0::2] + draw[:, 1::2]
    ok = (n > 0).all(1)
    p = draw[ok, 0::2] / n[ok]
    return p[:, 0] - p[:, 1] - p[:, 2] + p[:, 3]


def nested_from_counts(inside: tuple[int, int], whole: tuple[int, int], seed: int, iterations: int = 2000) -> tuple[float, float] | tuple[None, None]:
    """Interval of the rate inside a part less the rate of the whole, from (events, n) of both: the whole is
    resampled, so its rows are one multinomial draw. Draws without a row inside are left out."""
    (k, n), (kw, nw) = inside, whole
    if not n or not nw:
        return None, None
    p = np.array([k, n - k, kw - k, nw - n - (kw - k)], dtype=float) / nw
    draw = np.random.default_rng(seed).multinomial(nw, p, iterations).astype(float)
    size = draw[:, 0] + draw[:, 1]
    ok = size > 0
    return _interval(draw[ok, 0] / size[ok] - (draw[ok, 0] + draw[ok, 2]) / nw)


def interval_of(cells: dict[str, tuple[int, int]], nested: bool, seed: int, iterations: int) -> tuple[float | None, float | None]:
    """The interval of a comparison: a part within a whole, a difference of two, an additive interaction
    (p11, p10, p01, p00), or a difference of differences (four cells)."""
    values = list(cells.values())
    if "p11" in cells:
        if any(n == 0 for _, n in values):
            return None, None
        draws = joint_cells({(int(k[1]), int(k[2])): v for k, v in cells.items()}, seed, iterations)
        return _interval(draws) if len(draws) else (None, None)
    if nested:
        return nested_from_counts(values[0], values[1], seed, iterations)
    return rates_from_counts(values, [1, -1] if len(values) == 2 else [1, -1, -1, 1], seed, iterations)


def with_intervals(rows: DataFrame, names: list[str], keys: list[str], nested: bool, iterations: int = 2000) -> DataFrame:
    """Rows of comparisons with ci_low and ci_high, from the counts <name>_events and <name>_n alone. keys
    make the seed of each row."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            got = [interval_of({n: (int(r[f"{n}_events"] or 0), int(r[f"{n}_n"] or 0)) for n in names}, nested, stable_seed(*[r[k] for k in keys]), iterations) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
            yield pdf.assign(ci_low=[x for x, _ in got], ci_high=[y for _, y in got])

    return rows.mapInPandas(run, schema)


#: The distribution function of a Poisson variable with mean 1, as far as 2**-64 matters.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(20)])


def appearances(keys: np.ndarray, draws: int) -> np.ndarray:
    """How often each row appears in each draw: Poisson counts from a hash of the row's key and the draw,
    the same on any layout of the rows."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, u, side="right")


def grouped_bootstrap(df: DataFrame, by: list[str], value: str, key: list[str], iterations: int = 2000, least: int = 20, seed: str = "bootstrap") -> DataFrame:
    """n, mean and percentile interval of the mean of a value in each group; none below `least` values.

    A row's appearances in a draw are a Poisson count, which is resampling without fixing the size of
    the draw. Tasks add their rows up to two numbers a group and draw, so a group may have any size. key
    tells rows apart."""
    spark_seed = stable_seed(seed)
    rows = df.select(*by, F.col(value).cast("double").alias("_x"), F.xxhash64(F.lit(spark_seed), *key).alias("_k")).where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def run(batches):  # noqa: ANN001, ANN202
        held: dict[tuple, np.ndarray] = {}

        def told():  # noqa: ANN202
            out = [pd.DataFrame({**dict(zip(by, g, strict=True)), "draw": np.arange(iterations), "_s": v[0], "_w": v[1]}) for g, v in held.items()]
            held.clear()
            return pd.concat(out)

        for pdf in batches:
            for g, part in pdf.groupby(by, dropna=False):
                g = tuple(None if pd.isna(v) else v for v in (g if isinstance(g, tuple) else (g,)))
                sums = held.setdefault(g, np.zeros((2, iterations)))
                for s in range(0, len(part), 500):
                    x = part["_x"].to_numpy()[s : s + 500]
                    w = appearances(part["_k"].to_numpy()[s : s + 500], iterations)
                    sums += np.stack([x @ w, w.sum(0)])
                if len(held) >= 256:
                    yield told()
        if held:
            yield told()

    drawn = rows.mapInPandas(run, f"{kinds}, draw bigint, _s double, _w double").groupBy(*by, "draw").agg(stats.ratio(F.sum("_s"), F.sum("_w")).alias("_m"))
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    ends = drawn.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(q.alias("_q"))
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"))
    out = size.join(ends, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    return out.select(*by, "n", "mean", *[F.when(F.col("n") >= least, F.element_at("_q", i)).alias(c) for i, c in ((1, "ci_low"), (2, "ci_high"))])


def permutations(spark: SparkSession, draws: int, statistic: Callable[[np.random.Generator], float], seed: int = 42) -> DataFrame:
    """The statistic under `draws` permutations, spread over the cluster by draw number. What the
    statistic closes over is sent to every task: give it arrays of a research sample."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pd.DataFrame({"permutation": pdf["id"], "score": [float(statistic(np.random.default_rng([seed, int(i)]))) for i in pdf["id"]]})

    return spark.range(draws).mapInPandas(run, "permutation bigint, score double")


def empirical_p(observed: float, score: str = "score") -> Column:
    """(draws at or above the observed value + 1) / (draws + 1)."""
    return (F.count_if(F.col(score) >= observed) + 1) / (F.count(F.lit(1)) + 1)


def permute_within(df: DataFrame, by: list[str], column: str, tie: list[str], seed: int) -> DataFrame:
    """Shuffle a column's values among the rows of each group. The order is a hash of the seed and
    the rows' ties, so the same rows give the same shuffle on any layout."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(*by).orderBy(*tie))
    drawn = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *tie), *tie))
    own = df.withColumn("_at", at)
    other = df.select(*[F.col(c).alias(f"_{c}") for c in by], drawn.alias("_n"), F.col(column).alias("_v"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_at") == F.col("_n")]
    return own.join(other, on).withColumn(column, F.col("_v")).drop("_at", "_n", "_v", *[f"_{c}" for c in by])


def auc_of(y: np.ndarray, s: np.ndarray) -> float | None:
    """Area under the ROC curve from average ranks; none for a single class."""
    order = np.argsort(s, kind="stable")
    values, first, count = np.unique(s[order], return_index=True, return_counts=True)
    rank = np.empty(len(s))
    rank[order] = np.repeat(first + (count + 1) / 2, count)
    p, n = int((y > 0).sum()), int((y <= 0).sum())
    return None if not p or not n else float((rank[y > 0].sum() - p * (p + 1) / 2) / (p * n))


def paired_delta_auc(y: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int, iterations: int = 1000) -> tuple[float | None, float | None, float | None]:
    """auc(b) - auc(a) and its interval, both classes resampled apart and both scores on the same rows."""
    up, down = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(up) or not len(down):
        return None, None, None
    rng, out = np.random.default_rng(seed), []
    for _ in range(iterations):
        i = np.concatenate([rng.choice(up, len(up)), rng.choice(down, len(down))])
        out.append(auc_of(y[i], b[i]) - auc_of(y[i], a[i]))
    return auc_of(y, b) - auc_of(y, a), *_interval(np.array(out))


def interaction_interval(groups: dict[str, tuple[int, int]], seed: int, iterations: int = 2000) -> dict[str, float | None]:
    """high-risk high - high-risk low - other high + other low of rates from (events, n): the estimate, its
    interval and how often it is above zero."""
    names = ("risk_high", "risk_low", "other_high", "other_low")
    if any(groups[k][1] == 0 for k in names):
        return {"estimate": None, "ci_low": None, "ci_high": None, "p_positive": None}
    rng, signs = np.random.default_rng(seed), (1, -1, -1, 1)
    draws = sum(s * rng.binomial(groups[k][1], groups[k][0] / groups[k][1], iterations) / groups[k][1] for k, s in zip(names, signs, strict=True))
    low, high = _interval(draws)
    return {"estimate": sum(s * groups[k][0] / groups[k][1] for k, s in zip(names, signs, strict=True)), "ci_low": low, "ci_high": high, "p_positive": float((draws > 0).mean())}


def max_statistic(spark: SparkSession, outcomes: dict[str, np.ndarray], targets: dict[str, tuple[str, Callable[[np.ndarray], np.ndarray]]], masks: np.ndarray, draws: int, seed: int = 42) -> DataFrame:
    """permutation, score: the best lift less 1 over all candidates under permutation of the outcomes.

    Each return column is shuffled once per draw among its finite rows, so the targets made from it stay
    coherent. masks: candidates x rows. The research sample goes to every task; draws run in parallel."""
    masks = np.asarray(masks, dtype=np.float32)

    def statistic(rng: np.random.Generator) -> float:
        shuffled = {}
        for k in sorted(outcomes):
            v = outcomes[k].copy()
            at = np.flatnonzero(np.isfinite(v))
            v[at] = v[rng.permutation(at)]
            shuffled[k] = v
        best = -np.inf
        for column, make in targets.values():
            v = shuffled[column]
            ok = np.isfinite(v)
            y = np.where(ok, make(np.where(ok, v, 0.0)), 0.0).astype(np.float32)
            n, e = masks @ ok.astype(np.float32), masks @ y
            base = y.sum() / max(1, ok.sum())
            if base > 0 and (n > 0).any():
                best = max(best, float((e[n > 0] / n[n > 0] / base - 1).max()))
        return best

    return permutations(spark, draws, statistic, seed)


def null_test(spark: SparkSession, y: np.ndarray, mask: np.ndarray, draws: int, seed: int = 42) -> dict[str, float]:
    """The lift of a frozen selection against shuffled outcomes of the same period."""
    y, mask = np.asarray(y, float), np.asarray(mask, bool)
    ok = np.isfinite(y)
    y, mask = y[ok], mask[ok]
    base = float((y > 0).mean()) if len(y) else 0.0
    if not base or not mask.any():
        return {"observed": float("nan"), "p_value": float("nan"), "exceedances": 0}
    observed = float((y[mask] > 0).mean() / base)
    k, n = int((y > 0).sum()), len(y)
    # the events that a shuffle puts into the selection are a hypergeometric draw
    scores = permutations(spark, draws, lambda rng: float(rng.hypergeometric(k, n - k, int(mask.sum())) / mask.sum() / base), seed)
    row = scores.agg(F.count_if(F.col("score") >= observed).alias("e"), empirical_p(observed).alias("p")).first()
    return {"observed": observed, "p_value": row["p"], "exceedances": row["e"]}
