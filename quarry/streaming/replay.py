"""The position log as a stream: state per holder and instrument, totals per instrument."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def totals(log: DataFrame) -> DataFrame:
    """A changelog of instruments: each micro-batch gives, for the instruments that it touches, the
    state after each date in it. The state is the last position of each holder of one instrument.

    log is a stream with holder, issuer, isin, issuer_key, position_date, position. Within a batch rows
    count by date; a row that is older than its holder's last one is late and ignored."""

    def update(key: tuple[str], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[float, int]] = {}
        if state.exists:
            (names, positions, days) = state.get
            held = {n: (p, d) for n, p, d in zip(names, positions, days, strict=True)}
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["position_date", "holder"], kind="stable")
        out = []
        for day, part in rows.groupby("position_date", sort=True):
            number = pd.Timestamp(day).toordinal()
            for r in part.itertuples():
                if number >= held.get(r.holder, (0.0, 0))[1]:
                    held[r.holder] = (float(r.position), number)
            live = [p for p, _ in held.values() if p > 0]
            total = sum(live)
            out.append((key[0], day, round(total, 6), len(live), round(max(live, default=0.0), 6), round(max(live, default=0.0) / total * 100, 6) if total else None))
        state.update((list(held), [p for p, _ in held.values()], [d for _, d in held.values()]))
        yield pd.DataFrame(out, columns=["issuer_key", "snapshot_date", "short_interest_pct", "active_holders", "max_individual_position_pct", "max_position_share_pct"])

    return log.groupBy("issuer_key").applyInPandasWithState(
        update,
        "issuer_key string, snapshot_date date, short_interest_pct double, active_holders int, max_individual_position_pct double, max_position_share_pct double",
        "names array<string>, positions array<double>, days array<int>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events a day, closed once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")
