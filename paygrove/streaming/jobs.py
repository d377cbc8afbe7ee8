"""Streaming jobs: canonical ingest with a watermark, pass-through and cash-out alerts per account."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PASS = "account string, currency string, ratio double, received_id string, sent_id string, sent_us long"
CASHED = "account string, currency string, inflow_id string, inflow_us long, inflow_minor long, cashed_minor long, share double, last_out_us long"
_STATE = "r_ts array<bigint>, r_ids array<string>, r_amounts array<bigint>, s_ts array<bigint>, s_ids array<string>, s_amounts array<bigint>"

# the process that a stream starts for a processor has the driver's path only by chance, so this module's code goes with it
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ingest(raw: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Events once each: repeats of a txn_id within the watermark are dropped, rows behind it too.

    ``raw`` is a stream of canonical rows with ``ts_us``; the watermark is the seal after
    which a window's numbers don't move.
    """
    d = raw.withColumn("event_ts_utc", F.timestamp_micros("ts_us")).withWatermark("event_ts_utc", lateness)
    return d.dropDuplicatesWithinWatermark(["txn_id"])


def late_counts(raw: DataFrame, seal_us: int) -> DataFrame:
    """Rows at or before the seal that were ingested after it, per source."""
    late = (F.col("ts_us") <= seal_us) & (F.col("ingested_us") > seal_us)
    return raw.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"))


def best_receives(receives: pd.DataFrame, sends: pd.DataFrame, share_micro: int, width_us: int) -> pd.DataFrame:
    """Sends of one key with the receive of the last window that gives the highest ratio, if one passes the share.

    The highest ratio comes from the smallest receive, the earlier one on ties, so it is a
    minimum of ranks over a range of the receives in time order.
    """
    r = receives.sort_values(["ts_us", "txn_id"]).reset_index(drop=True)
    s = sends.reset_index(drop=True)
    lo = np.searchsorted(r.ts_us.to_numpy(), s.ts_us.to_numpy() - width_us, "left")
    hi = np.searchsorted(r.ts_us.to_numpy(), s.ts_us.to_numpy(), "right")
    s, lo, hi = s[hi > lo], lo[hi > lo], hi[hi > lo]
    if not len(s):
        return pd.DataFrame(columns=["ratio", "received_id", "sent_id", "sent_us"])
    order = r.sort_values(["amount_minor", "ts_us", "txn_id"]).index.to_numpy()
    rank = np.empty(len(r) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(r)), len(r)
    best = order[np.minimum.reduceat(rank, np.stack([lo, hi], 1).ravel())[::2]]
    sent, got = s.amount_minor.to_numpy(), r.amount_minor.to_numpy()[best]
    out = pd.DataFrame({"ratio": sent / got, "received_id": r.txn_id.to_numpy()[best], "sent_id": s.txn_id.to_numpy(), "sent_us": s.ts_us.to_numpy()})
    return out[sent * 1_000_000 >= got * share_micro]


def pass_through(legs: DataFrame, share_micro: int = 800_000, width_us: int = 3_600_000_000, least_minor: int = 10_000, lateness: str = "1 hour") -> DataFrame:
    """Alerts of rule R1, keyed by account and currency, the same in whatever order rows come within the watermark.

    A send waits until the watermark passes it, when every receive that it could match
    has come; then it alerts with the receive that gives the highest ratio. State is the
    waiting sends and the receives that one of them, or a later one, can still match.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["ts_us", "txn_id", "amount_minor"]
        held = state.get if state.exists else ([],) * 6
        receives, sends = (pd.DataFrame(dict(zip(cols, held[k : k + 3], strict=True))).astype({"ts_us": "int64", "amount_minor": "int64"}) for k in (0, 3))
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            receives = pd.concat([receives, rows[(rows.side == "in") & (rows.amount_minor >= least_minor)][cols]])
            sends = pd.concat([sends, rows[rows.side == "out"][cols]])
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sends.ts_us < passed
        out = best_receives(receives, sends[ready], share_micro, width_us)
        sends, receives = sends[~ready], receives[receives.ts_us >= passed - width_us]
        if len(sends) or len(receives):
            state.update(tuple(x.tolist() for d in (receives, sends) for x in (d.ts_us, d.txn_id, d.amount_minor)))
            # when the first send is passed, or the last receive can match no more
            last = int(sends.ts_us.min()) + 1 if len(sends) else int(receives.ts_us.max()) + width_us
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if len(out):
            yield out.assign(account=key[0], currency=key[1])[["account", "currency", "ratio", "received_id", "sent_id", "sent_us"]]

    d = legs.withColumn("event_ts_utc", F.timestamp_micros("ts_us")).withWatermark("event_ts_utc", lateness)
    return d.groupBy("account", "currency").applyInPandasWithState(step, PASS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def pass_through_batch(legs: DataFrame, share_micro: int = 800_000, width_us: int = 3_600_000_000, least_minor: int = 10_000) -> DataFrame:
    """The same alerts from a table: an interval join, best receive per send."""
    from paygrove.operators.paths import interval_join

    s = legs.filter("side = 'out'").select("account", "currency", F.col("ts_us").alias("sent_us"), F.col("txn_id").alias("sent_id"), F.col("amount_minor").alias("s"))
    r = legs.filter((F.col("side") == "in") & (F.col("amount_minor") >= least_minor)).select(F.col("account").alias("ra"), F.col("currency").alias("rc"), F.col("ts_us").alias("r_ts"), F.col("txn_id").alias("r_id"), F.col("amount_minor").alias("r"))
    j = interval_join(s, r, [("account", "ra"), ("currency", "rc")], "sent_us", "r_ts", width_us, 0).filter(F.col("s") * 1_000_000 >= F.col("r") * F.lit(share_micro))
    b = j.groupBy("account", "currency", "sent_id", "sent_us").agg(F.min(F.struct((-(F.col("s") / F.col("r"))).alias("k"), "r_ts", "r_id")).alias("b"))
    return b.select("account", "currency", (-F.col("b.k")).alias("ratio"), F.col("b.r_id").alias("received_id"), "sent_id", "sent_us")


def cashed_out(inflows: pd.DataFrame, outs: pd.DataFrame, share_micro: int, width_us: int) -> pd.DataFrame:
    """Inflows of one key of which the cash-outs within the width after them are at least the share, by running sums in time order."""
    o, i = outs.sort_values("ts_us"), inflows.sort_values(["ts_us", "txn_id"])
    at, upto = o.ts_us.to_numpy(), np.concatenate([[0], np.cumsum(o.amount_minor.to_numpy(np.int64))])
    lo, hi = np.searchsorted(at, i.ts_us.to_numpy(), "left"), np.searchsorted(at, i.ts_us.to_numpy() + width_us, "right")
    total, got = upto[hi] - upto[lo], i.amount_minor.to_numpy(np.int64)
    keep = (hi > lo) & (total * 1_000_000 >= got * share_micro)
    return pd.DataFrame({
        "inflow_id": i.txn_id.to_numpy()[keep], "inflow_us": i.ts_us.to_numpy()[keep], "inflow_minor": got[keep], "cashed_minor": total[keep],
        "share": total[keep] / np.maximum(got[keep], 1), "last_out_us": at[hi[keep] - 1] if len(at) else at,
    })


class CashOuts(StatefulProcessor):
    """Per account and currency: inflows whose window is open, and the cash-outs that an open or a coming inflow can still count.

    Rows are appended to two lists. A key waits for one timer: the first instant, rounded
    up to ``SLICE_MS``, at which the watermark settles a window or, where none is open,
    a cash-out. Then all that is settled is given out in one pass, what nothing can use
    any more leaves the state, and the timer of what is left is set.
    """

    SLICE_MS = 60_000

    def __init__(self, share_micro: int, width_us: int) -> None:
        self.share_micro, self.width_us = share_micro, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "ts_us long, txn_id string, amount_minor long"
        self.handle = handle
        self.inflows, self.outs = handle.getListState("inflows", row), handle.getListState("outs", row)
        self.pending = handle.getValueState("pending", "ms long")

    def _due(self, ts_us: pd.Series) -> pd.Series:
        """The slice's end after an instant, in milliseconds."""
        return (ts_us // 1000 // self.SLICE_MS + 1) * self.SLICE_MS

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.pending.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cols, due = ["ts_us", "txn_id", "amount_minor"], []
        for d in rows:
            for state, side, wait in ((self.inflows, "in", self.width_us), (self.outs, "out", 0)):
                part = d.loc[d.side == side, cols]
                if len(part):
                    state.appendList(list(zip(part.ts_us.tolist(), part.txn_id.tolist(), part.amount_minor.tolist(), strict=True)))
                    due.append(int(self._due(part.ts_us + wait).min()))
        if due and not (self.pending.exists() and self.pending.get()[0] <= min(due)):
            self._wake(min(due))
        return iter(())

    def _held(self, state) -> pd.DataFrame:
        rows = list(state.get()) if state.exists() else []
        return pd.DataFrame(rows, columns=["ts_us", "txn_id", "amount_minor"]).astype({"ts_us": "int64", "amount_minor": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.pending.exists() or self.pending.get()[0] > now:
            return  # another timer of this batch has settled all there is
        inflows, outs = self._held(self.inflows), self._held(self.outs)
        closed = self._due(inflows.ts_us + self.width_us) <= now
        found, still = cashed_out(inflows[closed], outs, self.share_micro, self.width_us), inflows[~closed]
        from_us = min([now * 1000, *still.ts_us.tolist()])
        left = outs[outs.ts_us >= from_us]
        for state, before, d in ((self.inflows, inflows, still), (self.outs, outs, left)):
            if not len(d):
                state.clear()
            elif len(d) < len(before):
                state.put(list(d.itertuples(index=False, name=None)))
        if len(still) or len(left):
            self._wake(int((self._due(still.ts_us + self.width_us) if len(still) else self._due(left.ts_us)).min()))
        else:
            self.pending.clear()
        if len(found):
            yield found.assign(account=key[0], currency=key[1])[[c.split()[0] for c in CASHED.split(", ")]]


def fast_cash_out(
    legs: DataFrame, share_micro: int = 900_000, width_us: int = 86_400_000_000, cash_out: tuple[str, ...] = ("cash_out",), lateness: str = "1 hour",
) -> DataFrame:
    """Alerts of rule R10, keyed by account and currency, the same in whatever order rows come within the watermark.

    ``legs`` is a stream with account, currency, side, ts_us, txn_id, txn_type and
    amount_minor. An inflow alerts once, when the watermark has passed its window, with
    all that was cashed out in it. Rows without an account or a currency form keys of
    their own; rows without an instant, an amount or a positive amount take no part. Rows
    behind the watermark are dropped. The state store must be
    RocksDB when the stream starts (``get_spark``, or ``session.state_store``).
    """
    d = legs.filter(F.col("ts_us").isNotNull() & (F.col("amount_minor") > 0) & ((F.col("side") == "in") | F.col("txn_type").isin(*cash_out)))
    d = d.withColumn("event_ts_utc", F.timestamp_micros("ts_us")).withWatermark("event_ts_utc", lateness)
    return d.groupBy("account", "currency").transformWithStateInPandas(CashOuts(share_micro, width_us), CASHED, "Append", "EventTime")


def fast_cash_out_batch(legs: DataFrame, share_micro: int = 900_000, width_us: int = 86_400_000_000, cash_out: tuple[str, ...] = ("cash_out",)) -> DataFrame:
    """The same alerts from a table, by window sums over the cash-outs of two blocks of time."""
    from paygrove.operators.kernels import over_items

    cols = ("account", "currency", "ts_us", "txn_id", "amount_minor")
    d = legs.filter(F.col("ts_us").isNotNull() & (F.col("amount_minor") > 0))
    inn = d.filter("side = 'in'").select("account", "currency", F.col("ts_us").alias("inflow_us"), F.col("txn_id").alias("inflow_id"), F.col("amount_minor").alias("inflow_minor"))
    out = d.filter((F.col("side") == "out") & F.col("txn_type").isin(*cash_out)).select(*cols)
    e = over_items(inn, out, ["account", "currency"], F.col("inflow_us"), width_us, {"cashed_minor": (F.col("amount_minor"), "sum"), "last_out_us": (F.col("ts_us"), "max")})
    e = e.filter(F.col("cashed_minor").isNotNull() & (F.col("cashed_minor") * 1_000_000 >= F.col("inflow_minor") * F.lit(share_micro)))
    return e.select("account", "currency", "inflow_id", "inflow_us", "inflow_minor", "cashed_minor", (F.col("cashed_minor") / F.col("inflow_minor")).alias("share"), "last_out_us")
