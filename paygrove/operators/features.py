"""From declared features to the published matrix: one lazy plan of windows grouped by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrove.operators import kernels as k
from paygrove.operators import spans
from paygrove.operators.entity import explode_entities, predicates, row_values
from paygrove.operators.registry import FEATURES, Feature, check, spec_hash

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Order statistics by the share of the window's values below them.
ORDERS = {"min": 0.0, "max": 1.0, "median": 0.5, "quantile": None}
#: Declared category lists; a value outside its list is refused.
CODES = {"local_hour": list(range(24)), "txn_type": ["click", "error", "purchase", "signup", "view"]}
ROW_COLUMNS = {
    "amount_minor", "counterparty", "event_date_local", "balance_after", "balance_delta_abs_minor", "ts_us", "local_hour", "txn_type",
    "gap_since_previous_event_s", "gap_since_previous_event_days",
}
KEYS = ["txn_id", "ts_us", "entity", "counterparty", "direction", "sign", "currency"]


def code(source: str) -> Column:
    values = F.array(*[F.lit(v) for v in CODES[source]])
    at = F.array_position(values, F.col(source)) - 1
    return F.when(at >= 0, at.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"undeclared {source}: "), F.col(source).cast("string"))).cast("int"))


def build(
    events: DataFrame, features: list[Feature] | None = None, sealed_us: int | None = None, entities: DataFrame | None = None,
    busy: int = spans.ROWS, slot_us: int = spans.SLOT,
) -> DataFrame:
    """Keys and all event-level features of both sides of each event; of the accounts in ``entities`` (entity) only, if given.

    Counts, sums, means, deviations and windowed distinct counts are differences of sums
    that only grow (``kernels.grown``), minima, maxima and quantiles come from one pass per
    key in order of time (``orders.passed``). Under a seal, late arrivals stay as rows and
    leave all windows. Everything is partitioned by entity. Entities with more than
    ``busy`` rows are dealt by time (``spans``): each pass (``kernels.sweep``,
    ``orders.sliding``) then sorts no more than a cell of an entity, and carries the rest over.
    """
    chosen = [f for f in (features or FEATURES) if f.kind not in ("graph", "rule")]
    preds = predicates(sealed_us)
    layers = check(chosen, ROW_COLUMNS, set(preds))
    if sealed_us is not None and "ingested_us" not in events.columns:  # landed rows carry a timestamp
        events = events.withColumn("ingested_us", F.unix_micros(F.col("ingested_at").cast("timestamp")))
    d = explode_entities(events)
    d = d if entities is None else d.join(entities.select("entity"), "entity", "left_semi").select(*d.columns)
    cells = spans.cells(d, "entity", rows=busy, slot_us=slot_us)
    dealt = cells is not None
    d = row_values(cells.place(d) if dealt else d, dealt)
    d = d.withColumns({f"_p_{n}": p for n, p in preds.items()})
    live = ~F.col("_p_late_arrival")

    def where(f: Feature) -> Column:
        own = F.col(f.where) if f.where in {x.name for x in chosen} else F.col(f"_p_{f.where}")
        return F.coalesce(own.cast("boolean"), F.lit(False)) & live

    for layer in layers:
        plain, sweeps, ranked, firsts, lasts = {}, {}, {}, {}, {}
        for f in layer:
            x = F.col(f.source) if f.source and f.kind != "flag" else F.lit(1)
            keys = [c for c in f.keys if c != "currency"]  # one currency per account is a contract
            if f.kind == "flag":
                plain[f.name] = F.col(f"_p_{f.source}")
            elif f.kind == "row_value":
                plain[f.name] = F.col(f.source)
            elif f.kind == "code":
                plain[f.name] = code(f.source)
            elif f.kind in ("first_ever", "lifetime_distinct"):
                firsts[f.name] = f
            elif f.kind == "age_days":
                lasts[f.name] = (F.col("ts_us"), "min", DAY)
            elif f.kind == "recency_hours":
                lasts[f.name] = (F.when(where(f), F.col("ts_us")), "max", HOUR)
            elif f.kind == "difference":
                plain[f.name] = F.col(f.source) - F.col(f.args[0])
            elif f.kind == "quotient":
                plain[f.name] = k.quotient(F.col(f.source), F.col(f.args[0]), f.args[1])
            elif f.kind in ORDERS:
                q = f.args[0] if f.kind == "quantile" else ORDERS[f.kind]
                ranked.setdefault(tuple(keys), {})[f.name] = (F.when(where(f), x), q, f.width)
            else:
                sweeps.setdefault(tuple(keys), []).append((f, x))
        d = d.withColumns(plain) if plain else d
        for f in firsts.values():
            d = k.first_ever(d, [c for c in f.keys if c != "currency"], f.source, where(f), f.name, dealt=dealt)
        if counted := {n: (F.col(n), "sum") for n, f in firsts.items() if f.kind == "lifetime_distinct"}:
            d = spans.running(d, ["entity"], counted, dealt=dealt)
        if lasts:
            d = spans.running(d, ["entity"], {n: (v, agg) for n, (v, agg, _) in lasts.items()}, dealt=dealt)
            d = d.withColumns({n: k.units_since(F.col(n), unit) for n, (_, _, unit) in lasts.items()})
        for keys, targets in ranked.items():
            d = k.window_orders(d, list(keys), targets, cells=cells)
        for keys, fs in sweeps.items():
            d = _swept(d, list(keys), fs, where, cells)
    return d.select(*KEYS, *[f.name for f in chosen if f.name not in KEYS])


def _swept(d: DataFrame, keys: list[str], fs: list[tuple[Feature, Column]], where, cells: spans.Cells | None) -> DataFrame:
    sums: dict[str, tuple[Column, Column]] = {}
    grows: dict[str, tuple[Column, Column, int]] = {}
    need: dict[str, tuple[str, Feature]] = {}
    ends = []
    big = "decimal(38,0)"
    width = {n: f.width for f, _ in fs for n in (f.name, f"__n_{f.name}", f"__s_{f.name}", f"__q_{f.name}")}
    for f, x in fs:
        ok, end = where(f), k.leaves_after(f.width)
        n, s, ss = f"__n_{f.name}", f"__s_{f.name}", f"__q_{f.name}"
        if f.kind == "distinct" and cells is None:
            ends += [f"__a_{f.name}", f"__z_{f.name}"]
            comes, goes = k.first_and_last(d, keys, f.source, f.width, order=("txn_id", "sign"))
            d = d.withColumns({ends[-2]: comes, ends[-1]: goes})
            grows[f.name] = (F.col(ends[-2]), F.col(ends[-1]), f.width)
        elif f.kind == "distinct":
            ends.append(f"__e_{f.name}")
            d = k.leaves_distinct(d, keys, f.source, f.width, ends[-1], order=("txn_id", "sign"), dealt=cells is not None)
            sums[f.name] = (ok.cast("long"), F.col(ends[-1]))
        elif f.kind == "count":
            sums[f.name] = (ok.cast("long"), end)
        elif f.kind == "sum":
            sums[f.name] = (F.when(ok, x).cast("long"), end)
        else:
            if f.kind == "benford":
                x = F.round(F.pmod(F.log10(F.when(x > 0, x)), F.lit(1.0)) * 1e6).cast("long")
            use = ok & x.isNotNull()
            sums[n] = (use.cast("long"), end)
            sums[s] = (F.when(use, x).cast("long"), end)
            if f.kind in ("robust_z", "burstiness", "cv", "std"):
                sums[ss] = (F.when(use, x.cast(big) * x.cast(big)).cast(big), end)
            need[f.name] = (f.kind, f)
    if cells is None:
        d = k.grown(d, keys, grows | {n: (v, v, width[n] + 1) for n, (v, _) in sums.items()})
    else:
        d = k.sweep(d, keys, sums, cells=cells)
    out = {}
    for name, (kind, f) in need.items():
        n, s = F.col(f"__n_{name}"), F.col(f"__s_{name}")
        mean = s.cast("double") / F.nullif(n, F.lit(0))
        if kind == "mean_int":
            out[name] = F.when(n > 0, F.floor((s - F.pmod(s, F.nullif(n, F.lit(0)))) / F.nullif(n, F.lit(0))).cast("long"))
        elif kind == "mean":
            out[name] = mean
        elif kind == "benford":
            out[name] = F.when(n > 0, 2 * F.abs(mean / 1e6 - 0.5))
        else:
            std = k.sample_std(n, s, F.col(f"__q_{name}"))
            if kind == "std":
                out[name] = std
            elif kind == "cv":
                out[name] = F.when(mean != 0, std / mean)
            elif kind == "burstiness":
                out[name] = F.when(std + mean != 0, (std - mean) / (std + mean))
            else:
                out[name] = F.when((std > 0) & (F.col(f.source) != 0), (F.col(f.source) - mean) / std)
    return (d.withColumns(out) if out else d).drop(*[c for c in (*sums, *ends) if c.startswith("__")])


def check_hash(stored: str, features: list[Feature]) -> None:
    if stored != spec_hash(features):
        raise ValueError("the stored table was built from other declarations")


def winsor_bounds(train: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(column, lo, hi): lower quantiles, elements of the training rows.

    Ranks come from counts per distinct value, so no column is gathered.
    """
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))).filter("x is not null")
    from pyspark.sql import Window

    counts = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy("x")
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("column")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("x")))
    return c.groupBy("column").agg(at(low).alias("lo"), at(high).alias("hi"))


def winsorise(df: DataFrame, bounds: DataFrame, cols: list[str]) -> DataFrame:
    """Clip each column to its fitted bounds; nulls stay null."""
    b = bounds.groupBy().agg(*[x for c in cols for x in (
        F.max(F.when(F.col("column") == c, F.col("lo"))).alias(f"__lo_{c}"), F.max(F.when(F.col("column") == c, F.col("hi"))).alias(f"__hi_{c}"),
    )])
    d = df.join(F.broadcast(b))  # one row
    clip = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c).cast("double"), F.col(f"__hi_{c}")), F.col(f"__lo_{c}"))) for c in cols}
    return d.withColumns(clip).select(*df.columns)

