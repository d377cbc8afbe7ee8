"""Tables of a fold: account measures and rule hits seen before its cutoff, joined to a feature matrix, and the frames built on it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrove.operators import features, graph, paths, rules
from paygrove.operators.registry import FEATURES, Feature
from paygrove.operators.splits import Fold
from paygrove.session import bucketed_table, scratch_table

DAY = 86_400_000_000
LOCAL, GLOBAL, TYPOLOGY = "graph_local", "graph_global", "graph_typology"


def cutoff(fold: Fold) -> int:
    """The last instant that a fold's tables may see: the end of training, less the purge."""
    return fold.train_end - fold.purge_us - 1


def horizon(events: DataFrame, at_us: int, width_us: int | None = None) -> DataFrame:
    """Events up to an instant, within ``width_us`` before it if given; the filter reaches the scan."""
    e = events.filter(F.col("ts_us") <= at_us)
    return e if width_us is None else e.filter(F.col("ts_us") > at_us - width_us)


def node_table(
    events: DataFrame, fold: Fold, parts: Iterable[str] = (LOCAL, GLOBAL, TYPOLOGY), pivots: int = 500, cycle_hop_us: int | None = None,
    cycles: DataFrame | None = None,
) -> DataFrame:
    """(fold, account, measures, last_ts_us): what the events before the fold's cutoff say of each account.

    Local measures are of the last thirty days before the cutoff, all others of everything
    before it. Null where an account has no such measure; an account on no cycle takes part
    in 0 of them and has no retention. ``cycles``: those of all folds (``fold_cycles``).
    """
    at = cutoff(fold)
    seen = horizon(events, at)
    base = graph.typed(graph.nodes(seen)).select("account", "last_ts_us", "is_external")
    tables = []
    if LOCAL in parts:
        recent = horizon(events, at, 30 * DAY)
        n = graph.typed(graph.nodes(recent))
        tables += [
            n.select("account", "in_degree", "out_degree", "self_transfer_count"),
            graph.effective_fan(n, graph.links(recent)), graph.local_density(recent).select("account", "local_density_bps"),
            graph.downstream_outflow(seen, at),
        ]
    if GLOBAL in parts:
        tables += [
            graph.pagerank(seen), graph.betweenness(seen, pivots), graph.k_core(seen), graph.communities(seen),
        ]
    if TYPOLOGY in parts:
        known = paths.cycles(paths.adjacency(seen), hop_us=cycle_hop_us) if cycles is None else closed(cycles, at)
        found = paths.cycle_participation(known)
        tables.append(found.withColumnRenamed("longest_cycle_length", "longest_chain_length"))
    for t in tables:
        base = base.join(t, "account", "left")
    if TYPOLOGY in parts:  # the search ran, so an account on no cycle is on zero of them
        base = base.withColumn("cycle_participation_count", F.coalesce("cycle_participation_count", F.lit(0)))
    return base.withColumn("fold", F.lit(fold.fold))


def fold_cycles(events: DataFrame, folds: list[Fold], settings: rules.Settings | None = None) -> DataFrame | None:
    """The cycles up to the last fold's cutoff, searched and written once; ``closed`` gives those of each fold.

    None if a search of these settings may stop early: then each fold's own counts.
    """
    s = settings or rules.Settings()
    return None if s.r4_cap is not None else scratch_table(rules.r4_cycles(horizon(events, max(map(cutoff, folds))), s), "cycles")


def closed(cycles: DataFrame, at_us: int) -> DataFrame:
    """The cycles that are closed at an instant: what a search over the events up to it finds, since hops go forward in time."""
    return cycles.filter(F.element_at("at", -1) <= at_us)


def hit_table(
    events: DataFrame, fold: Fold, settings: rules.Settings | None = None, only: tuple[str, ...] | None = None, cycles: DataFrame | None = None,
) -> DataFrame:
    """(fold, hits): hits of all rules on the events before the fold's cutoff; ``cycles`` are those of all folds (``fold_cycles``)."""
    seen = horizon(events, cutoff(fold))
    out = graph.typed(graph.nodes(seen)).filter("node_type in ('rail', 'external')")
    return rules.run_rules(seen, settings, excluded=out, only=only, cycles=None if cycles is None else closed(cycles, cutoff(fold))).withColumn("fold", F.lit(fold.fold))


def per_fold(events: DataFrame, folds: list[Fold], make, name: str = "fold-tables") -> DataFrame:
    """One table of what ``make`` gives for each fold (a handful), written once."""
    out = None
    for f in folds:
        t = make(events, f)
        out = t if out is None else out.unionByName(t)
    return scratch_table(out, name)


def sealed(table: DataFrame, folds: list[Fold], seen: str = "last_ts_us") -> DataFrame:
    """``table`` (fold, ...), refused if a row of it was seen after its fold's cutoff.

    The instant is checked row by row where the table is read, in a filter, which stays
    in the plan whatever columns are read later; so the check costs no job.
    """
    at = F.create_map(*[F.lit(x) for f in folds for x in (f.fold, cutoff(f))])
    ok = F.col(seen).isNull() | (F.col(seen) <= at[F.col("fold")])
    bad = F.concat(F.lit("fold "), F.col("fold"), F.lit("'s table saw an event after its cutoff"))
    return table.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))


def attach(rows: DataFrame, nodes: DataFrame | None = None, hits: DataFrame | None = None, declared: list[Feature] | None = None) -> DataFrame:
    """``rows`` (fold, entity, ...) with the graph and rule features of their fold, null where nothing was seen."""
    declared = declared or FEATURES
    d = rows
    if nodes is not None:
        fs = [f for f in declared if f.kind == "graph" and f.source in nodes.columns]
        d = d.join(nodes.select("fold", F.col("account").alias("entity"), *[F.col(f.source).alias(f.name) for f in fs]), ["fold", "entity"], "left")
    if hits is not None:
        fs = [f for f in declared if f.kind == "rule"]
        made = {"COUNT": F.count(F.lit(1)), "MAX": F.max("severity")}
        one = lambda f: made.get(f.source, F.max(F.when(F.col("rule_id") == f.source, F.col("severity"))))
        per = hits.groupBy("fold", F.col("account_key").alias("entity")).agg(*[one(f).alias(f.name) for f in fs])
        d = d.join(per, ["fold", "entity"], "left")
    return d


def null_rates(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, nulls, rate) of each column, from one pass."""
    rate = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{k}").alias("nulls")) for k, c in enumerate(cols)]))
    one = matrix.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n_{k}") for k, c in enumerate(cols)])
    return one.select("n", rate).select("column", "n", "nulls", F.try_divide("nulls", "n").alias("rate"))


def finite(matrix: DataFrame, cols: list[str]) -> DataFrame:
    """``matrix``, refused at the first NaN or infinite value; checked where it is read."""
    def ok(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast(dict(matrix.dtypes)[c])).otherwise(F.col(c))

    return matrix.withColumns({c: ok(c) for c in cols if dict(matrix.dtypes)[c] in ("double", "float")})


def label_correlations(matrix: DataFrame, cols: list[str], label: str, ceiling: float = 0.98) -> DataFrame:
    """(column, correlation, leaks): each column's absolute correlation with the label; null where one of the two doesn't vary.

    Whether one varies is told by its extrema: means of parts are merged with rounding, so
    the spread of a constant needn't be 0.
    """
    def corr(c: str) -> Column:
        both = F.col(c).isNotNull() & F.col(label).isNotNull()  # over the rows that have both
        x, y = (F.when(both, F.col(k).cast("double")) for k in (c, label))
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies, F.abs(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))))

    made = [corr(c).alias(f"c_{k}") for k, c in enumerate(cols)]
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c_{k}").alias("correlation")) for k, c in enumerate(cols)]))
    return matrix.agg(*made).select(rows).withColumn("leaks", F.coalesce(F.col("correlation") > ceiling, F.lit(False)))


def bridge(matrix: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """From transactions to accounts: one row per (entity, instant) with the label of all its transactions.

    The last row of the instant, by transaction id and side, gives the features. The label is the highest and the
    typology that of the last positive one. ``labels`` has txn_id, label_is_fraud and label_typology.
    """
    d = matrix.join(labels.select("txn_id", "label_is_fraud", "label_typology"), "txn_id")
    last = F.struct("txn_id", "sign")
    positive = F.when((F.col("label_is_fraud") == 1) & F.col("label_typology").isNotNull(), last)
    return d.groupBy("entity", F.col("ts_us").alias("as_of_us")).agg(
        F.max_by(F.struct("txn_id", *keep), last).alias("x"), F.count(F.lit(1)).alias("transactions"), F.max("label_is_fraud").alias("label_is_fraud"),
        F.max_by("label_typology", positive).alias("label_typology"),
    ).select("entity", "as_of_us", "x.*", "transactions", "label_is_fraud", "label_typology")


def scoring_frame(matrix: DataFrame, labels: DataFrame, cols: list[str]) -> DataFrame:
    """A row per account, fold and role: its latest features there, and whether any of its transactions there is labelled.

    ``matrix`` lies in buckets of the account, so only the labels (txn_id,
    label_is_fraud) and one row per account come through a shuffle.
    """
    d = matrix.filter(F.col("role").isin("train", "valid", "test")).join(labels.select("txn_id", "label_is_fraud"), "txn_id")
    last = F.struct("ts_us", "txn_id", "sign")
    x = d.groupBy(F.col("entity").alias("account_key"), "fold", "role").agg(
        F.max_by(F.struct("currency", *[F.col(c).cast("double").alias(c) for c in cols]), last).alias("x"), F.max("label_is_fraud").alias("label"), F.count(F.lit(1)).alias("transactions"))
    return x.select("account_key", "fold", "role", "x.*", "label", "transactions")


def by_role(frame: DataFrame) -> dict[str, DataFrame]:
    """Slices of an assigned frame (fold, role, ...) that models use: each role of each fold, and over all folds."""
    return {r: frame.filter(F.col("role") == r) for r in ("train", "valid", "test")}


def pooled(frame: DataFrame, role: str) -> DataFrame:
    """Rows of a role over all folds, one per (row, fold), each naming its fold."""
    return frame.filter(F.col("role") == role)


def mixed_currencies(events: DataFrame) -> DataFrame:
    """Accounts that move more than one currency: none may, where features add up amounts."""
    return events.select("currency", F.explode(F.array("account_from", "account_to")).alias("account")).groupBy("account").agg(
        F.countDistinct("currency").alias("currencies")).filter("currencies > 1")


def matrix(events: DataFrame, folds: list[Fold], nodes: DataFrame, hits: DataFrame, declared: list[Feature] | None = None) -> DataFrame:
    """(fold, role, keys, every declared feature): the event-level features once, and each fold's own measures and hits beside them."""
    from paygrove.operators import splits

    rows = splits.assign(features.build(events, declared), folds)
    return attach(rows, sealed(nodes, folds), hits, declared)


def publish(events: DataFrame, folds: list[Fold], nodes: DataFrame, hits: DataFrame, declared: list[Feature] | None = None) -> DataFrame:
    """``matrix``, checked and written in buckets of the entity, so that labels, frames and models meet it without shuffling it.

    Refused where an account moves more than one currency (features add up amounts), where
    a fold's table saw an event after its cutoff, and where a value isn't finite.
    """
    mixed = mixed_currencies(events).limit(1).collect()
    if mixed:
        raise ValueError(f"account {mixed[0].account} moves {mixed[0].currencies} currencies")
    declared = declared or FEATURES
    d = finite(matrix(events, folds, nodes, hits, declared), [f.name for f in declared])
    keys = ["fold", "role", *features.KEYS]
    return bucketed_table(d.select(*keys, *[f.name for f in declared if f.name not in keys]), "entity", "matrix")
