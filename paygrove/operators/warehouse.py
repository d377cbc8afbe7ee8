"""Landing tables and read-model queries: ranked, filtered, paged and compared results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators.ranks import running


def accounts(events: DataFrame) -> DataFrame:
    """Per account: counts, counterparties, funding, first and last instant, age in days, modal currency."""
    side = lambda a, b, s: F.struct(F.col(a).alias("account"), F.col(b).alias("peer"), F.lit(s).alias("side"))
    l = events.select("ts_us", "amount_minor", "currency", F.inline(F.array(side("account_from", "account_to", "out"), side("account_to", "account_from", "in"))))
    per = l.groupBy("account", "peer", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("side") == "in", F.col("amount_minor")).otherwise(0)).alias("i"), F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    cur = per.groupBy("account", "currency").agg(F.sum("n").alias("n")).groupBy("account").agg(F.min_by("currency", F.struct((-F.col("n")).alias("m"), "currency")).alias("currency"))
    d = per.groupBy("account").agg(F.sum("n").alias("rows"), F.count_distinct(F.when(F.col("peer") != F.col("account"), F.col("peer"))).alias("counterparties"), F.sum("i").alias("funding_minor"), F.min("a").alias("first_ts_us"), F.max("z").alias("last_ts_us"))
    return d.withColumn("age_days", F.call_function("div", F.col("last_ts_us") - F.col("first_ts_us"), F.lit(86_400_000_000))).join(cur, "account")


def current_scores(scored: DataFrame, keys: list[str] = ("account_key",)) -> DataFrame:
    """The latest fold's latest row of each account, test role only."""
    w = Window.partitionBy(*keys).orderBy(F.desc("fold"), F.desc("ts_us"), "txn_id")
    return scored.filter("role = 'test'").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def hits_long(wide: DataFrame, severities: list[str], key: str = "account_key") -> DataFrame:
    """(key, rule_id, severity) from one column per rule."""
    return wide.unpivot([key], severities, "rule_id", "severity").filter("severity is not null")


def append_only(new: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys haven't landed yet; null keys match null keys."""
    on = F.lit(True)
    old = landed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return new.join(old, on, "left_anti")


def select(df: DataFrame, equal: dict | None = None, among: dict | None = None, above: dict | None = None, order: list | None = None, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, count): equality, IN and greater-than filters, an order with its tie-break, a page."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    for c, vs in (among or {}).items():
        df = df.filter(F.col(c).isin(*vs))
    for c, v in (above or {}).items():
        df = df.filter(F.col(c) > v)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    page = df.orderBy(*order) if order else df
    page = page.offset(offset) if offset else page
    return (page if limit is None else page.limit(limit)), n


SORTS = ("rank", "score", "ev_minor", "density", "exposure_minor", "minutes", "account_key", "band", "typology", "rule_hits")


def queue_page(
    scores: DataFrame, economics: DataFrame, allocation: DataFrame, cases: DataFrame, band: str | None = None, typology: str | None = None, rule: str | None = None, selected: bool | None = None,
    status: str | None = None, least_score: float | None = None, least_ev: int | None = None, text: str | None = None, sort: str = "rank", descending: bool = False, limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the alert queue: scores with economics, allocation and case, eight filters, ten sorts, nulls last."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort}")
    d = scores.join(economics, "account_key", "left").join(allocation, "account_key", "left").join(cases, "account_key", "left")
    keep = [
        F.col("band") == band if band else None, F.col("typology") == typology if typology else None, F.array_contains("rule_ids", rule) if rule else None,
        F.coalesce("selected", F.lit(False)) == selected if selected is not None else None, F.coalesce("status", F.lit("new")) == status if status else None,
        F.col("score") >= least_score if least_score is not None else None, F.col("ev_minor") >= least_ev if least_ev is not None else None, F.col("account_key").contains(text) if text else None,
    ]
    for k in keep:
        d = d if k is None else d.filter(k)
    by = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return d.orderBy(by, "account_key").offset(offset).limit(limit), d.agg(F.count(F.lit(1)).alias("total"))


def facets(scores: DataFrame) -> DataFrame:
    """(facet, value, n): accounts by band, by typology and by rule, from one pass."""
    each = F.concat(
        F.array(F.struct(F.lit("band").alias("facet"), F.col("band").alias("value")), F.struct(F.lit("typology").alias("facet"), F.col("typology").alias("value"))),
        F.transform("rule_ids", lambda r: F.struct(F.lit("rule").alias("facet"), r.alias("value"))))
    return scores.select(F.inline(each)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def stored_ranking(priced: DataFrame, taken: DataFrame) -> DataFrame:
    """Rank by (density, account) of every priced account, whether first fit took it, and whether it lies beyond the last taken rank."""
    d = running(priced.filter("ev_minor is not null"), [F.desc("density"), F.col("account_key")], name="rank")
    d = d.join(taken.select("account_key").distinct().withColumn("selected", F.lit(True)), "account_key", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    cut = d.agg(F.coalesce(F.max(F.when(F.col("selected"), F.col("rank"))), F.lit(0)).alias("cutoff_rank"))
    return d.join(F.broadcast(cut)).withColumn("beyond_capacity", F.col("rank") > F.col("cutoff_rank"))  # one row


def what_if(before: DataFrame, after: DataFrame) -> DataFrame:
    """(account_key, change): which accounts a new policy lets in and which fall out."""
    a, b = before.select("account_key", F.lit(True).alias("was")), after.select("account_key", F.lit(True).alias("now"))
    d = a.join(b, "account_key", "full_outer")
    return d.select("account_key", F.when(F.col("was").isNull(), "entered").when(F.col("now").isNull(), "left").otherwise("kept").alias("change"))


def risky_communities(membership: DataFrame, scores: DataFrame, risky: tuple[str, ...] = ("D", "E")) -> DataFrame:
    return membership.join(scores.filter(F.col("band").isin(*risky)).select(F.col("account_key").alias("account")), "account", "left_semi").agg(F.count_distinct("community_id").alias("communities"))


def timeline(events: DataFrame, hits: DataFrame, account: str) -> DataFrame:
    """Evidence of one case in order: its transactions and its rule hits."""
    t = events.filter((F.col("account_from") == account) | (F.col("account_to") == account)).select("ts_us", F.lit("transaction").alias("kind"), F.col("txn_type").alias("label"), F.col("txn_id").alias("detail"))
    h = hits.filter(F.col("account_key") == account).select(F.col("window_start_us").alias("ts_us"), F.lit("rule").alias("kind"), F.col("rule_id").alias("label"), F.concat_ws(",", "txn_ids").alias("detail"))
    return t.unionByName(h).orderBy("ts_us", "kind", "detail")


def counterfactuals(points: DataFrame, bins: DataFrame, bands: DataFrame) -> DataFrame:
    """Per account the cheapest change of one feature's bin that moves it to another band.

    ``points`` (account_key, feature, points, score, band), ``bins`` (feature, label,
    points), ``bands`` (band, low, high): the tables of bins and bands are the card's.
    """
    d = points.join(F.broadcast(bins.select("feature", F.col("label").alias("to_label"), F.col("points").alias("to_points"))), "feature")
    d = d.filter("to_points <> points").withColumn("new_score", F.col("score") - F.col("points") + F.col("to_points"))
    d = d.join(F.broadcast(bands.select(F.col("band").alias("new_band"), "low", "high")), (F.col("new_score") >= F.col("low")) & (F.col("new_score") < F.col("high"))).filter("new_band <> band")
    best = F.min(F.struct(F.abs(F.col("to_points") - F.col("points")).alias("change"), "feature", "to_label", "new_band", "new_score"))
    return d.groupBy("account_key", "band").agg(best.alias("b")).select("account_key", "band", "b.*")


def runs(ledger: DataFrame) -> DataFrame:
    """Runs with the one that supersedes each: the next complete one of the same dataset."""
    w = Window.partitionBy("dataset").orderBy("started_us", "run_id")
    done = ledger.filter("state = 'complete'").withColumn("superseded_by", F.lead("run_id").over(w)).withColumn("is_latest", F.col("superseded_by").isNull())
    return ledger.join(done.select("run_id", "superseded_by", "is_latest"), "run_id", "left").withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


def stage_state(ledger: DataFrame) -> DataFrame:
    """Per run and stage the latest state, its rows and the seconds since the stage began."""
    at = F.struct("at_us", "state")
    return ledger.groupBy("run_id", "stage").agg(F.max_by("state", at).alias("state"), F.max_by("rows", at).alias("rows"), ((F.max("at_us") - F.min("at_us")) / 1e6).alias("seconds"))


def masked(col: Column) -> Column:
    """An account key as a page shows it."""
    return F.concat(F.substring(col, 1, 4), F.lit("…"))


def band_definitions(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(band, accounts, positives, low, high, rate): what each band of a scored run holds."""
    return scored.groupBy("band").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum(label).alias("positives"), F.min(score).alias("low"), F.max(score).alias("high"), F.avg(label).alias("rate"))


def points_long(scored: DataFrame, features: list[str], base: int, key: str = "account_key") -> DataFrame:
    """(key, feature, points): a card's points per account, the base as a feature of its own."""
    each = F.array(F.struct(F.lit("(base)").alias("feature"), F.lit(base).cast("long").alias("points")), *[F.struct(F.lit(f).alias("feature"), F.col(f"points_{f}").cast("long").alias("points")) for f in features])
    return scored.select(key, F.inline(each))


def graph_rows(nodes: DataFrame, pairs: DataFrame, communities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(communities, memberships, edges) of a run, ready to land: communities numbered from 0 by size and smallest account."""
    m = communities.select("account", "community_id")
    c = communities.groupBy("community_id").agg(F.count(F.lit(1)).alias("members"), F.min("account").alias("smallest_account"))
    members = nodes.join(m, "account", "left")
    to = m.select(F.col("account").alias("account_to"), F.col("community_id").alias("to_community"))
    e = pairs.filter("not is_self").join(m.select(F.col("account").alias("account_from"), F.col("community_id").alias("from_community")), "account_from", "left").join(to, "account_to", "left")
    return c, members, e.withColumn("crosses", ~F.col("from_community").eqNullSafe(F.col("to_community")))


def expand(communities: DataFrame, community: int) -> DataFrame:
    """Accounts of one collapsed community."""
    return communities.filter(F.col("community_id") == community).select("account")


def dashboard(scored: DataFrame, taken: DataFrame, hits: DataFrame, latest: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, bands, patterns) of a run: what is reviewed and saved, accounts per band, the latest hits."""
    done = taken.agg(F.count(F.lit(1)).alias("reviewed"), F.coalesce(F.sum("ev_minor"), F.lit(0)).alias("ev_minor"), F.coalesce(F.sum("intercept_minor"), F.lit(0)).alias("loss_avoided_minor"), F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes"))
    every = scored.agg(F.count(F.lit(1)).alias("accounts"), F.coalesce(F.sum("exposure_minor"), F.lit(0)).alias("exposure_minor"))
    bands = scored.groupBy("band").agg(F.count(F.lit(1)).alias("accounts"), F.sum("exposure_minor").alias("exposure_minor"))
    last = hits.select("rule_id", "account_key", "severity", "window_end_us").orderBy(F.desc("window_end_us"), "rule_id", "account_key").limit(latest)
    return every.join(done), bands, last  # one row each


def packet(account: str, scored: DataFrame, hits: DataFrame, events: DataFrame, nodes: DataFrame, at_us: int) -> DataFrame:
    """(section, name, value): all evidence on one case as of an instant; nothing later enters."""
    text = lambda d, section, names: d.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])))
    e = events.filter(F.col("ts_us") <= at_us)
    own = e.filter((F.col("account_from") == account) | (F.col("account_to") == account))
    money = own.agg(F.count(F.lit(1)).alias("transactions"), F.sum(F.when(F.col("account_from") == account, F.col("amount_minor"))).alias("sent_minor"), F.sum(F.when(F.col("account_to") == account, F.col("amount_minor"))).alias("received_minor"), F.max("ts_us").alias("last_ts_us"))
    h = hits.filter((F.col("account_key") == account) & (F.col("window_end_us") <= at_us)).select(F.lit("rule").alias("section"), F.col("rule_id").alias("name"), F.round("severity", 9).cast("string").alias("value"))
    graph = nodes.filter(F.col("account") == account)
    s = scored.filter(F.col("account_key") == account)
    return text(money, "money", ["transactions", "sent_minor", "received_minor", "last_ts_us"]).unionByName(h).unionByName(
        text(graph, "graph", ["total_degree", "counterparties", "node_type"])).unionByName(text(s, "score", ["band"]))


def validation_view(metrics: DataFrame, ablation: DataFrame, fairness: DataFrame) -> DataFrame:
    """(panel, item, measure, value): what a validation page shows, one long table."""
    def long(d: DataFrame, panel: str, item: str, measures: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return d.select(F.lit(panel).alias("panel"), F.col(item).cast("string").alias("item"), F.inline(each))

    return long(metrics, "metrics", "typology", ["average_precision", "auroc", "brier", "ks"]).unionByName(
        long(ablation, "ablation", "configuration", ["average_precision", "auroc"])).unionByName(long(fairness, "fairness", "bucket", ["negatives", "false_positive_rate"]))
