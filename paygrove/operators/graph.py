"""Account graph over canonical events: skeleton, typing, pairs, flows, measures and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators.components import connected_components
from paygrove.operators.ranks import running
from paygrove.session import checkpoint


def legs(events: DataFrame) -> DataFrame:
    """Two rows per event, self-transfers included: account, peer, side."""
    rest = [c for c in events.columns if c not in ("account_from", "account_to")]
    row = lambda a, b, s: F.struct(F.col(a).alias("account"), F.col(b).alias("peer"), F.lit(s).alias("side"))
    d = events.select(*rest, F.inline(F.array(row("account_from", "account_to", "out"), row("account_to", "account_from", "in"))))
    return d.withColumn("is_self", F.col("account") == F.col("peer"))


def links(events: DataFrame) -> DataFrame:
    """Distinct (account, peer, side), self-transfers left out."""
    return legs(events).filter("not is_self").select("account", "peer", "side").distinct()


def nodes(events: DataFrame) -> DataFrame:
    """One row per account: degrees, fan in and out, counterparties, self-transfers, first and last instant.

    One aggregate per grain: links first, so distinct counts are plain counts.
    """
    l = legs(events)
    out, in_, own = (F.col("side") == "out") & ~F.col("is_self"), (F.col("side") == "in") & ~F.col("is_self"), F.col("is_self") & (F.col("side") == "out")
    per = l.groupBy("account", "peer").agg(
        F.count_if(out).alias("o"), F.count_if(in_).alias("i"), F.count_if(own).alias("s"), F.min("ts_us").alias("a"), F.max("ts_us").alias("z"),
        F.max((F.col("side") == "out").cast("int")).alias("sent"),
    )
    return per.groupBy("account").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("total_degree"),
        F.count_if(F.col("i") > 0).alias("fan_in"), F.count_if(F.col("o") > 0).alias("fan_out"),
        F.count_if(F.col("i") + F.col("o") > 0).alias("counterparties"), F.sum("s").alias("self_transfer_count"),
        F.max("sent").cast("boolean").alias("is_originator"), F.min("a").alias("first_ts_us"), F.max("z").alias("last_ts_us"),
    )


def pairs(events: DataFrame) -> DataFrame:
    """Per (from, to, currency): count, total, smallest, largest, first and last event, types, self flag."""
    at = F.struct("ts_us", "txn_id")
    return events.groupBy("account_from", "account_to", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"), F.min("amount_minor").alias("min_minor"),
        F.max("amount_minor").alias("max_minor"), F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us"),
        F.min_by("txn_id", at).alias("first_txn_id"), F.max_by("txn_id", at).alias("last_txn_id"),
        F.array_sort(F.collect_set("txn_type")).alias("txn_types"),
    ).withColumn("is_self", F.col("account_from") == F.col("account_to"))


def undirected_pairs(events: DataFrame) -> DataFrame:
    """(a, b, n) with a < b, both directions merged, self-transfers left out."""
    return events.filter("account_from <> account_to").groupBy(
        F.least("account_from", "account_to").alias("a"), F.greatest("account_from", "account_to").alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))


def self_transfer_totals(events: DataFrame) -> DataFrame:
    return events.filter("account_from = account_to").groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"))


def nearest_rank(df: DataFrame, value: str, q: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, value): the element at index floor(q * n) of the sorted values, capped at the last.

    From counts per distinct value, so ties and large tables cost an aggregate.
    """
    keys = keys or []
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    c = running(c, [F.col(value)], tuple(keys), F.col("n"), "upto")
    every = c.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("n").alias("all"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    c = c.join(every, same)
    at = F.least(F.floor(F.lit(q) * F.col("all")), F.col("all") - 1)
    return c.filter(F.col("upto") > at).groupBy(*keys).agg(F.min(value).alias(value))


def typed(n: DataFrame, rail_q: float = 0.99) -> DataFrame:
    """Nodes with ``node_type``: rail above external above member, and singletons.

    A rail's total degree passes the nearest-rank percentile; an external never
    originates, and its out-degree is null, not 0.
    """
    edge = nearest_rank(n, "total_degree", rail_q).withColumnRenamed("total_degree", "rail_degree")
    d = n.join(F.broadcast(edge))  # one row
    kind = F.when(F.col("total_degree") > F.col("rail_degree"), "rail").when(~F.col("is_originator"), "external").otherwise("member")
    return d.withColumn("node_type", kind).withColumns({
        "is_rail": F.col("node_type") == "rail", "is_external": ~F.col("is_originator"), "is_singleton": F.col("counterparties") == 0,
        "out_degree": F.when(F.col("is_originator"), F.col("out_degree")), "fan_out": F.when(F.col("is_originator"), F.col("fan_out")),
    })


def degree_summary(n: DataFrame) -> DataFrame:
    """n, median, p90, p99 (lower elements) and largest total degree."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY total_degree)")
    return n.agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("total_degree").alias("max"))


def top_degree(n: DataFrame, k: int) -> DataFrame:
    return n.select("account", "total_degree").orderBy(F.desc("total_degree"), "account").limit(k)


def effective_fan(n: DataFrame, l: DataFrame) -> DataFrame:
    """(account, fan_in_effective, fan_out_effective): peers that aren't rails."""
    rails = n.filter("is_rail").select(F.col("account").alias("peer"))
    keep = l.join(rails, "peer", "left_anti")
    e = keep.groupBy("account").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    return n.select("account").join(e, "account", "left").select("account", F.coalesce("i", F.lit(0)).alias("fan_in_effective"), F.coalesce("o", F.lit(0)).alias("fan_out_effective"))


def flows(events: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Value per (account, currency), self-transfers left out; what an external sends is null."""
    e = events.filter("account_from <> account_to")
    if start_us is not None:
        e = e.filter(F.col("ts_us").between(start_us, end_us))
    l, out = legs(e), F.col("side") == "out"
    d = l.groupBy("account", "currency").agg(
        F.sum(F.when(~out, F.col("amount_minor")).otherwise(0)).alias("in_total_minor"), F.count_if(~out).alias("in_count"),
        F.max(F.when(~out, F.col("amount_minor"))).alias("in_max_minor"), F.sum(F.when(out, F.col("amount_minor"))).alias("out_total_minor"),
        F.count_if(out).alias("out_count"), F.max(F.when(out, F.col("amount_minor"))).alias("out_max_minor"),
    )
    return d.withColumn("out_count", F.when(F.col("out_count") > 0, F.col("out_count")))


def local_density(events: DataFrame) -> DataFrame:
    """(account, density_links, density_possible, local_density): links among an account's neighbours.

    Triangles by a wedge join: each undirected edge points from its end of smaller degree
    to the other, so a hub's neighbours aren't paired with each other.
    """
    e = undirected_pairs(events).select("a", "b")
    deg = e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    x = e.join(deg.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    low = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    o = checkpoint(x.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")))
    w = o.alias("x").join(o.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.u").alias("t"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    tri = w.join(e, ["a", "b"])
    per = tri.select(F.explode(F.array("a", "b", "t")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    d = deg.join(per, "v", "left").withColumn("k", F.coalesce("k", F.lit(0))).withColumn("m", F.expr("d * (d - 1) div 2"))
    return d.select(
        F.col("v").alias("account"), F.col("k").alias("density_links"), F.col("m").alias("density_possible"),
        F.when(F.col("m") > 0, F.col("k") / F.col("m")).otherwise(0.0).alias("local_density"),
        F.when(F.col("m") > 0, F.rint(F.col("k") * 10000.0 / F.col("m"))).otherwise(0).cast("long").alias("local_density_bps"),
    )


def components(events: DataFrame) -> DataFrame:
    return connected_components(undirected_pairs(events), "a", "b")


def pagerank(events: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(account, pagerank): parallel events add weight, self-transfers don't count, dangling mass is spread evenly."""
    e = events.filter("account_from <> account_to").groupBy(F.col("account_from").alias("s"), F.col("account_to").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    e = e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("s"))).select("s", "t", "p")
    e = checkpoint(e)
    v = checkpoint(e.select(F.col("s").alias("account")).union(e.select("t")).distinct())
    n = v.count()
    sinks = v.join(e.select(F.col("s").alias("account")).distinct(), "account", "left_anti").withColumn("sink", F.lit(True))
    v = checkpoint(v.join(sinks, "account", "left").select("account", F.coalesce("sink", F.lit(False)).alias("sink")))
    r = v.withColumn("r", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        lost = r.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("r"))), F.lit(0.0))).first()[0]
        got = e.join(r, e["s"] == r["account"]).groupBy("t").agg(F.sum(F.col("p") * F.col("r")).alias("g"))
        new = v.join(got, v["account"] == got["t"], "left").select("account", "sink", (F.lit((1 - alpha + alpha * lost) / n) + alpha * F.coalesce("g", F.lit(0.0))).alias("r"))
        new = checkpoint(new)
        if new.alias("a").join(r.alias("b"), "account").agg(F.sum(F.abs(F.col("a.r") - F.col("b.r")))).first()[0] < n * tolerance:
            r = new
            break
        r = new
    return r.select("account", F.col("r").alias("pagerank"))


def k_core(events: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(account, k_core_number) by peeling; each pass takes off all vertices at or below the current k."""
    e = undirected_pairs(events)
    e = checkpoint(e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")))
    done, k = None, 0
    for _ in range(max_rounds):
        deg = e.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
        low = deg.agg(F.min("d")).first()[0]
        if low is None:
            break
        k = max(k, low)
        gone = checkpoint(deg.filter(F.col("d") <= k).select(F.col("u").alias("account"), F.lit(k).cast("long").alias("k_core_number")))
        done = gone if done is None else done.union(gone)
        out = gone.select("account")
        e = checkpoint(e.join(out.withColumnRenamed("account", "u"), "u", "left_anti").join(out.withColumnRenamed("account", "v"), "v", "left_anti").select("u", "v"))
        # vertices whose last neighbour went in this pass have no edge left; they belong to this core too
        left = deg.select(F.col("u").alias("account")).join(out, "account", "left_anti").join(e.select(F.col("u").alias("account")).distinct(), "account", "left_anti")
        done = checkpoint(done.union(left.select("account", F.lit(k).cast("long"))))
    return done if done is not None else e.select(F.col("u").alias("account"), F.lit(0).cast("long").alias("k_core_number"))


def communities(events: DataFrame, rounds: int = 8) -> DataFrame:
    """(account, community_id, community_size): weighted label propagation, deterministic.

    Every account takes the label with the greatest weight among its neighbours, its own
    counted once, the smaller label on ties. Ids run from 0 by (size descending, smallest
    member), which is the numbering the measures rely on.
    """
    e = undirected_pairs(events)
    e = checkpoint(e.select(F.col("a").alias("u"), F.col("b").alias("v"), "n").union(e.select("b", "a", "n")))
    lab = checkpoint(e.select(F.col("u").alias("account")).distinct().withColumn("label", F.col("account")))
    for _ in range(rounds):
        votes = e.join(lab.select(F.col("account").alias("v"), "label"), "v").select(F.col("u").alias("account"), "label", "n")
        votes = votes.union(lab.select("account", "label", F.lit(1).cast("long"))).groupBy("account", "label").agg(F.sum("n").alias("w"))
        best = votes.groupBy("account").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("account", F.col("b.label").alias("label"))
        best = checkpoint(best)
        moved = best.alias("x").join(lab.alias("y"), "account").filter(F.col("x.label") != F.col("y.label")).limit(1).count()
        lab = best
        if not moved:
            break
    size = lab.groupBy("label").agg(F.count(F.lit(1)).alias("community_size"), F.min("account").alias("low"))
    ids = running(size, [F.desc("community_size"), F.col("low")], name="community_id").withColumn("community_id", F.col("community_id") - 1)
    return lab.join(ids, "label").select("account", "community_id", "community_size")


def betweenness(events: DataFrame, pivots: int = 500, seed: int = 7) -> DataFrame:
    """(account, betweenness_approx): Brandes' dependencies from sampled pivots over directed links.

    Pivots are the accounts with the smallest seeded hashes. The forward pass keeps, per
    (pivot, account), distance and number of shortest paths; the backward pass hands
    dependencies up level by level, along the links by which the level above was left, so
    links of accounts that no pivot reaches are never read. Normalised by (n - 1) * (n - 2), and by n / pivots.
    """
    e = checkpoint(events.filter("account_from <> account_to").select(F.col("account_from").alias("s"), F.col("account_to").alias("t")).distinct())
    v = e.select(F.col("s").alias("account")).union(e.select("t")).distinct()
    n = v.count()
    p = v.orderBy(F.xxhash64(F.lit(seed), "account"), "account").limit(pivots)
    seen = checkpoint(p.select(F.col("account").alias("p"), "account", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    depth = 0
    while True:  # until no frontier is left
        front = seen.filter(F.col("d") == depth)
        nxt = front.join(e, front["account"] == e["s"]).groupBy("p", F.col("t").alias("account")).agg(F.sum("sigma").alias("sigma"))
        nxt = checkpoint(nxt.join(seen.select("p", "account"), ["p", "account"], "left_anti").select("p", "account", F.lit(depth + 1).alias("d"), "sigma"))
        if not nxt.limit(1).count():
            break
        seen = seen.union(nxt)
        depth += 1
    seen = checkpoint(seen)
    delta = None
    for d in range(depth, 0, -1):
        at = seen.filter(F.col("d") == d)
        cur = at.withColumn("delta", F.lit(0.0)) if delta is None else at.join(delta, ["p", "account"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        cur = checkpoint(cur)
        total = cur.select("account", "delta") if d == depth else total.union(cur.select("account", "delta"))
        delta = _handed_up(seen.filter(F.col("d") == d - 1), cur, e).groupBy("p", "account").agg(F.sum("x").alias("delta"))
    scale = n / max(1, min(pivots, n)) / max(1, (n - 1) * (n - 2))
    if depth == 0:
        return v.select("account", F.lit(0.0).alias("betweenness_approx"))
    s = total.groupBy("account").agg((F.sum("delta") * scale).alias("b"))
    return v.join(s, "account", "left").select("account", F.coalesce("b", F.lit(0.0)).alias("betweenness_approx"))


def _handed_up(above: DataFrame, below: DataFrame, e: DataFrame) -> DataFrame:
    """(p, account, x): what each account of the level above gets along each of its links to the level below."""
    up = above.select("p", F.col("account").alias("s"), "sigma").join(e, "s")
    x = below.select("p", F.col("account").alias("t"), ((1 + F.col("delta")) / F.col("sigma")).alias("x"))
    return up.join(x, ["p", "t"]).select("p", F.col("s").alias("account"), (F.col("x") * F.col("sigma")).alias("x"))


def downstream_outflow(events: DataFrame, cutoff_us: int, width_us: int = 86_400_000_000) -> DataFrame:
    """(account, downstream_outflow_24h_minor): what the account and its direct targets sent in the last window."""
    e = events.filter((F.col("account_from") != F.col("account_to")) & (F.col("ts_us") <= cutoff_us))
    out = e.filter(F.col("ts_us") > cutoff_us - width_us).groupBy(F.col("account_from").alias("x")).agg(F.sum("amount_minor").alias("o"))
    hop = e.select(F.col("account_from").alias("account"), F.col("account_to").alias("x")).distinct()
    own = e.select(F.col("account_from").alias("account"), F.col("account_from").alias("x")).distinct()
    return own.union(hop).join(out, "x", "left").groupBy("account").agg(F.coalesce(F.sum("o"), F.lit(0)).alias("downstream_outflow_24h_minor"))


def reachable(events: DataFrame, seeds: DataFrame, hops: int, rails: DataFrame | None = None) -> DataFrame:
    """(seed, account, hop): accounts within ``hops`` steps downstream; rails are reached but not passed."""
    e = events.filter("account_from <> account_to").select(F.col("account_from").alias("s"), F.col("account_to").alias("t")).distinct()
    got = seeds.select(F.col("account").alias("seed"), "account", F.lit(0).alias("hop")).distinct()
    front = got
    for h in range(1, hops + 1):
        go = front if rails is None else front.join(rails.select("account"), "account", "left_anti")
        front = go.join(e, go["account"] == e["s"]).select("seed", F.col("t").alias("account"), F.lit(h).alias("hop")).distinct()
        front = checkpoint(front.join(got.select("seed", "account"), ["seed", "account"], "left_anti").select("seed", "account", "hop"))
        got = got.union(front)
    return got


def ego_network(
    events: DataFrame, seed: str, hops: int, rails: DataFrame, community: DataFrame, cap: int = 1500,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around an account, at most ``cap`` nodes: the largest communities collapse first.

    Neighbours of either direction within ``hops``; rails aren't passed. If there are too
    many, communities other than the seed's turn into one meta node each, largest first,
    until what is left fits; then the first by (hop, account).
    """
    both = events.filter("account_from <> account_to")
    e = both.select(F.col("account_from").alias("s"), F.col("account_to").alias("t"), "amount_minor")
    sym = e.select(F.col("s").alias("account_from"), F.col("t").alias("account_to")).union(e.select("t", "s")).distinct()
    spark = events.sparkSession
    near = reachable(sym, spark.createDataFrame([(seed,)], "account string"), hops, rails).groupBy("account").agg(F.min("hop").alias("hop"))
    near = checkpoint(near.join(community.select("account", "community_id"), "account", "left"))
    own = near.filter(F.col("account") == seed).select(F.col("community_id").alias("own"))
    sizes = near.filter("community_id is not null").join(F.broadcast(own), F.col("community_id") != F.col("own")).groupBy("community_id").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(F.desc("m"), "community_id")
    freed = sizes.withColumn("freed_before", F.coalesce(F.sum(F.col("m") - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = near.agg(F.count(F.lit(1)).alias("total"))
    gone = freed.join(F.broadcast(total)).filter((F.col("total") - F.col("freed_before") > cap) & (F.col("m") > 1)).select("community_id", F.col("m").alias("members"))
    n = near.join(F.broadcast(gone), "community_id", "left").withColumn("node", F.when(F.col("members").isNotNull(), F.concat(F.lit("community:"), "community_id")).otherwise(F.col("account")))
    out = n.groupBy("node").agg(F.min("hop").alias("hop"), F.count(F.lit(1)).alias("members"), F.max(F.col("members").isNotNull()).alias("is_meta"))
    out = out.orderBy("hop", "node").limit(cap)
    name = n.select("account", "node").join(out.select("node"), "node", "left_semi")
    m = e.join(name.select(F.col("account").alias("s"), F.col("node").alias("ns")), "s").join(name.select(F.col("account").alias("t"), F.col("node").alias("nt")), "t")
    edges = m.filter("ns <> nt").groupBy(F.col("ns").alias("source"), F.col("nt").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total_minor"))
    return out, edges


def graph_checks(events: DataFrame) -> DataFrame:
    """Counts that must be 0: nulls, bad currency codes, repeated ids, amounts below 0."""
    ids = events.groupBy("txn_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated_ids"))
    plain = events.agg(
        F.count_if(F.col("account_from").isNull() | F.col("account_to").isNull() | F.col("ts_us").isNull()).alias("nulls"),
        F.count_if(~F.col("currency").rlike("^[A-Z]{3}$")).alias("bad_currency"), F.count_if(F.col("amount_minor") < 0).alias("negative"),
    )
    return plain.join(ids)  # one row each
