import random

import pytest
from pyspark.sql import functions as F

from paygrove.operators import graph, paths, rules
from paygrove.operators.components import connected_components

H = 3_600_000_000


def events(spark, rows):
    """rows: (from, to, hour, amount[, type])"""
    full = [(f"t{i:04d}", int(r[2] * H), r[0], r[1], int(r[3]), r[4] if len(r) > 4 else "view", "UGX") for i, r in enumerate(rows)]
    d = spark.createDataFrame(full, "txn_id string, ts_us long, account_from string, account_to string, amount_minor long, txn_type string, currency string")
    t = F.timestamp_micros("ts_us")
    return d.withColumn("event_date_local", F.to_date(t)).withColumn("local_hour", F.hour(t))


def some(n=60, m=160, seed=1):
    r = random.Random(seed)
    return [(f"a{r.randrange(n)}", f"a{r.randrange(n)}", k, r.randint(1, 999)) for k in range(m)]


def neighbours(rows):
    nb = {}
    for a, b, *_ in rows:
        if a != b:
            nb.setdefault(a, set()).add(b)
            nb.setdefault(b, set()).add(a)
    return nb


def test_k_core(spark):
    rows = some()
    nb, core, k = neighbours(rows), {}, 0
    while nb:
        v = min(nb, key=lambda x: len(nb[x]))
        k = max(k, len(nb[v]))
        core[v] = k
        for w in nb.pop(v):
            nb[w].discard(v)
    assert {r.account: r.k_core_number for r in graph.k_core(events(spark, rows)).collect()} == core


def test_components(spark):
    nb = neighbours(some(90, 60, 4))
    want = {}
    for v in nb:
        seen, todo = {v}, [v]
        while todo:
            for w in nb[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        want[v] = min(seen)
    e = graph.undirected_pairs(events(spark, some(90, 60, 4)))
    assert {r.node: r.component for r in connected_components(e, "a", "b").collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in connected_components(chain, "a", "b").collect()} == {0}


def test_betweenness(spark):
    rows = some(25, 60, 3)
    out = {}
    for a, b, *_ in rows:
        if a != b:
            out.setdefault(a, set()).add(b)
    vs = set(out) | {b for x in out.values() for b in x}
    bc = dict.fromkeys(vs, 0.0)
    for s in vs:
        d, sigma, order, front = {s: 0}, {s: 1.0}, [], [s]
        while front:
            nxt = []
            for v in front:
                order.append(v)
                for w in out.get(v, ()):
                    if w not in d:
                        d[w] = d[v] + 1
                        nxt.append(w)
                    if d[w] == d[v] + 1:
                        sigma[w] = sigma.get(w, 0) + sigma[v]
            front = nxt
        delta = dict.fromkeys(vs, 0.0)
        for v in reversed(order):
            for w in out.get(v, ()):
                if d.get(w) == d[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if v != s:
                bc[v] += delta[v]
    n = len(vs)
    got = {r.account: r.betweenness_approx for r in graph.betweenness(events(spark, rows), pivots=n).collect()}
    assert got == pytest.approx({v: b / ((n - 1) * (n - 2)) for v, b in bc.items()})


def test_betweenness_goes_back_by_links_of_reached_accounts(spark):
    """A hub that hundreds send to: only the links of senders that a pivot reached are read on the way back."""
    e = spark.createDataFrame([(f"s{i}", "hub") for i in range(300)] + [("hub", "end")], "s string, t string")
    above = spark.createDataFrame([("s1", "s1", 1.0)], "p string, account string, sigma double")
    below = spark.createDataFrame([("s1", "hub", 1.0, 1.0)], "p string, account string, sigma double, delta double")
    got = graph._handed_up(above, below, e)
    assert [tuple(r) for r in got.collect()] == [("s1", "s1", 2.0)]
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert joins.index("Join Inner, ((p") < joins.index("Join Inner, (s")  # links meet the reached senders first, innermost
    rows = [(f"s{i}", "hub", i, 5) for i in range(30)] + [("hub", "end", 500, 5)]
    b = {r.account: r.betweenness_approx for r in graph.betweenness(events(spark, rows), pivots=32).collect()}
    assert b["hub"] == pytest.approx(30 / (31 * 30)) and b["end"] == 0


def test_communities_are_numbered_by_size(spark):
    rows = [(f"x{i}", f"x{j}", i, 5) for i in range(5) for j in range(5) if i < j] + [(f"y{i}", f"y{j}", i, 5) for i in range(4) for j in range(4) if i < j]
    c = {r.account: (r.community_id, r.community_size) for r in graph.communities(events(spark, rows)).collect()}
    assert {c[f"x{i}"] for i in range(5)} == {(0, 5)} and {c[f"y{i}"] for i in range(4)} == {(1, 4)}


def test_ego_collapses_the_largest(spark):
    rows = [("s", f"x{i}", 1, 1) for i in range(9)] + [(f"x{i}", f"x{j}", 2, 1) for i in range(9) for j in range(i)] + [("s", "z", 3, 1)]
    e = events(spark, rows)
    com = spark.createDataFrame([(f"x{i}", 0) for i in range(9)] + [("s", 1), ("z", 1)], "account string, community_id long")
    rails = spark.createDataFrame([], "account string")
    n, edges = graph.ego_network(e, "s", 1, rails, com, cap=5)
    assert {r.node for r in n.collect()} == {"s", "z", "community:0"}
    assert {(r.source, r.target) for r in edges.collect()} == {("s", "community:0"), ("s", "z")}


def test_rings(spark):
    rows = [("a", "b", 0, 1000), ("b", "c", 1, 900), ("c", "a", 2, 810), ("p", "q", 0, 1000), ("q", "r", 1, 500), ("r", "p", 2, 490), ("a", "a", 3, 5), ("m", "n", 5, 100), ("n", "o", 4, 100), ("o", "m", 6, 100)]
    c = paths.cycles(paths.adjacency(events(spark, rows))).collect()
    assert [(x.nodes, round(x.retention, 2)) for x in c] == [(["a", "b", "c"], 0.81)]
    hits = rules.run_rules(events(spark, rows), only=("R4",)).collect()
    assert {h.account_key for h in hits} == {"a", "b", "c"}
    assert hits[0].severity == pytest.approx(((0.81 - 0.6) / 0.4 + 0) / 2)


def test_weekly_ring_weighs_less(spark):
    lap = [("a", "b", 0, 1000), ("b", "c", 1, 950), ("c", "a", 2, 930)]
    rows = [(x, y, h + 168 * k, m) for k in range(3) for x, y, h, m in lap]
    s = rules.Settings(r4_hop_us=24 * H)
    one = rules.r4(events(spark, lap), s).first().severity
    assert rules.r4(events(spark, rows), s).first().severity == pytest.approx(0.3 * one)


def test_chain_is_maximal(spark):
    rows = [(f"n{i}", f"n{i + 1}", i * 20, 1000 - i) for i in range(5)] + [("z0", "z1", 0, 5), ("z1", "z2", 30, 5), ("z2", "z3", 31, 4)]
    c = paths.chains(paths.adjacency(events(spark, rows))).collect()
    assert [x.nodes for x in c] == [[f"n{i}" for i in range(6)]]


def test_near_misses(spark):
    """One positive and one near miss of the simpler rules."""
    s = rules.Settings()
    e = events(spark, [("x", "m", 0, 100_000), ("m", "y", 0.9, 92_000), ("x", "k", 0, 100_000), ("k", "y", 1.02, 92_000), ("x", "w", 0, 100_000), ("w", "y", 0.5, 79_000)])
    assert {h.account_key for h in rules.r1(e, s).collect()} == {"m"}
    e = events(spark, [("f", f"p{i}", i, 500) for i in range(9)] + [("g", f"p{i}", i * 4, 500) for i in range(9)])
    r = rules.r3(e, s).collect()
    assert [(h.account_key, h.observation, h.severity) for h in r] == [("f", 9.0, 0.125)]
    t = 2_500_000
    e = events(spark, [("u", "v", k, a) for k, a in enumerate((t, t * 0.9, t * 0.8))] + [("o", "v", k, a) for k, a in enumerate((t, t * 0.9, t * 0.79))])
    assert [(h.account_key, h.observation) for h in rules.r5(e, s).collect()] == [("u", 3.0)]
    e = events(spark, [("i", "c", 0, 100_000), ("c", "j", 5.9, 77_500, "purchase"), ("i", "d", 0, 100_000), ("d", "j", 7, 77_500, "purchase")])
    assert [(h.account_key, h.severity) for h in rules.r10(e, s).collect()] == [("c", pytest.approx(0.25))]


def test_hits_are_merged(spark):
    h = spark.createDataFrame([("R1", "a", 0.2, 1.0, 0, 1, ["t1"], "s"), ("R1", "a", 0.6, 2.0, 5, 6, ["t2"], "s")], "rule_id string, account_key string, severity double, observation double, window_start_us long, window_end_us long, txn_ids array<string>, hit_signature string")
    r = rules.dedupe(h).first()
    assert (r.severity, r.txn_ids, r.windows_observed) == (0.6, ["t1", "t2"], 2)


def test_betweenness_is_registered_whole(spark, monkeypatch):
    from paygrove.plans import q_graph

    seen = {}
    monkeypatch.setattr(q_graph, "pay_events", lambda *a: events(spark, some()))
    monkeypatch.setattr(graph, "betweenness", lambda e, pivots=500, **k: seen.update(pivots=pivots) or spark.createDataFrame([("a", 0.0)], "account string, betweenness_approx double"))
    monkeypatch.setattr(graph, "communities", lambda e: None)
    monkeypatch.setattr(graph, "ego_network", lambda *a, cap=1500, **k: seen.update(cap=cap) or (None, None))
    q_graph.QUERIES["graph_betweenness"](spark, "")
    q_graph.QUERIES["graph_ego"](spark, "")
    assert seen == {"pivots": 500, "cap": 1500}


def test_rings_may_pause(spark):
    e = events(spark, [("a", "b", 0, 1000), ("b", "c", 40, 900), ("c", "a", 24 * 45, 810)])
    assert [x.nodes for x in paths.cycles(paths.adjacency(e)).collect()] == [["a", "b", "c"]]
    assert {h.account_key for h in rules.run_rules(e, only=("R4",)).collect()} == {"a", "b", "c"}


def test_cycles_equal_plain_search(spark):
    """Trimming and half paths against a depth-first search: any pause, ties in time, several legs per pair, a hub."""
    import random

    rng = random.Random(8)
    rows = [(n, rng.randrange(60), rng.choice("abcdefgh"), rng.choice("abcdefgh"), rng.choice([100, 110, 150, 170, 500])) for n in range(170)]
    legs = [(f"t{n}", t, a, b, m, "USD" if n % 9 else "EUR") for n, t, a, b, m in rows if a != b]
    df = spark.createDataFrame(legs, "txn_id string, ts_us long, account_from string, account_to string, amount_minor long, currency string")

    def plain(strict, retention, low, high):
        found = set()

        def go(path, nodes):
            for leg in legs:
                later = leg[1] > path[-1][1] if strict else leg[1] >= path[-1][1] and leg not in path
                if leg[2] != path[-1][3] or leg[5] != path[0][5] or not later:
                    continue
                amounts = [x[4] for x in path] + [leg[4]]
                if min(amounts) * 1_000_000 < max(amounts) * retention:
                    continue
                if leg[3] == nodes[0]:
                    if low <= len(amounts) <= high:
                        found.add(tuple(x[0] for x in [*path, leg]))
                elif leg[3] not in nodes and len(amounts) < high:
                    go([*path, leg], [*nodes, leg[3]])

        for leg in legs:
            go([leg], [leg[2], leg[3]])
        return found

    for strict, retention, low, high in ((True, 600_000, 3, 5), (False, 600_000, 3, 4), (True, 950_000, 3, 6)):
        got = [tuple(r.txns) for r in paths.cycles(df, low, high, retention, strict=strict).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(strict, retention, low, high)
    assert paths.cycles(df.limit(0)).count() == 0


def test_trimming_empties_a_tree(spark):
    """Legs that cannot close go, round by round; a ring and what it needs stay."""
    chain = [(f"c{k}", k, f"n{k}", f"n{k + 1}", 100, "USD") for k in range(12)]
    ring = [("r0", 5, "x", "y", 100, "USD"), ("r1", 6, "y", "z", 90, "USD"), ("r2", 900, "z", "x", 80, "USD"), ("far", 7, "z", "x", 5000, "USD")]
    df = spark.createDataFrame(chain + ring, "txn_id string, ts_us long, account_from string, account_to string, amount_minor long, currency string")
    assert sorted(r.txn_id for r in paths.trimmed(df).collect()) == ["r0", "r1", "r2"]
    assert [r.txns for r in paths.cycles(df).collect()] == [["r0", "r1", "r2"]]
