"""The what-if against a plain version, and requests that are refused."""

import random

import pytest

from paygrove.operators import pricing, simulate

A = pricing.Assumptions(minor_per_minute=1_000, cost_per_minute_minor=10, friction_minor=50)


def plain(rows, r, key):
    """First fit in the order of ``key``; (account, ev) taken."""
    a, left, out, cands = r.assumptions, r.capacity, [], []
    for k, score, sev, paid, cur in rows:
        x, p = paid or 0, round(score * 1e6)
        half = lambda v, n: (2 * v * n + 10**6) // (2 * 10**6)
        m = max(a.minutes[0], min(a.minutes[1], x // a.minor_per_minute))
        got, fr = half(x, half(p, r.recovery_micro or a.recovery_micro)), half(a.friction_minor, 10**6 - p)
        ev = got - m * a.cost_per_minute_minor - fr
        if cur == a.currency and ev > 0:
            cands.append({"k": k, "ev": ev, "m": m, "score": score, "sev": sev, "x": x})
    for c in sorted(cands, key=lambda c: (key(c), c["k"])):
        if c["m"] <= left:
            left -= c["m"]
            out.append(c)
    return out, sum(c["ev"] for c in cands), len(cands)


def test_equals_plain(spark):
    rng = random.Random(2)
    rows = [(f"a{n:03d}", rng.randrange(1000) / 1000, rng.random(), rng.choice([None, rng.randrange(200_000)]), rng.choice(["USD", "USD", "EUR"])) for n in range(300)]
    d = spark.createDataFrame(rows, "account_key string, score double, rule_severity double, outflow_minor long, currency string")
    before, after = simulate.Request(400, A), simulate.Request(600, pricing.Assumptions(minutes=(40, 45), minor_per_minute=2_000, cost_per_minute_minor=30, friction_minor=500), 150_000)
    changes, view = simulate.simulate(d, before, after)
    dense = lambda c: -c["ev"] / c["m"]
    (a, _, _), (b, reach, n) = plain(rows, before, dense), plain(rows, after, dense)
    was, now = {c["k"]: c["ev"] for c in a}, {c["k"]: c["ev"] for c in b}
    want = {k: ("kept" if k in was and k in now else "left" if k in was else "entered", was.get(k), now.get(k)) for k in was | now}
    got = {r.account_key: (r.change, r.ev_before_minor, r.ev_after_minor) for r in changes.collect()}
    assert got == want and {v[0] for v in want.values()} == {"kept", "left", "entered"}
    of = {r.policy: r for r in view.collect()}
    for policy, key in (("threshold", lambda c: -c["score"]), ("rules_only", lambda c: -c["sev"]), ("highest_amount", lambda c: -c["x"]), ("ev_greedy", dense)):
        t, _, _ = plain(rows, after, key)
        ev = sum(c["ev"] for c in t)
        r = of[policy]
        assert (r.accounts, r.minutes, r.ev_minor, r.forgone_minor, r.behind_minor, r.candidates) == (len(t), sum(c["m"] for c in t), ev, reach - ev, sum(now.values()) - ev, n)
    assert of["random"].unpriced == sum(r[4] == "EUR" for r in rows)


def test_empty_and_refused(spark):
    d = spark.createDataFrame([], "account_key string, score double, rule_severity double, outflow_minor long, currency string")
    changes, view = simulate.simulate(d, simulate.Request(10, A), simulate.Request(20, A))
    assert changes.count() == 0 and {(r.accounts, r.candidates, r.forgone_minor, r.behind_minor) for r in view.collect()} == {(0, 0, 0, 0)} and view.count() == 5
    for bad in (simulate.Request(-1, A), simulate.Request(10, A, 123)):
        with pytest.raises(simulate.RequestError):
            simulate.simulate(d, simulate.Request(10, A), bad)
