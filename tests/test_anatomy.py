"""Ring anatomy against plain code, and against the search it explains."""

from paygrove.operators import anatomy, paths
from paygrove.plans.q_anatomy import attempts
from paygrove.plans.tables import pay_events

SF = "/root/testdata/sf0.001"
SCHEMA = "attempt string, step int, account_from string, account_to string, ts_us long, amount_minor long, currency string, txn_type string"


def ring(name, nodes, ts, amounts, currency="UGX", kind="pay"):
    cs = currency if isinstance(currency, list) else [currency] * len(nodes)
    return [(name, k, n, nodes[(k + 1) % len(nodes)], t, a, c, kind) for k, (n, t, a, c) in enumerate(zip(nodes, ts, amounts, cs, strict=True))]


def test_each_setting_is_named(spark):
    rows = [
        *ring("good", "abc", [1, 2, 3], [100, 90, 80]), *ring("two", "ab", [1, 2], [100, 90]), *ring("long", "abcdefg", range(1, 8), [100] * 7),
        *ring("same", "abc", [1, 1, 3], [100, 90, 80]), *ring("zero", "abc", [1, 2, 3], [0, 0, 0]), *ring("low", "abc", [1, 2, 3], [100, 90, 59]),
        *ring("edge", "abc", [1, 2, 3], [100, 90, 60]), *ring("both", "abc", [3, 2, 1], [59, 90, 100], ["UGX", "KES", "UGX"]), *ring("error", "abc", [1, 2, 3], [100, 90, 80], kind="error"),
        *ring("null", "abc", [1, None, 3], [100, 90, 80]), *ring("open", "abcd", [1, 2, 3, 4], [100, 90, 80, 80])[:3], *ring("eight", "abac", [1, 2, 3, 4], [9, 9, 9, 9]),
    ]
    m = anatomy.measured(spark.createDataFrame(rows, SCHEMA))
    got = {r.attempt: r.reasons for r in anatomy.reasons(m, non_increasing=True).collect()}
    assert got == {
        "good": [], "edge": [], "two": ["length_below_min"], "long": ["length_above_max"], "same": ["time_reversal"], "zero": ["zero_value"], "low": ["retention_floor"],
        "both": ["time_reversal", "retention_floor", "cross_currency", "amount_increases"], "error": ["reversal_leg"], "null": ["incomplete"], "open": ["not_closed"], "eight": ["account_repeats"],
    }
    loose = {r.attempt: r.reasons for r in anatomy.reasons(m, strict=False, same_currency=False).collect()}
    assert loose["same"] == [] and loose["both"] == ["time_reversal", "retention_floor"]
    counts = {r.reason: (r.rings, r.alone) for r in anatomy.anatomy(anatomy.reasons(m, non_increasing=True)).collect()}
    assert counts["found"] == (2, 2) and counts["retention_floor"] == (2, 1) and counts["length_above_max"] == (1, 1) and len(counts) == 12


def test_empty(spark):
    r = anatomy.anatomy(anatomy.reasons(anatomy.measured(spark.createDataFrame([], SCHEMA)))).collect()
    assert len(r) == 12 and {x.rings for x in r} == {0}


def test_rings_without_a_reason_are_those_the_search_finds(spark):
    """An annotated ring has no reason exactly when the search over all payments returns its legs in its order."""
    from pyspark.sql import functions as F

    e = pay_events(spark, SF)
    rows = attempts(spark, SF).withColumn("currency", F.lit("UGX"))
    got = {r.attempt for r in anatomy.reasons(anatomy.measured(rows)).filter("size(reasons) = 0").collect()}
    found = {"-".join(t.split(":")[1] for t in r.txns) for r in paths.cycles(paths.adjacency(e), 3, 3).collect()}
    asked = {r.attempt for r in rows.select("attempt").distinct().collect()}
    assert got == asked & found and asked - got
