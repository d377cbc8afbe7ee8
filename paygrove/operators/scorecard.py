"""Scorecard: binning, weight of evidence, selection, points, bands, reasons and drift."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Bin:
    """Rows with lo <= x < hi (either end open), or a special label."""

    feature: str
    label: str
    n: int
    bad: int
    lo: float | None = None
    hi: float | None = None
    woe: float = 0.0
    points: int = 0
    values: tuple[str, ...] = field(default=())


def woe_iv(bins: list[Bin], laplace: float = 0.5) -> float:
    """Fills in each bin's smoothed weight of evidence; returns the information value."""
    good, bad, k = sum(b.n - b.bad for b in bins), sum(b.bad for b in bins), len(bins)
    iv = 0.0
    for b in bins:
        g, x = (b.n - b.bad + laplace) / (good + laplace * k), (b.bad + laplace) / (bad + laplace * k)
        b.woe = math.log(g / x)
        iv += (g - x) * b.woe
    return iv


def _merge(a: Bin, b: Bin) -> Bin:
    hi = "inf" if b.hi is None else f"{b.hi:.6g}"
    lo = "-inf" if a.lo is None else f"{a.lo:.6g}"
    return Bin(a.feature, f"[{lo}, {hi})", a.n + b.n, a.bad + b.bad, a.lo, b.hi)


def bin_numeric(df: DataFrame, feature: str, label: str = "label", prebins: int = 20, floor: float = 0.05) -> list[Bin]:
    """Bins of one numeric feature: missing and zero apart, the rest monotone in bad rate.

    Quantile edges and one count per pre-bin come from Spark; what is merged on the driver
    is that table of at most ``prebins`` rows: neighbours that break the direction of the
    overall trend are pooled, then bins under the floor go to their nearer neighbour.
    """
    x = F.col(feature).cast("double")
    rest = df.filter(x.isNotNull() & (x != 0))
    edges = sorted(set(rest.agg(F.percentile_approx(x, [k / prebins for k in range(1, prebins)], 10_000).alias("q")).first().q or []))
    place = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    b = F.when(x.isNull(), -2).when(x == 0, -1).otherwise(place)
    got = {r.b: (r.n, r.bad) for r in df.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("bad")).collect()}
    total = sum(n for n, _ in got.values())
    runs = []
    for k in sorted(k for k in got if k >= 0):
        lo, hi = (edges[k - 1] if k else None), (edges[k] if k < len(edges) else None)
        runs.append(Bin(feature, f"[{'-inf' if lo is None else f'{lo:.6g}'}, {'inf' if hi is None else f'{hi:.6g}'})", *got[k], lo, hi))
    rate = lambda z: z.bad / z.n
    if len(runs) > 2:
        mid, m = sum(i * z.n for i, z in enumerate(runs)) / sum(z.n for z in runs), sum(z.bad for z in runs) / sum(z.n for z in runs)
        up = sum(z.n * (i - mid) * (rate(z) - m) for i, z in enumerate(runs)) >= 0
        pooled: list[Bin] = []
        for z in runs:
            pooled.append(z)
            while len(pooled) > 1 and ((rate(pooled[-1]) < rate(pooled[-2])) if up else (rate(pooled[-1]) > rate(pooled[-2]))):
                last = pooled.pop()
                pooled[-1] = _merge(pooled[-1], last)
        runs = pooled
    while len(runs) > 1 and min(z.n for z in runs) < floor * total:
        i = min(range(len(runs)), key=lambda j: runs[j].n)
        j = i - 1 if i and (i == len(runs) - 1 or abs(rate(runs[i - 1]) - rate(runs[i])) <= abs(rate(runs[i + 1]) - rate(runs[i]))) else i
        runs[j : j + 2] = [_merge(runs[j], runs[j + 1])]
    special = [Bin(feature, name, *got[k]) for k, name in ((-2, "missing"), (-1, "zero")) if k in got]
    out = special + runs
    woe_iv(out)
    return out


def bin_categorical(df: DataFrame, feature: str, label: str = "label", groups: int = 5, floor: float = 0.02) -> list[Bin]:
    """Categories ordered by bad rate, in groups; the rarest form the bin of unseen values."""
    rows = df.filter(F.col(feature).isNotNull()).groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("bad"))
    total = df.count()
    big = rows.filter(F.col("n") >= floor * total).orderBy(F.col("bad") / F.col("n"), feature).limit(1000).collect()
    small = rows.filter(F.col("n") < floor * total).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    size = -(-len(big) // groups) if big else 1
    out = []
    for k in range(0, len(big), size):
        part = big[k : k + size]
        out.append(Bin(feature, f"group{k // size}", sum(r.n for r in part), sum(r.bad for r in part), values=tuple(str(r[feature]) for r in part)))
    none = df.filter(F.col(feature).isNull()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("bad")).first()
    if small.n or not out:
        out.append(Bin(feature, "unseen", small.n, small.bad))
    if none.n:
        out.append(Bin(feature, "missing", none.n, none.bad))
    woe_iv(out)
    return out


def assign(feature: str, bins: list[Bin], value: str = "label") -> Column:
    """The bin's label, weight or points, as one expression."""
    x = F.col(feature)
    out = F.lit(None)
    fall = next((b for b in bins if b.label == "unseen"), None)
    if fall is not None:
        out = F.lit(getattr(fall, value))
    for b in bins:
        v = F.lit(getattr(b, value))
        if b.label == "missing":
            out = F.when(x.isNull(), v).otherwise(out)
        elif b.label == "zero":
            out = F.when(x == 0, v).otherwise(out)
        elif b.values:
            out = F.when(x.cast("string").isin(*b.values), v).otherwise(out)
        elif b.label != "unseen":
            ok = x.isNotNull() & (x != 0 if any(z.label == "zero" for z in bins) else F.lit(True))
            if b.lo is not None:
                ok = ok & (x >= b.lo)
            if b.hi is not None:
                ok = ok & (x < b.hi)
            out = F.when(ok, v).otherwise(out)
    return out


def bin_table(df: DataFrame, feature: str, edges: list[float], label: str = "label", laplace: float = 0.5) -> DataFrame:
    """(bin, n, bad, woe, iv_part) of fixed edges, all in Spark: for monitoring and checks."""
    x = F.col(feature).cast("double")
    b = F.when(x.isNull(), "missing").when(x == 0, "zero").otherwise(F.concat(F.lit("b"), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string")))
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("bad"))
    w = Window.partitionBy()
    k = F.count(F.lit(1)).over(w)
    good = (F.col("n") - F.col("bad") + laplace) / (F.sum(F.col("n") - F.col("bad")).over(w) + laplace * k)
    bad = (F.col("bad") + laplace) / (F.sum("bad").over(w) + laplace * k)
    return g.withColumn("woe", F.log(good / bad)).withColumn("iv_part", (good - bad) * F.log(good / bad))


def admit(iv: float, correlation: float, low: float = 0.02, high: float = 0.5, ceiling: float = 0.9) -> tuple[bool, str]:
    """Whether a feature enters the card, and why."""
    if iv < low:
        return False, f"information value {iv:.4f} under {low}"
    if iv > high:
        return False, f"information value {iv:.4f} over {high}: separates too well to be trusted"
    if abs(correlation) > ceiling:
        return False, f"correlation with the label {correlation:.3f} over {ceiling}"
    return True, f"information value {iv:.4f} within [{low}, {high}]"


@dataclass
class Card:
    """Fitted card: bins with points per feature, and the base."""

    bins: dict[str, list[Bin]]
    betas: dict[str, float]
    intercept: float
    base: int


def fit(df: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "label", strength: float = 1.0, pdo: float = 20, at: float = 600, odds: float = 50) -> Card:
    """Binning, an L2 logistic regression on weights of evidence, and integer points."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    bins = {f: bin_numeric(df, f, label) for f in numeric} | {f: bin_categorical(df, f, label) for f in categorical}
    feats = list(bins)
    n = max(1, df.count())
    w = df.select(F.col(label).cast("double").alias("y"), *[F.coalesce(assign(f, bins[f], "woe").cast("double"), F.lit(0.0)).alias(f"w_{f}") for f in feats])
    x = VectorAssembler(inputCols=[f"w_{f}" for f in feats], outputCol="x").transform(w)
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=strength / n, elasticNetParam=0.0, standardization=False, maxIter=100).fit(x)
    betas = dict(zip(feats, map(float, m.coefficients), strict=True))
    factor = pdo / math.log(2)
    offset = at - factor * math.log(odds)
    for f in feats:
        for b in bins[f]:
            b.points = round(-factor * betas[f] * b.woe)
    return Card(bins, betas, float(m.intercept), round(offset - factor * float(m.intercept)))


def score(df: DataFrame, card: Card) -> DataFrame:
    """``df`` with points per feature and their sum with the base."""
    pts = {f"points_{f}": F.coalesce(assign(f, b, "points").cast("long"), F.lit(0)) for f, b in card.bins.items()}
    d = df.withColumns(pts)
    return d.withColumn("card_score", F.lit(card.base) + sum((F.col(p) for p in pts), F.lit(0)))


def identity_breaks(scored: DataFrame, card: Card) -> DataFrame:
    """Rows whose score isn't the base plus its points: none."""
    return scored.filter(F.col("card_score") != F.lit(card.base) + sum((F.col(f"points_{f}") for f in card.bins), F.lit(0)))


def bands(scored: DataFrame, label: str = "label", col: str = "card_score", cuts: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """Per distinct score a band A (best) to E by smoothed bad rate over the base rate.

    Isotonic regression over distinct scores (weighted) makes the rate fall with the
    score, so bands can't invert.
    """
    from pyspark.ml.regression import IsotonicRegression

    g = scored.groupBy(F.col(col).cast("double").alias("s")).agg(F.avg(label).alias("rate"), F.count(F.lit(1)).cast("double").alias("w"))
    m = IsotonicRegression(featuresCol="s", labelCol="rate", weightCol="w", isotonic=False, predictionCol="smooth").fit(g)
    base = scored.agg(F.avg(label).alias("base"))
    d = m.transform(g).join(base)  # one row
    x = F.when(F.col("base") > 0, F.col("smooth") / F.col("base")).otherwise(0.0)
    band = F.when(x < cuts[0], "A").when(x < cuts[1], "B").when(x < cuts[2], "C").when(x < cuts[3], "D").otherwise("E")
    return d.select(F.col("s").alias(col), F.col("w").cast("long").alias("n"), "rate", "smooth", band.alias("band"))


def reasons(scored: DataFrame, features: list[str], key: str = "account_key", top: int = 3) -> DataFrame:
    """(key, reasons): the features with the fewest points, as text."""
    each = F.array(*[F.struct(F.col(f"points_{f}").alias("p"), F.lit(f).alias("f")) for f in features])
    low = F.slice(F.array_sort(F.filter(each, lambda x: x["p"] < 0)), 1, top)
    return scored.select(key, F.transform(low, lambda x: F.format_string("%s costs %d points", x["f"], -x["p"])).alias("reasons"))


def psi(expected: DataFrame, actual: DataFrame, keys: list[str], bin_col: str = "bin", floor: float = 1e-4) -> DataFrame:
    """(keys, bin, expected, actual, csi): stability per bin; its sum over bins is the index."""
    share = lambda d, name: d.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")
    j = share(expected, "expected").join(share(actual, "actual"), [*keys, bin_col], "full_outer")
    e, a = F.greatest(F.coalesce("expected", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("actual", F.lit(0.0)), F.lit(floor))
    return j.select(*keys, bin_col, e.alias("expected"), a.alias("actual"), ((a - e) * F.log(a / e)).alias("csi"))


def drift_state(index: Column, watch: float = 0.1, action: float = 0.25) -> Column:
    return F.when(index >= action, "action").when(index >= watch, "watch").otherwise("stable")


def migration(scored: DataFrame, key: str = "account_key", fold: str = "fold", band: str = "band") -> DataFrame:
    """(fold, from, to, n): bands of an account in consecutive folds."""
    a, b = scored.select(key, (F.col(fold) + 1).alias(fold), F.col(band).alias("from_band")), scored.select(key, fold, F.col(band).alias("to_band"))
    return a.join(b, [key, fold]).groupBy(fold, "from_band", "to_band").agg(F.count(F.lit(1)).alias("n"))


def migration_rates(m: DataFrame, fold: str = "fold") -> DataFrame:
    return m.groupBy(fold).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("to_band") > F.col("from_band"), F.col("n")).otherwise(0)) / F.sum("n")).alias("downgraded"), (F.sum(F.when(F.col("to_band") < F.col("from_band"), F.col("n")).otherwise(0)) / F.sum("n")).alias("upgraded"))


def univariate_auc(df: DataFrame, features: list[str], label: str = "label", ceiling: float = 0.95) -> DataFrame:
    """(feature, n, auc, separates): how well each feature alone ranks the label, whichever way it runs; too well is a leak."""
    from paygrove.operators import evaluate

    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])
    d = df.select(F.col(label).alias("label"), F.inline(each)).filter("score is not null")
    a = evaluate.auroc(d, ["feature"])
    best = F.greatest(F.col("auroc"), 1 - F.col("auroc"))
    n = d.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return n.join(a, "feature").select("feature", "n", best.alias("auc"), F.coalesce(best > ceiling, F.lit(False)).alias("separates"))


def selection(df: DataFrame, features: dict[str, list[float]], label: str = "label", low: float = 0.02, high: float = 0.5, ceiling: float = 0.9) -> DataFrame:
    """(feature, iv, correlation, admitted, why): which features enter a card, by information value and correlation with the label."""
    from paygrove.operators.folds import label_correlations

    iv = None
    for f, edges in features.items():
        t = bin_table(df, f, edges, label).agg(F.sum("iv_part").alias("iv")).withColumn("feature", F.lit(f))
        iv = t if iv is None else iv.unionByName(t)
    c = label_correlations(df, list(features), label, ceiling).withColumnRenamed("column", "feature")
    d = iv.join(c, "feature")
    why = F.when(F.col("iv") < low, "too_weak").when(F.col("iv") > high, "too_strong").when(F.col("leaks"), "correlates_with_label").otherwise("admitted")
    return d.select("feature", "iv", "correlation", (why == "admitted").alias("admitted"), why.alias("why"))


def quantile_edges(df: DataFrame, col: str, parts: int = 10) -> DataFrame:
    """(edge): the lower elements at each inner quantile, repeats once; at most ``parts`` - 1 rows."""
    from paygrove.operators.ranks import running

    c = running(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n")), [F.col("x")], value=F.col("n"), name="upto")
    every = c.agg(F.sum("n").alias("all"))
    at = F.array(*[F.min(F.when(F.col("upto") > F.floor(F.lit(k) * (F.col("all") - 1) / F.lit(parts)), F.col("x"))) for k in range(1, parts)])
    return c.join(F.broadcast(every)).agg(F.array_distinct(at).alias("e")).select(F.explode("e").alias("edge"))  # one row broadcast


def score_psi(expected: DataFrame, actual: DataFrame, keys: list[str], col: str = "score", parts: int = 10) -> DataFrame:
    """(keys, psi): stability of a score on the quantile edges of the expected rows, fixed for all keys."""
    e = quantile_edges(expected, col, parts).agg(F.sort_array(F.collect_list("edge")).alias("edges"))  # at most parts - 1 numbers
    binned = lambda d: d.join(F.broadcast(e)).withColumn("bin", F.size(F.filter("edges", lambda x: x < F.col(col))))
    b = binned(actual)
    a = binned(expected).join(actual.select(*keys).distinct()) if keys else binned(expected)  # keys are folds, a handful
    return psi(a, b, keys).groupBy(*keys).agg(F.sum("csi").alias("psi"))


def positive_rates(frame: DataFrame, period: str = "fold", label: str = "label") -> DataFrame:
    """(period, n, positives, rate)."""
    return frame.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(label).alias("rate"))
