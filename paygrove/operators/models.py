"""Model channels on pyspark.ml: boosted trees, anomaly rank, fusion, calibration, queue and agreement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrove.operators import evaluate
from paygrove.operators.ranks import running


def matrix(df: DataFrame, numeric: list[str], codes: list[str] = (), out: str = "x"):
    """(frame with a vector column, names): numbers with missing far below any value, strings as hash codes."""
    from pyspark.ml.feature import VectorAssembler

    cols = {f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1e12)) for c in numeric} | {f"__{c}": F.pmod(F.xxhash64(c), F.lit(1 << 16)).cast("double") for c in codes}
    d = df.withColumns(cols)
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(d).drop(*cols), [*numeric, *codes]


def attach_hits(frame: DataFrame, hits: DataFrame, key: str = "account_key") -> DataFrame:
    """Severity sum and maximum, count, and flags for ring and fan rules; 0 without a hit."""
    h = hits.groupBy(F.col("account_key").alias(key)).agg(
        F.max("severity").alias("rule_severity_max"), F.sum("severity").alias("rule_severity_sum"), F.count(F.lit(1)).alias("rule_hits"),
        F.max((F.col("rule_id") == "R4").cast("int")).alias("in_cycle"), F.max(F.col("rule_id").isin("R2", "R3").cast("int")).alias("in_fan"))
    return frame.join(h, key, "left").fillna(0, ["rule_severity_max", "rule_severity_sum", "rule_hits", "in_cycle", "in_fan"])


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with ``weight``: both classes weigh the same in total."""
    t = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    d = df.join(F.broadcast(t))  # one row
    w = F.when(F.col(label) == 1, F.col("n") / (2.0 * F.col("p"))).otherwise(F.col("n") / (2.0 * (F.col("n") - F.col("p"))))
    return d.withColumn("weight", w).drop("n", "p")


@dataclass(frozen=True)
class Boosted:
    """The first ``size`` trees of a boosted ensemble, those that rank the validation rows best."""

    model: object
    size: int
    curve: tuple[float, ...]

    def transform(self, df: DataFrame, out: str = "boosted") -> DataFrame:
        """``df`` with the probability of label 1."""
        d = _sums(df, self.model, self.size)
        return d.withColumn(out, 1 / (1 + F.exp(-2 * F.element_at("__sums", self.size)))).drop("__sums")


def _sums(df: DataFrame, model, size: int) -> DataFrame:
    """``df`` with ``__sums``: the ensemble's margin after each of its first trees, all from one pass over the rows."""
    tree = [t.copy().setPredictionCol(f"__t{k}") for k, t in enumerate(model.trees[:size])]
    for t in tree:  # a declared number of trees; each is a column of the same pass
        df = t.transform(df)
    parts, upto = [], F.lit(0.0)
    for k, w in enumerate(model.treeWeights[:size]):
        upto = upto + F.col(f"__t{k}") * F.lit(float(w))
        parts.append(upto)
    return df.withColumn("__sums", F.array(*parts)).drop(*[f"__t{k}" for k in range(len(tree))])


def staged_precision(model, valid: DataFrame, label: str = "label") -> list[float]:
    """Average precision on ``valid`` of the first 1, 2, ... trees; rows of equal margin are one step."""
    size = len(model.trees)
    d = _sums(valid, model, size).select(F.col(label).cast("long").alias("label"), F.posexplode("__sums").alias("k", "score"))
    got = evaluate.average_precision_ties(d, ["k"]).collect()  # a row per tree
    by = {r.k: r.average_precision for r in got}
    return [by[k] if by.get(k) is not None else 0.0 for k in range(size)] if by else [0.0] * size


def boosted(train: DataFrame, valid: DataFrame, features: str = "x", label: str = "label", trees: int = 20, depth: int = 4, seed: int = 1, step: float = 0.1) -> Boosted:
    """Gradient-boosted trees with class weights, cut where the validation rows' average precision is highest.

    All trees are grown on the training rows, the margins after each tree come from one
    pass over the validation rows, and of equally good sizes the smallest stays.
    """
    from pyspark.ml.classification import GBTClassifier

    g = GBTClassifier(featuresCol=features, labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, stepSize=step)
    model = g.fit(class_weight(train, label))
    curve = staged_precision(model, valid, label)
    return Boosted(model, 1 + max(range(len(curve)), key=lambda k: (curve[k], -k)), tuple(curve))


#: (depth, step) that a search tries.
GRID = ((2, 0.1), (3, 0.1), (2, 0.3), (3, 0.3))


def tune(
    train: DataFrame, valid: DataFrame, features: str = "x", label: str = "label", trees: int = 10, seed: int = 1, grid: tuple[tuple[int, float], ...] = GRID,
) -> tuple[Boosted, list[tuple[int, float, int, float]]]:
    """(best model, trials): every point of the grid is fitted once and cut at its own best size by average precision on ``valid``.

    A trial is (depth, step, size, average precision); the first of equal trials wins.
    """
    tried = [(d, s, boosted(train, valid, features, label, trees, d, seed, s)) for d, s in grid]
    trials = [(d, s, b.size, b.curve[b.size - 1]) for d, s, b in tried]
    best = max(range(len(trials)), key=lambda k: (trials[k][3], -k))
    return tried[best][2], trials


def positive(probability: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(probability), 2)


def robust_distance(train: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
    """``rows`` with ``distance``: mean absolute deviation from the median, in interquartile ranges."""
    q = train.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10_000).alias(c) for c in cols]).first()
    parts = []
    for c in cols:
        lo, mid, hi = q[c] or (0.0, 0.0, 0.0)
        parts.append(F.coalesce(F.abs(F.col(c).cast("double") - mid) / max(hi - lo, 1e-9), F.lit(0.0)))
    return rows.withColumn("distance", sum(parts, F.lit(0.0)) / len(cols))


def percentile_rank(reference: DataFrame, rows: DataFrame, col: str, out: str = "anomaly") -> DataFrame:
    """``rows`` with the share of the frozen reference at or below: an as-of lookup, not a pairing."""
    ref = reference.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    both = rows.withColumns({"__v": F.col(col), "__o": F.lit(1), "__n": F.lit(0).cast("long")}).unionByName(ref.select(F.col("v").alias("__v"), F.lit(0).alias("__o"), F.col("n").alias("__n")), allowMissingColumns=True)
    total = reference.count()
    both = running(both, [F.col("__v"), F.col("__o")], value=F.col("__n"), name="__upto").filter("__o = 1")
    return both.withColumn(out, F.col("__upto") / F.lit(float(max(total, 1)))).drop("__v", "__o", "__n", "__upto")


def fuse(valid: DataFrame, channels: list[str], label: str = "label"):
    """Non-negative logistic weights of the channels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices
    from pyspark.ml import Pipeline

    lr = LogisticRegression(featuresCol="__c", labelCol=label, regParam=1e-3, maxIter=100, lowerBoundsOnCoefficients=Matrices.dense(1, len(channels), [0.0] * len(channels)), probabilityCol="fused_p", rawPredictionCol="fused_raw", predictionCol="fused_y")
    return Pipeline(stages=[VectorAssembler(inputCols=channels, outputCol="__c"), lr]).fit(valid)


def calibrate(valid: DataFrame, raw: str, label: str = "label", isotonic_at: int = 500, platt_at: int = 50):
    """(method, model): isotonic from 500 positives on, Platt from 50, else refused (None)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    p = valid.filter(F.col(label) == 1).count()
    if p >= isotonic_at:
        return "isotonic", IsotonicRegression(featuresCol=raw, labelCol=label, predictionCol="p_calibrated").fit(valid)
    if p >= platt_at:
        lr = LogisticRegression(featuresCol="__r", labelCol=label, probabilityCol="platt_p", rawPredictionCol="platt_raw", predictionCol="platt_y")
        return "platt", Pipeline(stages=[VectorAssembler(inputCols=[raw], outputCol="__r"), lr]).fit(valid)
    return "refused", None


def prior_shift(p: Column, sample_share: float, population_share: float) -> Column:
    """Probability under the population's base rate, for a model fitted on a sample with another."""
    a, b = population_share / sample_share, (1 - population_share) / (1 - sample_share)
    return p * a / (p * a + (1 - p) * b)


def rules_only(frame: DataFrame, severities: list[str]) -> DataFrame:
    return frame.withColumn("rules_score", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in severities), F.lit(0.0)))


def queue(scored: DataFrame, keys: list[str] = (), score: str = "score") -> DataFrame:
    """Rows with their rank by (score descending, account)."""
    return running(scored, [F.desc(score), F.col("account_key")], tuple(keys), name="rank").withColumn("rank", F.col("rank").cast("int"))


def agreement(a: DataFrame, b: DataFrame, key: str = "account_key", band: str = "band") -> DataFrame:
    """(band_a, band_b, n)."""
    x, y = a.select(key, F.col(band).alias("band_a")), b.select(key, F.col(band).alias("band_b"))
    return x.join(y, key).groupBy("band_a", "band_b").agg(F.count(F.lit(1)).alias("n"))


def disagreements(a: DataFrame, b: DataFrame, top: int, key: str = "account_key", band: str = "band", score: str = "score") -> DataFrame:
    """The ``top`` accounts whose bands lie furthest apart."""
    x, y = a.select(key, F.col(band).alias("band_a"), F.col(score).alias("score_a")), b.select(key, F.col(band).alias("band_b"), F.col(score).alias("score_b"))
    d = x.join(y, key).withColumn("distance", F.abs(F.ascii("band_a") - F.ascii("band_b"))).withColumn("gap", F.abs(F.col("score_a") - F.col("score_b")))
    return d.filter("distance > 0").orderBy(F.desc("distance"), F.desc("gap"), key).limit(top)
