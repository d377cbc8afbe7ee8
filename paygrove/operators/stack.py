"""The model stack of a fold: channels fitted on training rows, fused and calibrated on validation rows, test rows scored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrove.operators import evaluate, models, scorecard, splits
from paygrove.session import checkpoint, scratch_table

#: The channels, in order.
CHANNELS = ("boosted", "scorecard", "anomaly", "rules", "volume", "value", "breadth")
#: Where bands begin, as multiples of the base rate.
BANDS = ((4.0, "E"), (2.0, "D"), (1.0, "C"), (0.5, "B"))


def channels(train: DataFrame, rows: DataFrame, numeric: list[str], plain: dict[str, str], rule: str, label: str = "label", trees: int = 5, depth: int = 3, carded: list[str] | None = None) -> tuple[DataFrame, scorecard.Card]:
    """(rows with a column per channel, the card), all fitted on ``train``.

    Trees see all ``numeric`` columns; the card and the distance see those of ``carded``
    (all, unless given). ``plain`` names the columns whose frozen percentile in the training rows is a channel
    of its own. The number of trees is the one that ranks a hashed fifth of the training rows
    best, never rows that are scored.
    """
    inner = splits.bucket(F.col("account_key"), "early-stop") < 0.2
    mx = lambda d: models.matrix(d, numeric)[0]
    m = models.boosted(mx(train.filter(~inner)), mx(train.filter(inner)), label=label, trees=trees, depth=depth)
    carded = carded or numeric
    card = scorecard.fit(train, carded, label=label)
    d = m.transform(mx(rows)).drop("x")
    d = scorecard.score(d, card)
    # fewer points are worse; the scale is the logistic one that made the points
    d = d.withColumn("scorecard", 1 / (1 + F.exp((F.col("card_score") - 600) / F.lit(20 / 0.6931471805599453))))
    d = models.percentile_rank(models.robust_distance(train, train, carded), models.robust_distance(train, d, carded), "distance", "anomaly")
    for name, col in plain.items():
        d = models.percentile_rank(train.filter(F.col(col).isNotNull()), d, col, name)
    return d.withColumn("rules", F.coalesce(rule, F.lit(0.0))), card


def annotate(scored: DataFrame, base: Column, card: scorecard.Card, run_id: str) -> DataFrame:
    """Bands by multiples of the base rate, the strongest channels, what the card takes points for, and the run."""
    x = F.col("p_calibrated") / F.greatest(base, F.lit(1e-9))
    band = F.lit("A")
    for least, name in reversed(BANDS):
        band = F.when(x >= least, name).otherwise(band)
    each = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0.0))).alias("v"), F.lit(c).alias("c")) for c in CHANNELS])
    top = F.transform(F.slice(F.array_sort(each), 1, 3), lambda s: s["c"])
    low = F.array(*[F.struct(F.col(f"points_{f}").alias("p"), F.lit(f).alias("f")) for f in card.bins])
    why = F.transform(F.slice(F.array_sort(F.filter(low, lambda s: s["p"] < 0)), 1, 3), lambda s: F.format_string("%s costs %d points", s["f"], -s["p"]))
    return scored.withColumns({"band": band, "top_channels": top, "reasons": why, "run_id": F.lit(run_id)})


def run_fold(frame: DataFrame, fold: int, numeric: list[str], plain: dict[str, str], rule: str, run_id: str, label: str = "label", carded: list[str] | None = None) -> DataFrame:
    """Test rows of one fold with every channel, the fused and the calibrated score, and their annotations.

    Validation rows are parted by a hash of the account: one half weighs the channels, the
    other calibrates the fused score. So no row is used twice, and test rows only once.
    """
    of = frame.filter(F.col("fold") == fold)
    train = checkpoint(of.filter("role = 'train'"))
    rest, card = channels(train, of.filter("role in ('valid', 'test')"), numeric, plain, rule, label, carded=carded)
    rest = checkpoint(rest.withColumn(label, F.col(label).cast("double")).fillna(0.0, list(CHANNELS)))
    half = splits.bucket(F.col("account_key"), "calibrate") < 0.5
    valid = rest.filter("role = 'valid'")
    fused = models.fuse(valid.filter(half), list(CHANNELS), label)
    raw = lambda d: fused.transform(d).withColumn("fused", models.positive("fused_p")).drop("__c", "fused_p", "fused_raw", "fused_y")
    how, c = models.calibrate(raw(valid.filter(~half)), "fused", label)
    test = raw(rest.filter("role = 'test'"))
    if how == "isotonic":
        test = c.transform(test)
    elif how == "platt":
        test = c.transform(test).withColumn("p_calibrated", models.positive("platt_p")).drop("__r", "platt_p", "platt_raw", "platt_y")
    else:
        test = test.withColumn("p_calibrated", F.col("fused"))
    base = F.lit(train.agg(F.avg(label)).first()[0])
    return annotate(test.withColumn("calibration", F.lit(how)), base, card, run_id)


def run(frame: DataFrame, folds: list[int], numeric: list[str], plain: dict[str, str], rule: str, run_id: str, carded: list[str] | None = None) -> DataFrame:
    """All folds' test rows, scored by their own fold's stack, in one written table."""
    out = None
    for f in folds:  # a handful
        t = run_fold(frame, f, numeric, plain, rule, run_id, carded=carded)
        keep = ["account_key", "fold", "label", *CHANNELS, "fused", "p_calibrated", "calibration", "band", "top_channels", "reasons", "run_id", *[c for c in ("exposure_minor", "outflow_minor", "currency") if c in frame.columns]]
        out = t.select(*keep) if out is None else out.unionByName(t.select(*keep))
    return scratch_table(out, "stack")


def gates(scored: DataFrame, least_lift: float = 1.0, most_gap: float = 0.1) -> DataFrame:
    """(channel, n, positives, average_precision, auroc, lift, passes) over the pooled test rows, and whether the calibrated score is calibrated."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("score")) for c in (*CHANNELS, "fused", "p_calibrated")])
    d = scored.select(F.col("label").cast("int").alias("label"), F.inline(each))
    m = evaluate.measure(d, ["channel"])
    gap = d.groupBy("channel").agg(F.abs(F.avg("score") - F.avg("label")).alias("gap"))
    lift = F.col("average_precision") / F.col("base_rate")
    ok = (lift > least_lift) & ((F.col("channel") != "p_calibrated") | (F.col("gap") <= most_gap))
    return m.join(gap, "channel").select("channel", "n", "positives", "average_precision", "auroc", lift.alias("lift"), "gap", ok.alias("passes"))
