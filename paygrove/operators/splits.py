"""Walk-forward folds with embargo and purge, roles, holdouts and leak guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrove.functions import keys

DAY = 86_400_000_000


@dataclass(frozen=True)
class Fold:
    """Train on [train_start, train_end), validate on [train_end, valid_end), skip to test_start, test to test_end."""

    fold: int
    train_start: int
    train_end: int
    valid_end: int
    test_start: int
    test_end: int
    purge_us: int


class SplitError(ValueError):
    """A timeline too short for the folds asked of it."""


def plan(events: DataFrame, folds: int = 5, embargo_days: int = 30, valid_share: float = 0.15, first_share: float = 0.4, purge_days: int = 1, sliding: bool = False, ts: str = "ts_us") -> list[Fold]:
    """Fold instants from the timeline's ends: one aggregate, then arithmetic on a few numbers."""
    t = events.agg(F.min(ts).alias("a"), F.max(ts).alias("z")).first()
    if t.a is None:
        raise SplitError("no rows, no folds")
    span, emb = t.z + 1 - t.a, embargo_days * DAY
    step = int(span * (1 - first_share) / folds)
    if step <= emb:
        raise SplitError(f"a test block of {step / DAY:.1f} days doesn't outlast an embargo of {embargo_days}")
    out = []
    for k in range(folds):
        known = t.a + int(span * first_share) + k * step
        start = t.a + k * step if sliding else t.a
        cut = known - int((known - start) * valid_share)
        out.append(Fold(k, start, cut, known, known + emb, known + step, purge_days * DAY))
    return out


def frame(spark, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([tuple(vars(f).values()) for f in folds], "fold int, train_start long, train_end long, valid_end long, test_start long, test_end long, purge_us long")


def role(ts: Column, f: Column) -> Column:
    """train, valid, test, embargo or purged; null outside the fold."""
    return (
        F.when((ts >= f["train_start"]) & (ts < f["train_end"] - f["purge_us"]), "train").when((ts >= f["train_end"] - f["purge_us"]) & (ts < f["train_end"]), "purged")
        .when((ts >= f["train_end"]) & (ts < f["valid_end"]), "valid").when((ts >= f["valid_end"]) & (ts < f["test_start"]), "embargo")
        .when((ts >= f["test_start"]) & (ts < f["test_end"]), "test")
    )


def assign(rows: DataFrame, folds: list[Fold], ts: str = "ts_us") -> DataFrame:
    """Rows once per fold that they have a role in: a map over a handful of folds, no join."""
    fs = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(f).items()]) for f in folds])
    d = rows.withColumn("__f", F.explode(fs))
    return d.withColumn("role", role(F.col(ts), F.col("__f"))).filter("role is not null").withColumn("fold", F.col("__f.fold")).drop("__f")


def fold_of(rows: DataFrame, folds: list[Fold], ts: str = "ts_us") -> DataFrame:
    """Rows with the fold whose test block holds them; null for the rest."""
    hit = [F.when((F.col(ts) >= f.test_start) & (F.col(ts) < f.test_end), F.lit(f.fold)) for f in folds]
    return rows.withColumn("fold", F.coalesce(*hit))


def audit(rows: DataFrame, folds: list[Fold], label: str = "label_is_fraud") -> DataFrame:
    """Per fold and role: rows and positives."""
    return assign(rows, folds).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"))


def bucket(entity: Column, seed: str) -> Column:
    """A number in [0, 1) from a salted hash of the entity."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), entity), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def entity_holdout(accounts: DataFrame, share: float, seed: str = "holdout", col: str = "account_key") -> DataFrame:
    """Accounts with ``held_out``; the same accounts whatever else is in the table."""
    return accounts.withColumn("held_out", bucket(F.col(col), seed) < F.lit(share))


def holdout_size(held: DataFrame, share: float, sigmas: float = 4.0) -> DataFrame:
    """One row: accounts, held out, and whether that lies in the binomial band."""
    n = F.count(F.lit(1))
    k = F.count_if("held_out")
    return held.agg(n.alias("n"), k.alias("held_out"), (F.abs(k - n * share) <= sigmas * F.sqrt(n * share * (1 - share)) + 1).alias("in_band"))


def shared_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys that two slices share; a disjoint pair gives none."""
    return a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_semi")


def feasibility(rows: DataFrame, embargo_days: int, folds: int = 5, ts: str = "ts_us") -> DataFrame:
    """One row: days covered, what the folds need, and the verdict."""
    days = ((F.max(ts) - F.min(ts)) / DAY)
    return rows.agg(days.alias("days"), F.lit(float(embargo_days * folds / 0.6)).alias("needed_days"), (days * 0.6 / folds > embargo_days).alias("feasible"))


def decisions(rows: DataFrame, label: str = "label_is_fraud", money: str = "amount_minor", ts: str = "ts_us") -> DataFrame:
    """One decision per account and fold: the latest row's money, the highest label."""
    return rows.groupBy("account_key", "fold").agg(F.max_by(money, F.struct(ts, "txn_id")).alias(money), F.max(ts).alias(ts), F.max(label).alias(label), F.count(F.lit(1)).alias("rows"))


def frame_digest(rows: DataFrame) -> DataFrame:
    return keys.content_hash(rows)
