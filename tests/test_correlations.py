from pyspark.sql import functions as F

from paygrove.operators import folds


def test_a_column_that_does_not_vary_has_no_correlation(spark):
    """Means of parts merge with rounding (49 times 1 / 49 is below 1), so a spread in doubles says of a constant that it varies."""
    df = spark.range(0, 8 * 49, 1, 8)
    df = df.select(
        (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(1).alias("one"), F.when(F.col("id") >= 0, 7).alias("seven"), (F.col("id") % 3 == 0).cast("int").alias("same"),
        F.col("id").alias("x"), F.lit(0.1).alias("tenth"))
    got = {r["column"]: (r.correlation, r.leaks) for r in folds.label_correlations(df, ["one", "seven", "same", "x", "tenth"], "y").collect()}
    assert [got[c] for c in ("one", "seven", "tenth")] == [(None, False)] * 3
    assert got["same"][1] and abs(got["same"][0] - 1) < 1e-12 and 0 < got["x"][0] < 0.1
    assert folds.label_correlations(df.withColumn("y", F.lit(1)), ["x"], "y").first().correlation is None
    # a row without a label says nothing, of the column neither
    some = df.withColumn("y", F.when(F.col("x") < 40, F.col("y")))
    assert abs(folds.label_correlations(some, ["x"], "y").first().correlation - folds.label_correlations(some.filter("y is not null"), ["x"], "y").first().correlation) < 1e-12
