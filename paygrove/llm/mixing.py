"""Operator 2, mixing sources to target weights by Pareto order sampling. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrove.session import checkpoint

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A bucket of ranks holds about so many documents; a level has at most so many buckets.
BUCKET, FAN = 1024, 4096
#: Up to so many sources, their rows are broadcast; of more, each is dealt over ``SALTS`` tasks.
SOURCES, SALTS = 4096, 16
#: Weights are rounded to so many steps per doubling, so a source has few different ones.
STEPS = 4


def source_targets(
    sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``: words each source gives to the mix.

    Sources in code-point order, null last, get ``weights`` in turn. They share ``share``
    times all words; no target exceeds ``most`` times its source, and what is over goes
    to the others by weight. The level at which no target is above its cap is found in
    closed form: with sources ordered by cap / weight, a source is capped when the caps
    up to it plus the level there for the rest don't use up the budget.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    t = sources.withColumn("w", F.element_at(ws, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("rho", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    upto = Window.orderBy("rho").rangeBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    used = F.sum("cap").over(upto) + F.col("rho") * (F.sum("w").over(everything) - F.sum("w").over(upto))
    t = t.withColumn("capped", used <= F.col("budget"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    level = F.try_divide(left, F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))))
    return t.drop("cap", "rho", "budget", "capped", "w")


def _weight(weight, size):
    """The weight of a document, rounded; log2(words + 2) if none is given, so longer documents are likelier."""
    w = F.log2(size + F.lit(2)) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    return F.pow(F.lit(2.0), F.round(F.log2(F.least(F.greatest(w, F.lit(1e-9)), F.lit(1e9))) * F.lit(STEPS)) / F.lit(STEPS))


def _rates(levels: DataFrame, t: DataFrame, most: float) -> DataFrame:
    """``t`` with ``rate``: the sum of size * min(most, rate * weight) over a source's documents is its target.

    Solved on the sums per weight (``levels``): from the heaviest on, a weight is at
    ``most`` if the target holds out at the rate that just brings it there.
    """
    x = levels.select(F.col("source").alias("s"), "weight", "words").join(t.select("source", "target"), F.col("s").eqNullSafe(F.col("source")))
    down = Window.partitionBy("s").orderBy(F.desc("weight"))
    lighter = F.sum(F.col("words") * F.col("weight")).over(Window.partitionBy("s")) - F.sum(F.col("words") * F.col("weight")).over(down)
    used = F.lit(float(most)) * F.sum("words").over(down) + F.lit(float(most)) / F.col("weight") * lighter
    x = x.withColumn("full", used <= F.col("target") * F.lit(1 + 1e-12))
    per = x.groupBy("s").agg(
        F.first("target").alias("goal"), F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))), F.lit(0)).alias("sure"),
        F.sum(F.when(~F.col("full"), F.col("words") * F.col("weight"))).alias("mass"), F.min("weight").alias("least"),
    )
    # with every weight at most, or no words at all, the rate that brings the lightest there
    rate = F.coalesce(F.try_divide(F.col("goal") - F.lit(float(most)) * F.col("sure"), "mass"), F.lit(float(most)) / F.col("least"))
    rate = F.when(F.col("goal") <= 0, 0.0).otherwise(F.greatest(rate, F.lit(0.0)))
    return t.join(per.select("s", rate.alias("rate")), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _rank(h, pi):
    """Pareto rank in (0, 1): random odds over inclusion odds, as odds / (1 + odds)."""
    u = (F.shiftrightunsigned(h, 11) + F.lit(0.5)) * F.lit(2.0**-53)
    q = (u / (1 - u)) * ((1 - pi) / pi)
    return q / (1 + q)


def _cross(cells: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The first cell by ``by`` in each ``keys`` whose words pass ``rem``, with what is left for it."""
    w = Window.partitionBy(*keys).orderBy(by)
    c = cells.withColumn("upto", F.sum("words").over(w)).filter("upto > rem")
    c = c.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return c.withColumn("rem", F.col("rem") - (F.col("upto") - F.col("words"))).drop("upto", "nth")


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` (source, h, ...) with the row of their source, from a checkpointed table of sources."""
    few = per_source.withColumnRenamed("source", "s")
    if per_source.limit(SOURCES + 1).count() <= SOURCES:
        return rows.join(F.broadcast(few), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    few = few.withColumn("salt_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    return d.join(few, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("salt_s"))).drop("s", "salt", "salt_s")


def plan_mix(
    docs: DataFrame, size, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, weight=None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """(narrow, plan): the narrow table (id, source, h, size, weight) and a row of decisions per source.

    A document's expected copies r are proportional to its weight, at most ``most``, at
    the rate that makes the source's expected words its target. Whole copies are certain:
    floor(r). The rest is a sample of fixed size in words: documents are ordered by random odds over
    inclusion odds, where the inclusion probability is the fraction of r, and taken until
    the source's remaining words are used; past the first that doesn't fit, later ones of
    the same cell that do fit follow (first fit). The cut is found over cells of ranks,
    twice, so no task sees more than ``FAN`` cells or one cell of about ``BUCKET``
    documents however large the source. A decision is a function of (source, id, size,
    weight): the cell of the cut, and what is taken inside it, by rank, hash and size.
    """
    n = checkpoint(docs.select(
        F.col(id_col).alias("i"), F.col(source_col).alias("source"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        size.cast("long").alias("size"), _weight(weight, size).alias("weight"),
    ))
    levels = checkpoint(n.groupBy("source", "weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")))
    sources = levels.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    t = checkpoint(_rates(levels, source_targets(sources, weights, share, most), most))
    d = _copies(_with_source(n, t.select("source", "rate", "target", "docs")), most)
    d = d.withColumn("k1", F.least(F.lit(FAN), F.ceil(F.col("docs") / BUCKET)).cast("long"))
    d = d.withColumn("b1", F.floor(F.col("p") * F.col("k1")))
    cells = d.groupBy("source", "b1").agg(
        F.sum(F.when(F.col("pi") > 0, F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("size") * F.col("whole")).alias("sure"), F.count(F.lit(1)).alias("n"),
        F.first("k1").alias("k1"), F.first("target").alias("target"),
    )
    cells = cells.withColumn("rem", F.col("target") - F.sum("sure").over(Window.partitionBy("source")))
    cut1 = _cross(cells, ["source"], "b1").select(
        F.col("source").alias("s1"), F.col("b1").alias("c1"), "rem",
        F.least(F.lit(FAN), F.ceil(F.col("n") / BUCKET)).cast("long").alias("k2"),
    )
    inside = d.filter("pi > 0").join(cut1, F.col("source").eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("c1")))
    inside = inside.withColumn("b2", F.floor((F.col("p") * F.col("k1") - F.col("b1")) * F.col("k2")))
    cells2 = inside.groupBy("source", "c1", "b2").agg(F.sum("size").alias("words"), F.first("rem").alias("rem"), F.first("k2").alias("k2"))
    cut2 = _cross(cells2, ["source"], "b2").select(
        F.col("source").alias("s2"), F.col("b2").alias("c2"), F.col("rem").alias("rem2")
    )
    last = inside.join(cut2, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b2") == F.col("c2")))
    last = last.groupBy("source", "c1", "k2", "c2", "rem2", "p", "h", "size").agg(F.sum("size").alias("words"))
    last = last.groupBy("source", "c1", "k2", "c2").agg(
        F.first("rem2").alias("rem2"), F.sort_array(F.collect_list(F.struct("p", "h", "size", "words"))).alias("queue")
    )
    start = F.struct(F.col("rem2").alias("left"), F.array().cast("array<struct<p: double, h: bigint, size: bigint>>").alias("taken"))
    fit = F.aggregate("queue", start, lambda a, x: F.when(
        x["words"] <= a["left"],
        F.struct((a["left"] - x["words"]).alias("left"), F.concat(a["taken"], F.array(F.struct(x["p"].alias("p"), x["h"].alias("h"), x["size"].alias("size")))).alias("taken")),
    ).otherwise(a))
    cut = last.select(F.col("source").alias("s3"), "c1", "k2", "c2", fit["taken"].alias("fits"))
    plan = t.join(cut, F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    return n, checkpoint(plan)


def _copies(d: DataFrame, most: float) -> DataFrame:
    r = F.least(F.lit(float(most)), F.col("rate") * F.col("weight"))
    d = d.withColumn("whole", F.floor(r + F.lit(1e-9)).cast("long"))
    d = d.withColumn("pi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), r - F.col("whole"))))
    d = d.withColumn("pi", F.when(F.col("pi") < 1e-9, 0.0).otherwise(F.col("pi")))
    return d.withColumn("p", F.when(F.col("pi") > 0, _rank(F.col("h"), F.col("pi"))).otherwise(F.lit(0.999999)))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    weight=None, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken.

    ``weight`` is a column of weights; without one a document weighs log2(words + 2). A null text has size 0. A null source is a source of its own, last in order. Rows
    with the same id, source, size and weight share their decision; of rows with the same
    id but other texts each has its own. The draw depends on ids and ``seed`` alone,
    so reruns agree. An empty table gives an empty result; an empty source a target of 0.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
    n, plan = plan_mix(docs, size, id_col, source_col, seed, weight, weights, share, most)
    d = _decide(n, plan, most)
    return d.select(
        F.col("i").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def _decide(n: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    d = _copies(_with_source(n, plan), most)
    x = F.col("p") * F.least(F.lit(FAN), F.ceil(F.col("docs") / BUCKET)).cast("long")
    b1 = F.floor(x)
    b2 = F.floor((x - b1) * F.col("k2"))
    hit = (
        F.when(F.col("pi") == 0, False)
        .when(F.col("c1").isNull(), True)  # the whole source fits
        .when(b1 != F.col("c1"), b1 < F.col("c1"))
        .when(b2 != F.col("c2"), b2 < F.col("c2"))
        .otherwise(F.array_contains("fits", F.struct("p", "h", "size")))
    )
    return d.withColumn("copies", F.col("whole") + F.coalesce(hit, F.lit(False)).cast("long"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    weight=None, most: float = 2.0, **kw,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their own columns, as often as they are taken.

    Nulls, repeats and empty tables are as in ``mix_sources``. Decisions are functions of (source, id, size, weight), so the rows meet only the plan, a row
    per source: texts aren't shuffled unless there are more than ``SOURCES`` sources.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
    _, plan = plan_mix(docs, size, id_col, source_col, seed, weight, most=most, **kw)
    d = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(source_col).alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), size.cast("long").alias("size"),
        _weight(weight, size).alias("weight"),
    )
    taken = _decide(d, plan, most).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
