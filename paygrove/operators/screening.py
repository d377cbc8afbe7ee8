"""Name screening against a watchlist: exact, subset and edit similarity, with candidates that lose no match."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters whose compatibility decomposition is plain ASCII letters: one to one, and one to several."""
    one, many = {}, []
    for c in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
        if plain.isascii() and plain.isalnum() and plain != chr(c):
            if len(plain) == 1:
                one[chr(c)] = plain
            else:
                many.append((chr(c), plain))
    return "".join(one), "".join(one.values()), many


ACCENTS, PLAIN, EXPANDED = _folds()


def normalised(name: Column) -> Column:
    """Lower case, accents and ligatures folded, anything but letters and digits a space."""
    x = F.translate(F.lower(name), ACCENTS, PLAIN)
    for c, plain in (*EXPANDED, ("ß", "ss")):
        x = F.replace(x, F.lit(c), F.lit(plain))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\p{M}", ""), "[^a-z0-9]+", " "))


def tokens(name: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(normalised(name), " "), lambda t: F.length(t) >= least))


def edits(length: int, threshold: float) -> int:
    """Most edits between a name of this length and any other within the threshold, the other being the longer one or not."""
    return math.floor((1 - threshold) * math.floor(length / threshold + 1e-9) + 1e-9)


def segments(length: int, threshold: float) -> list[tuple[int, int]]:
    """(start, length) of one more even segments than there can be edits, so one of them is whole in any match."""
    n = edits(length, threshold) + 1
    cut = [length * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


#: Pairs that may differ by this many edits or fewer meet by patterns, if both names are no longer than ``SHORT``:
#: there an edit takes a name below what a subset match gets, so what shares a pattern ranks by edits alone.
EDITS, SHORT = 2, 19


def patterned(threshold: float) -> int:
    """The greatest length of the longer name of a pair that meets by patterns."""
    return max((n for n in range(SHORT + 1) if math.floor((1 - threshold) * n + 1e-9) <= EDITS), default=0)


def screen(queries: DataFrame, watchlist: DataFrame, threshold: float = 0.85, top: int = 5, longest: int = 512) -> DataFrame:
    """(query_id, reference, method, similarity, rank): the best candidates of each name, none lost.

    Candidates come from equi-joins that hold every pair of each method:
    * identifier and equal name: by the whole text;
    * subset: the rarest token of the smaller name is a token of the other;
    * similar, short names: by patterns with what is edited left out (``_patterns``). All
      names of a pattern are within its edits, so its first ``top`` references are enough,
      and work follows the names however many are alike.
    * similar, longer names: within the threshold a name of length m has at most ``edits(m)``
      edits, so of one more segments than that at least one stands unchanged in the other,
      shifted by no more than the edits. Lengths that cannot match never meet.
    A text in many names makes a large block, which AQE splits; it is never left out.
    Segments of a length are a literal table of lengths up to ``longest``; a longer name
    raises an error.
    """
    q = queries.select("query_id", F.col("name").alias("q"), normalised(F.col("name")).alias("qn"), tokens(F.col("name")).alias("qt"))
    w = watchlist.select("reference", normalised(F.col("name")).alias("wn"), tokens(F.col("name")).alias("wt"))
    pair = ["query_id", "q", "qn", "qt", "reference", "wn", "wt"]
    df = q.select(F.explode("qt").alias("t")).union(w.select(F.explode("wt"))).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def rarest(d: DataFrame, key: str, ts: str) -> DataFrame:
        # by id and tokens, since one entry may have several names
        t = d.select(key, ts, F.explode(ts).alias("t")).join(df, "t").groupBy(key, ts).agg(F.min(F.struct("df", "t"))["t"].alias("t"))
        return d.filter(F.size(ts) >= 2).join(t, [key, ts])

    whole = q.join(w, F.col("q") == F.col("reference")).select(*pair).union(q.join(w, F.col("qn") == F.col("wn")).select(*pair))
    part = rarest(q, "query_id", "qt").join(w.withColumn("t", F.explode("wt")), "t").select(*pair).union(
        rarest(w, "reference", "wt").join(q.withColumn("t", F.explode("qt")), "t").select(*pair))
    near = _near(q, w, threshold, longest).select(*pair).union(_alike(q, w, threshold, top).select(*pair))
    c = whole.union(part).union(near).distinct()
    shorter = F.least(F.size("qt"), F.size("wt"))
    ratio = 1 - F.levenshtein("qn", "wn") / F.greatest(F.length("qn"), F.length("wn"), F.lit(1))
    method = (
        F.when(F.col("q") == F.col("reference"), "identifier").when(F.col("qn") == F.col("wn"), "equal")
        .when((shorter >= 2) & (F.size(F.array_intersect("qt", "wt")) == shorter), "subset").when(ratio >= threshold, "similar"))
    sim = F.when(method.isin("identifier", "equal"), 1.0).when(method == "subset", 0.95).otherwise(ratio)
    d = c.withColumns({"method": method, "similarity": sim}).filter("method is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "reference"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "reference", "method", "similarity", "rank")


def _near(q: DataFrame, w: DataFrame, threshold: float, longest: int) -> DataFrame:
    """Pairs that may be within the threshold, by shared segments."""
    spark = q.sparkSession
    cuts = [(m, edits(m, threshold), j, a, n) for m in range(1, longest + 1) for j, (a, n) in enumerate(segments(m, threshold)) if n]
    plan = spark.createDataFrame(cuts, "m int, k int, j int, a int, n int")  # rows per length, whatever the data
    named = w.filter("wn is not null").withColumn("m", F.when(F.length("wn") <= longest, F.length("wn")).otherwise(F.raise_error(F.lit("a name is too long to screen")).cast("int")))
    own = named.join(F.broadcast(plan.select("m", "j", "a", "n")), "m").withColumn("s", F.expr("substring(wn, a + 1, n)"))
    lengths = F.sequence(F.ceil(F.length("qn") * F.lit(threshold) - 1e-9).cast("int"), F.least(F.lit(longest), F.floor(F.length("qn") / F.lit(threshold) + 1e-9)).cast("int"))
    some = q.filter(F.length("qn").between(1, longest)).withColumn("m", F.explode(lengths)).filter(
        (F.greatest(F.length("qn"), "m") > patterned(threshold)) | (F.least(F.length("qn"), "m") <= EDITS))
    at = F.expr("sequence(greatest(0, a - k), least(length(qn) - n, a + k))")
    theirs = some.join(F.broadcast(plan), "m").filter("length(qn) - n >= greatest(0, a - k)").withColumn("at", F.explode(at)).withColumn("s", F.expr("substring(qn, at + 1, n)"))
    return theirs.select("query_id", "q", "qn", "qt", "m", "j", "s").distinct().join(own.select("reference", "wn", "wt", "m", "j", "s"), ["m", "j", "s"])


def _patterns(name: Column, replaced: int, dropped: int) -> Column:
    """All ways to drop so many letters of a name and to put a mark for so many others."""
    each = lambda xs, made: F.array_distinct(F.flatten(F.transform(xs, made)))
    letters = lambda x, least=1: F.sequence(F.lit(least), F.length(x))
    put = lambda x, i, mark: F.overlay(x, F.lit(mark), i, F.lit(1))
    xs = F.array(name)
    for _ in range(dropped):
        xs = each(xs, lambda x: F.transform(letters(x), lambda i: put(x, i, "")))
    if replaced == 1:
        xs = each(xs, lambda x: F.transform(letters(x), lambda i: put(x, i, "?")))
    elif replaced == 2:
        later = lambda x, i: F.transform(F.filter(letters(x), lambda j: j > i), lambda j: put(put(x, i, "?"), j, "?"))
        xs = each(xs, lambda x: F.flatten(F.transform(letters(x), lambda i: later(x, i))))
    return xs


def _alike(q: DataFrame, w: DataFrame, threshold: float, top: int) -> DataFrame:
    """The best ``top`` pairs of each short name by edit similarity, by shared patterns.

    A pair that is s replaced, e dropped and i added letters apart shares a pattern: the
    query without the e and the entry without the i letters, a mark for each of the s.
    Two names that share one are no further apart than that, so of a pattern's entries
    all but the first ``top`` references rank behind ``top`` others.
    """
    longest = patterned(threshold)
    # names are few bytes that become many patterns: a number of partitions given is not merged by size
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = w.select("reference", "wn").filter(F.length("wn").between(EDITS + 1, longest)).repartition(tasks, "reference", "wn").distinct()
    some = q.select("query_id", "qn").filter(F.length("qn").between(EDITS + 1, longest)).repartition(tasks, "query_id", "qn").distinct()
    theirs = [r.n for r in own.select(F.length("wn").alias("n")).distinct().collect()]  # no more than ``longest`` lengths
    asked = [r.n for r in some.select(F.length("qn").alias("n")).distinct().collect()]
    kinds = [(s, e, i) for s in range(EDITS + 1) for e in range(EDITS + 1 - s) for i in range(EDITS + 1 - s - e) if s + e + i]

    def named(made: Column, kind: Column) -> Column:
        return F.transform(made, lambda x: F.concat(F.reverse(x), kind))

    def keys(name: str, mine: list[int], others: list[int], is_query: bool) -> Column:
        parts = []
        for s, e, i in kinds:
            grows = i - e if is_query else e - i
            fits = [n for n in mine if n + grows in others and math.floor((1 - threshold) * max(n, n + grows) + 1e-9) >= s + e + i]
            if fits:
                made = _patterns(F.col(name), s, e if is_query else i)
                # the query's length tells entries of a pattern apart; letters that differ most come first
                kind = F.concat(F.lit(f"|{s}{e}{i}|"), (F.length(name) + (0 if is_query else grows)).cast("string"))
                parts.append(F.when(F.length(name).isin(*fits), named(made, kind)).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")

    first = F.row_number().over(Window.partitionBy("key").orderBy("reference", "wn"))
    own = own.withColumn("key", F.explode(keys("wn", theirs, asked, False))).withColumn("nth", first).filter(F.col("nth") <= top).drop("nth")
    met = some.withColumn("key", F.explode(keys("qn", asked, theirs, True))).join(own, "key").drop("key")
    ratio = 1 - F.levenshtein("qn", "wn") / F.greatest(F.length("qn"), F.length("wn"))
    met = met.withColumn("r", ratio).filter(F.col("r") >= threshold)
    best = F.dense_rank().over(Window.partitionBy("query_id", "qn").orderBy(F.desc("r"), "reference", "wn"))
    met = met.withColumn("nth", best).filter(F.col("nth") <= top).select("query_id", F.col("qn").alias("__q"), "reference", F.col("wn").alias("__w")).distinct()
    x = met.withColumnsRenamed({"query_id": "__i", "reference": "__r"}).join(q, F.col("query_id").eqNullSafe(F.col("__i")) & (F.col("qn") == F.col("__q")))
    return x.join(w, F.col("reference").eqNullSafe(F.col("__r")) & (F.col("wn") == F.col("__w")))
