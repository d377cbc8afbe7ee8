"""Order statistics of trailing windows: in one pass per key, or of busy keys without gathering a window.

``passed`` goes through each key's rows in order of time once; a task holds the values of
one key's window, in order. For keys with too many rows for that there is ``sliding``: the
value sought is found digit by digit, all rows at once. A round groups rows by key
and by the digits that are known so far; in each group, in order of time, values that
come into and go out of the window are counted by their next digit, and every row reads
off its own next digit and the index that is left below it. What a task holds is one
count per digit, however many rows the window has; work is a sort of the rows per round.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrove.operators.spans import BUSY, CELL, Cells
from paygrove.session import scratch_table

#: Bits of a digit, and of the blocks in which its counts are summed.
DIGIT, HALF = 8, 4
#: Before every instant: what earlier cells carry in.
START = -(1 << 62)


class _Values:
    """Whole numbers in order, in buckets of at most ``BUCKET`` of them."""

    BUCKET = 1024

    def __init__(self) -> None:
        self.buckets: list[list[int]] = []
        self.tops: list[int] = []

    def add(self, v: int) -> None:
        if not self.buckets:
            self.buckets, self.tops = [[v]], [v]
            return
        i = min(bisect_left(self.tops, v), len(self.tops) - 1)
        b = self.buckets[i]
        insort(b, v)
        if len(b) > self.BUCKET:
            half = len(b) // 2
            self.buckets[i : i + 1] = [b[:half], b[half:]]
            self.tops[i : i + 1] = [b[half - 1], b[-1]]
        else:
            self.tops[i] = b[-1]

    def drop(self, v: int) -> None:
        i = bisect_left(self.tops, v)
        b = self.buckets[i]
        del b[bisect_left(b, v)]
        if b:
            self.tops[i] = b[-1]
        else:
            del self.buckets[i], self.tops[i]

    def nth(self, k: int) -> int:
        for b in self.buckets:
            if k < len(b):
                return b[k]
            k -= len(b)
        raise IndexError(k)


class _Window:
    """The values of one key's last ``width`` microseconds, and their lower quantile."""

    def __init__(self, q: float, width: int) -> None:
        self.q, self.width = q, width
        self.came: deque[tuple[int, int]] = deque()
        self.sign = 1 if q == 1 else -1
        # of an extremum only values that no later one outdoes can be asked for
        self.values = None if q in (0, 1) else _Values()

    def add(self, t: int, v: int) -> None:
        if self.values is None:
            while self.came and self.sign * self.came[-1][1] <= self.sign * v:
                self.came.pop()
        else:
            self.values.add(v)
        self.came.append((t, v))

    def at(self, t: int) -> int | None:
        while self.came and self.came[0][0] <= t - self.width:
            _, v = self.came.popleft()
            if self.values is not None:
                self.values.drop(v)
        if not self.came:
            return None
        return self.came[0][1] if self.values is None else self.values.nth(math.floor(self.q * (len(self.came) - 1)))


def passed(df: DataFrame, keys: list[str], targets: dict[str, tuple[Column, float, int]], ts: str = "ts_us") -> DataFrame:
    """What ``sliding`` gives without cells, from one pass over the rows of each key in order of time.

    The rows go through as they are, so nothing is joined; they come out dealt by the
    first key, which is what further windows of it need. A task holds the values of one
    window, so keys beyond ``spans.ROWS`` belong to ``sliding``.
    """
    names, columns = list(targets), df.columns
    x = df.withColumns({f"__v_{n}": v.cast("long") for n, (v, _, _) in targets.items()})
    how = [(f"__v_{n}", float(q), int(width)) for n, (_, q, width) in targets.items()]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: list[_Window] = []
        waiting: deque[tuple[pa.RecordBatch, list[list[int | None]]]] = deque()
        run: list[tuple[list[list[int | None]], int]] = []  # rows of one key and instant, which all see each other
        key = now = None

        def answer() -> None:
            got = [w.at(now) for w in windows]
            for out, i in run:
                for column, v in zip(out, got, strict=True):
                    column[i] = v
            run.clear()

        def done(b: pa.RecordBatch, out: list[list[int | None]]) -> pa.RecordBatch:
            own = b.select(columns)
            return pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, pa.int64()) for c in out]], [*columns, *names])

        for b in batches:
            if not b.num_rows:
                continue
            whose = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            times, values = b.column(ts).to_pylist(), [b.column(c).to_pylist() for c, _, _ in how]
            out: list[list[int | None]] = [[None] * b.num_rows for _ in how]
            waiting.append((b, out))
            for i, (k, t) in enumerate(zip(whose, times, strict=True)):
                if run and (k != key or t != now):
                    answer()
                if k != key or not windows:
                    windows = [_Window(q, width) for _, q, width in how]
                key, now = k, t
                run.append((out, i))
                for w, column in zip(windows, values, strict=True):
                    if column[i] is not None:
                        w.add(t, column[i])
            while waiting[0][1] is not run[0][0]:
                yield done(*waiting.popleft())
        if run:
            answer()
        for b, out in waiting:
            yield done(b, out)

    ready = x.repartition(keys[0]).sortWithinPartitions(*keys, ts)
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], *[f"`{n}` bigint" for n in names]])
    return ready.mapInArrow(slide, ddl).repartition(keys[0])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (d null) with their next digit and the index within it, from a stream sorted by group and time."""
    group, counts, blocks = None, [], []
    for b in batches:
        key = list(zip(*(b.column(c).to_pylist() for c in ("t", "g1", "g2", "p", "c")), strict=True))
        out = []
        for at, (g, d, n) in enumerate(zip(key, b.column("d").to_pylist(), b.column("n").to_pylist(), strict=True)):
            if g != group:
                group, counts, blocks = g, [0] * (1 << DIGIT), [0] * (1 << (DIGIT - HALF))
            if d is not None:
                counts[d] += n
                blocks[d >> HALF] += n
                continue
            for block, upto in enumerate(accumulate(blocks)):
                if upto > n:
                    break
            left = n - (upto - blocks[block])
            first = block << HALF
            for digit, upto in enumerate(accumulate(counts[first : first + (1 << HALF)]), first):
                if upto > left:
                    break
            out.append((at, digit, left - (upto - counts[digit])))
        at, digit, left = zip(*out, strict=True) if out else ((), (), ())
        asked = b.select(["t", "g1", "g2", "c", "ts", "r"]).take(pa.array(at, pa.int64()))
        prefix = pa.array([(key[k][3] << DIGIT) + x for k, x in zip(at, digit, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*asked.columns, prefix, pa.array(left, pa.int64())], ["t", "g1", "g2", "c", "ts", "r", "p", "k"])


_ASKED = "t int, g1 bigint, g2 bigint, c int, ts bigint, r bigint, p bigint, k bigint"


def _carried(items: DataFrame, cells: DataFrame) -> DataFrame:
    """What each cell of a busy key finds in its window when it begins, by digit."""
    own = items.groupBy("t", "g1", "g2", "p", "d", "c").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("t", "g1", "g2", "p", "d").orderBy("c")
    held = own.select("t", "g1", "g2", "p", "d", "c", F.sum("n").over(by).alias("n"), F.lead("c").over(by).alias("next"))
    last = cells.groupBy("g1", "g2").agg(F.max("c").alias("last"))
    held = held.filter("n <> 0").join(last, ["g1", "g2"]).withColumn("upto", F.coalesce("next", "last"))
    return held.filter("c < upto").select("t", "g1", "g2", "p", F.explode(F.sequence(F.col("c") + 1, F.col("upto"))).alias("c"), F.lit(START).alias("ts"), "d", "n")


def sliding(
    df: DataFrame, keys: list[str], targets: dict[str, tuple[Column, float, int]], ts: str = "ts_us", cells: Cells | None = None,
) -> DataFrame:
    """``df`` with, for each name, a lower quantile of a whole number over the key's last ``width`` microseconds.

    ``targets``: name -> (value, q, width); the value at index floor(q * (n - 1)) of the
    window's sorted values, so 0 is the smallest and 1 the largest; null values don't
    count, and a window without any gives null. A row exactly ``width`` back is out; rows
    of the same instant are in. With ``cells`` of one of the keys, busy keys are dealt by time.
    """
    dealt = cells is not None
    x = df.withColumns({f"__v_{n}": v.cast("long") for n, (v, _, _) in targets.items()}).withColumn("__r", F.monotonically_increasing_id())
    x = scratch_table(cells.place(x.drop(CELL, BUSY)) if dealt else x, "to-rank")
    names = list(targets)
    ends = x.agg(*[f(f"__v_{n}").alias(f"{a}{k}") for k, n in enumerate(names) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    lows = [ends[f"lo{k}"] or 0 for k in range(len(names))]
    bits = max(1, *[((ends[f"hi{k}"] or 0) - lows[k]).bit_length() for k in range(len(names))])
    rounds = -(-bits // DIGIT)
    hashes = [F.xxhash64(F.lit(s), *[F.col(k) for k in keys]).alias(f"g{s}") for s in (1, 2)]
    cell, busy = (F.col(CELL), F.col(BUSY)) if dealt else (F.lit(0), F.lit(False))
    base = x.select(*hashes, cell.alias("c"), busy.alias("busy"), F.col(ts).alias("ts"), F.col("__r").alias("r"), *([F.col(cells.key).alias("__key")] if dealt else []), *[f"__v_{n}" for n in names])
    known = [c for c in base.columns if not c.startswith("__v_")]
    long = base.select(*known, F.inline(F.array(*[
        F.struct(F.lit(k).alias("t"), (F.col(f"__v_{n}") - F.lit(lows[k])).alias("v"), F.lit(targets[n][2]).alias("width")) for k, n in enumerate(names)])))
    some = long.filter("v is not null")
    came = some.select("t", "g1", "g2", "c", "busy", "ts", "v", F.lit(1).cast("bigint").alias("n"), *(["__key"] if dealt else []))
    went = some.select("t", "g1", "g2", "c", "busy", (F.col("ts") + F.col("width")).alias("ts"), "v", F.lit(-1).cast("bigint").alias("n"), *(["__key"] if dealt else []))
    if dealt:  # a row leaves in the cell of that instant
        moved = cells.place(went.drop("c", "busy"), "__key", "ts").withColumnsRenamed({CELL: "c", BUSY: "busy"})
        came, went = came.drop("__key"), moved.select("t", "g1", "g2", "c", "busy", "ts", "v", "n")
    moves = scratch_table(came.union(went), "moves")
    # how many values the window has, by the same count of what came and went
    order = Window.partitionBy("t", "g1", "g2", "c").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    ask = long.select("t", "g1", "g2", "c", "busy", "ts", "r", F.lit(0).cast("bigint").alias("n"))
    both = moves.select("t", "g1", "g2", "c", "ts", F.lit(None).cast("bigint").alias("r"), "n").union(ask.select("t", "g1", "g2", "c", "ts", "r", "n"))
    places = scratch_table(base.filter("busy").select("g1", "g2", "c").distinct(), "places") if dealt else None
    if dealt:
        first = _carried(moves.filter("busy").select("t", "g1", "g2", F.lit(0).cast("bigint").alias("p"), F.lit(0).alias("d"), "c", "n"), places)
        both = both.union(first.select("t", "g1", "g2", "c", "ts", F.lit(None).cast("bigint").alias("r"), "n"))
    sized = both.withColumn("m", F.sum("n").over(order)).filter("r is not null and m > 0")
    q = F.element_at(F.array(*[F.lit(float(targets[n][1])) for n in names]), F.col("t") + 1)
    asked = scratch_table(sized.select("t", "g1", "g2", "c", "ts", "r", F.lit(0).cast("bigint").alias("p"), F.floor(q * (F.col("m") - 1)).cast("bigint").alias("k")), "asked")
    for turn in range(rounds):
        down = DIGIT * (rounds - 1 - turn)
        prefix, digit = F.shiftright("v", down + DIGIT) if down + DIGIT < 63 else F.lit(0).cast("bigint"), F.shiftright("v", down).bitwiseAND((1 << DIGIT) - 1).cast("int")
        items = moves.select("t", "g1", "g2", prefix.alias("p"), "c", "ts", digit.alias("d"), "n", "busy")
        stream = items.drop("busy")
        if dealt:
            stream = stream.union(_carried(items.filter("busy").drop("ts", "busy"), places).select(*stream.columns))
        stream = stream.withColumn("r", F.lit(None).cast("bigint")).union(
            asked.select("t", "g1", "g2", "p", "c", "ts", F.lit(None).cast("int").alias("d"), F.col("k").alias("n"), "r"))
        # what comes and goes at an instant is counted before rows of the instant ask
        stream = stream.repartition("t", "g1", "g2", "p", "c").sortWithinPartitions("t", "g1", "g2", "p", "c", "ts", F.col("d").isNull())
        asked = scratch_table(stream.select("t", "g1", "g2", "p", "c", "ts", "d", "n", "r").mapInArrow(_descend, _ASKED), "asked")
    low = F.element_at(F.array(*[F.lit(v).cast("bigint") for v in lows]), F.col("t") + 1)
    wide = asked.groupBy("r").agg(*[F.max(F.when(F.col("t") == k, F.col("p") + low)).alias(n) for k, n in enumerate(names)])
    return x.join(wide.withColumnRenamed("r", "__r"), "__r", "left").select(*df.columns, *names)
