"""Operator 11, fill-in-the-middle, with an indexable skip list over the units of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: texts that stay as they are, and, of the others, those that put the suffix first.
PLAIN, SPM = 10, 20
#: On average every so many nodes of a lane one also stands in the next.
STEP = 8


class SkipList:
    """The units of one text with express lanes above them.

    Units are runs of A-Z and a-z, and every other code point by itself. Lane 0 has a
    node per unit; a node also stands in lane k + 1 with odds 1 / ``STEP``, drawn from a
    hash of its position. Each node carries two widths up to the next node of its lane:
    in units and in code points. The head stands in all lanes.
    """

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = ((points | 32) - 97 < 26) & (points < 128)
        first = np.ones(len(points), bool)
        first[1:] = ~(letter[1:] & letter[:-1])
        at = np.flatnonzero(first)
        self.n, self.length = len(at), len(points)
        # a node of a lane: the lane's own arrays of unit and code-point widths, and where the node stands one lane below
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, char = np.arange(self.n), at
        down = np.arange(self.n)
        while True:
            self.lanes.append((np.diff(rank, append=self.n), np.diff(char, append=self.length), down))
            if len(rank) <= STEP:
                break
            up = self._draw(rank, len(self.lanes))
            up[0] = True  # the head
            down = np.flatnonzero(up)
            if len(down) == len(rank):
                break
            rank, char = rank[down], char[down]

    @staticmethod
    def _draw(rank: np.ndarray, lane: int) -> np.ndarray:
        x = (rank.astype(np.uint64) + np.uint64(lane << 40)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32) < np.uint64((1 << 32) // STEP)

    def offset(self, rank: int) -> int:
        """Code points before the unit with ``rank`` (0 to n): from the top lane down, by accumulated widths."""
        if rank >= self.n:
            return self.length
        units = chars = node = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            unit_width, char_width, down = self.lanes[k]
            while units + unit_width[node] <= rank:
                units += int(unit_width[node])
                chars += int(char_width[node])
                node += 1
            node = int(down[node]) if k else node
        return chars


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, prefix, middle = [], [], []
        for text, h1, h2 in zip(b.column("t"), b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True):
            units = SkipList(text.as_py())
            low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
            n.append(units.n)
            prefix.append(units.offset(low))
            middle.append(units.offset(high) - prefix[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], [*b.schema.names, "n", "p", "m"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output), a row for each row of ``docs``; no shuffle.

    The text is cut at two unit ranks drawn from the id. ``form`` is ``psm``, ``spm`` or
    ``plain``; a plain text is its own output and has no widths. A null text counts as
    empty, which is plain. A null id draws from ``1:`` alone; rows that share id and text
    get the same output. Texts that contain a sentinel are plain. Other columns, whatever
    their names, are not read. An empty table gives an empty result. A task holds one
    batch of texts, and for one text at a time its units.
    """
    x = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("i").cast("string"), F.lit(""))), 256)
    x = x.withColumns({f"h{k + 1}": F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)})
    x = x.mapInArrow(_cuts, ", ".join(f"{c} {t}" for c, t in x.dtypes) + ", n bigint, p bigint, m bigint")
    marked = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    form = F.when((F.col("t") == "") | marked | (F.col("h3") % 100 >= 100 - PLAIN), "plain").when(F.col("h4") % 100 < SPM, "spm").otherwise("psm")
    x = x.withColumn("form", form)
    cut, far = F.col("p").cast("int"), (F.col("p") + F.col("m")).cast("int")
    prefix, middle, suffix = F.substring("t", F.lit(1), cut), F.substring("t", cut + 1, F.col("m").cast("int")), F.substring("t", far + 1, F.lit(1 << 30))
    output = (
        F.when(F.col("form") == "plain", F.col("t"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    width = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return x.select(
        F.col("i").alias(id_col), F.col("t").alias(text_col), "n", "form", width("p").alias("prefix_chars"), width("m").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone; null for a null of either.

    Texts that hold a sentinel are plain, so the first of each sentinel is the one that
    ``transform`` wrote: none can arise where a part and a sentinel meet.
    """
    start = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    second, third = F.position(start, output), F.position(F.lit(MIDDLE), output)
    head, tail = F.substring(output, F.lit(4), second - 4), F.substring(output, second + 3, third - second - 3)
    middle = F.substring(output, third + 3, F.lit(1 << 30))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(tail, middle, head))
