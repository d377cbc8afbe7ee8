"""Operator 10, quality rules: a ledger of failure bits and measurements, then policies over it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: What a rule is: its bit, its name, and when it fails, in terms of the measurements.
#: Integer arithmetic only, so every engine decides alike.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "too_few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 8 * word_chars"),
    (3, "symbol_per_word", "100 * n_symbols > 30 * n_words"),
    (4, "shouting", "10 * n_upper > 6 * n_letters"),
    (5, "repeated_lines", "100 * n_dup_lines > 40 * n_lines AND n_dup_lines >= 3"),
    (6, "no_letters", "2 * n_letters < word_chars"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


@dataclass(frozen=True)
class Policy:
    """A versioned policy rejects a document that fails any rule of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bit = {name: 1 << b for b, name, _ in RULES}
        return sum(bit[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(name for _, name, _ in RULES))
POLICIES = (BASE, STRICT)


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    if v < 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # pairs are numbered first, so that three ids fit in 64 bits
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * np.int64(v) + ids[2:]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = twice[at] == key
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; all 0 for null."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on ASCII white space
    chars = len(t) - sum(t.count(c) for c in SPACE)
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    upper = sum(map(str.isupper, t)) if not t.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = sum(map(str.isalpha, t)) if not t.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    return (
        len(words), chars, sum(t.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), _repeat_words(words),
        len(lines), letters, upper,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.array([measure(x) for x in b.column("t").to_pylist()], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([b.column("i"), *[pa.array(got[:, k]) for k in range(len(MEASURES))]], ["i", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the measurements and ``failed_bits``.

    Each rule is evaluated once, over the whole text, without a shuffle. Null text is
    empty: it has no words and fails ``too_few_words``. Letters and capitals are Unicode's.
    Repeated rows give repeated rows; other columns are ignored. An empty table gives an
    empty result.
    """
    narrow = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = dict(narrow.dtypes)["i"]
    m = narrow.mapInArrow(_measured, f"i {kind}, " + ", ".join(f"{c} bigint" for c in MEASURES))
    return with_bits(m).withColumnRenamed("i", id_col)


def with_bits(m: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for b, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("failed_bits", bits)


def apply_policy(led: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with ``name``: true where no rule of the policy failed."""
    return led.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, fail it alone, and are kept without it.

    Works on the counts of distinct failure patterns (at most 2 ** rules rows), not on documents.
    """
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(name).alias("rule")) for b, name, _ in RULES if name in policy.rules])
    return patterns.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def union_bits(led: DataFrame) -> DataFrame:
    """All failures seen, and those that every document shares, over the whole ledger."""
    return led.agg(F.expr("bit_or(failed_bits)").alias("any_failed"), F.expr("bit_and(failed_bits)").alias("all_failed"))


def passing(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns; decided in place, without a join.

    A null text counts as empty, which fails ``too_few_words``. Rows that repeat stay or go
    together; a table without rows, or with none that passes, gives an empty result. Columns
    of any name and type are carried as they are.
    """
    cols = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in cols]).alias("i"), F.col(text_col).alias("t"))
    kind = dict(packed.dtypes)["i"]
    m = packed.mapInArrow(_measured, f"i {kind}, " + ", ".join(f"{c} bigint" for c in MEASURES))
    return apply_policy(with_bits(m), policy, "ok").filter("ok").select("i.*")
