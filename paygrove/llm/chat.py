"""Operator 9, chat formatting: quotation linking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrove.llm.skew import meet
from paygrove.operators.ranks import running
from paygrove.session import checkpoint, scratch_table

#: Messages of a row of a conversation.
PART = 256
_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: A line that announces a quotation, dropped with it.
_INTRO = re.compile(r"^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)\s*:?\s*$", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def level_of(line: str) -> tuple[int, str]:
    """Quote level of a line, and the line without its marks."""
    m = _MARK.match(line)
    return (m[1].count(">"), line[m.end() :]) if m else (0, line)


def normalised(line: str) -> str:
    return _SPACE.sub(" ", line).strip().lower()


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def parse(text: str | None) -> tuple[str, list[bytes], list[tuple[int, bytes]]]:
    """(own text, digests of own passages, (level, digest) of quoted passages).

    A passage is a line that isn't blank. A line that announces a quotation goes if the
    next line with text is quoted.
    """
    lines = [level_of(x) for x in (text or "").split("\n")]
    own, mine, quoted = [], [], []
    for k, (level, line) in enumerate(lines):
        n = normalised(line)
        if level:
            if n:
                quoted.append((level, digest(n)))
            continue
        if n and _INTRO.match(line):
            rest = next((x[0] for x in lines[k + 1 :] if normalised(x[1])), 0)
            if rest:
                continue
        own.append(line)
        if n:
            mine.append(digest(n))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), mine, quoted


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.binary())]))
    for b in batches:
        got = [parse(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("c"), b.column("n"), b.column("role"), pa.array([g[0] for g in got], pa.string()), pa.array([list(dict.fromkeys(g[1])) for g in got], pa.list_(pa.binary())),
             pa.array([[{"level": a, "h": h} for a, h in g[2]] for g in got], quote)],
            ["c", "n", "role", "own", "mine", "quoted"],
        )


def _linked(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, links): written messages (r, c, n, role, own), and for each row r its links, depth, thread and position."""
    m = messages.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    kinds = dict(m.dtypes)
    p = m.mapInArrow(_parsed, f"c {kinds['c']}, n {kinds['n']}, role {kinds['role']}, own string, mine array<binary>, quoted array<struct<level: int, h: binary>>")
    # a key that is never null, so conversations without an id are one
    key = F.coalesce(F.concat(F.lit("="), F.col("c").cast("string")), F.lit("-"))
    p = scratch_table(p.withColumn("ck", key).withColumn("r", F.monotonically_increasing_id()), "messages")
    quotes = p.select("ck", "n", F.inline("quoted")).groupBy("ck", "h", "n", "level").agg(F.count(F.lit(1)).alias("k"))
    wanted = quotes.select("ck", "h").distinct()
    originals = p.select("ck", "n", F.explode("mine").alias("h")).distinct().join(wanted, ["ck", "h"], "left_semi")
    none = F.lit(None).cast(kinds["n"])
    both = quotes.select("ck", "h", "n", "level", "k", none.alias("from")).unionByName(
        originals.select("ck", "h", "n", F.lit(0).alias("level"), F.lit(0).cast("long").alias("k"), F.col("n").alias("from"))
    )
    # the latest original so far; at the same turn quotes come before originals, so none links to its own message
    both = running(both, [F.col("n").asc_nulls_first(), F.desc("level")], ("ck", "h"), F.col("from"), "to", F.max)
    per = both.filter("level > 0 and n is not null").groupBy("ck", "n", "to").agg(F.sum("k").alias("k"), F.sum(F.when(F.col("level") == 1, F.col("k")).otherwise(0)).alias("k1"))
    best = per.groupBy("ck", "n").agg(
        F.sum(F.when(F.col("to").isNotNull(), F.col("k")).otherwise(0)).alias("n_linked"),
        F.max_by("to", F.when(F.col("to").isNotNull() & (F.col("k1") > 0), F.struct("k1", "to"))).alias("reply_to"),
    )
    narrow = p.select("r", "ck", "n", "role", F.xxhash64("own").alias("x"), F.size("quoted").cast("long").alias("n_quoted"))
    got = scratch_table(narrow.join(best, ["ck", "n"], "left"), "links")
    roots = _roots(got.filter("reply_to is not null").select("ck", "n", "reply_to").distinct())
    got = got.join(roots, ["ck", "n"], "left").select(
        "r", "ck", "n", "role", "x", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("root", "n").alias("thread"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("thread", "n", "role", "x")]
    got = running(got, order, ("ck",)).withColumn("position", F.col("position").cast("long"))
    return p.select("r", "c", F.col("n").alias("turn"), F.col("role").alias("said_by"), "own"), got


def link_quotes(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``messages``: conv, turn, role, text without quotes, n_quoted, n_linked, reply_to, depth, thread, position.

    Each quoted passage, by the hash of its normalised text, links to the latest earlier
    message of its conversation that has the passage as its own: quotes and originals of
    a (conversation, hash) lie in one ordered list and each quote takes the last original
    before it, so no pairs are formed. ``reply_to`` is the turn that most first-level
    passages link to, the later one if several do; null without a link. ``depth`` counts
    replies up to the root ``thread``, and ``position`` orders the conversation: threads
    by their root, then by turn, so a reply comes after what it answers. Only hashes and
    turns are joined and ordered, and ordered lists are dealt by ranges, so a conversation
    of any size is spread; a text is shuffled once, to its row.

    Null text is empty. A null conversation is one of its own. Rows that repeat conv and
    turn are separate messages with the same links, and share depth and thread. A null
    turn sorts first, has no links and is never replied to. Other columns are ignored.
    """
    texts, got = _linked(messages, conv_col, turn_col, role_col, text_col)
    return texts.join(got, "r").select(
        F.col("c").alias(conv_col), F.col("turn").alias(turn_col), F.col("said_by").alias(role_col), F.col("own").alias(text_col),
        "n_quoted", "n_linked", "reply_to", "depth", "thread", "position",
    )


def conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part: int = PART,
) -> DataFrame:
    """Conversations in reply order without quotes: one row per conversation and ``part`` messages of it.

    (conv, part, n_messages, messages), where messages is an array of (position, turn,
    role, text, reply_to, depth, thread, n_quoted, n_linked) in order. A conversation of
    more than ``part`` messages goes on in the row with the next part, so no row or task
    gathers more than that. Cases are those of ``link_quotes``; nothing is dropped.
    An empty table gives an empty result.
    """
    texts, got = _linked(messages, conv_col, turn_col, role_col, text_col)
    x = texts.join(got, "r").withColumn("part", F.floor((F.col("position") - 1) / F.lit(part)).cast("int"))
    one = F.struct("position", F.col("turn").alias(turn_col), F.col("said_by").alias(role_col), F.col("own").alias(text_col),
                   "reply_to", "depth", "thread", "n_quoted", "n_linked")
    return x.groupBy("ck", "part").agg(F.first("c").alias(conv_col), F.count(F.lit(1)).alias("n_messages"), F.sort_array(F.collect_list(one)).alias("messages")).select(
        conv_col, "part", "n_messages", "messages"
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(ck, n, root, depth) of each reply, by doubling: rounds grow with the logarithm of the depth."""
    r = checkpoint(replies.select("ck", "n", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        # a row per message that is a root so far, with its own root if it is a reply too; one may be that of most rows
        up = r.groupBy("ck", F.col("root").alias("at")).agg(F.count(F.lit(1)).alias("k")).alias("a").join(
            r.alias("b"), (F.col("a.ck") == F.col("b.ck")) & (F.col("a.at") == F.col("b.n")), "left"
        )
        up = checkpoint(up.select("a.ck", F.col("a.at").alias("root"), "k", F.col("b.root").alias("up"), F.col("b.depth").alias("more")))
        if not up.filter("up is not null").limit(1).count():
            return r
        j = meet(r, up, ["ck", "root"], "k", ["n"])
        r = checkpoint(j.select("ck", "n", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
