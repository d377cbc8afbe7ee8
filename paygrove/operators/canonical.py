"""Contracts and canonicalisation: raw payment logs to one checked event table, bad rows to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrove.functions import keys, money, times
from paygrove.operators.ranks import running
from paygrove.session import checkpoint

# The canonical event, its types, and the raw sources' columns.
CANONICAL = T.StructType([
    T.StructField("txn_id", T.StringType(), False), T.StructField("ts_us", T.LongType(), False), T.StructField("event_date_local", T.DateType(), False),
    T.StructField("local_hour", T.IntegerType(), False), T.StructField("txn_type", T.StringType(), False), T.StructField("channel", T.StringType(), False),
    T.StructField("currency", T.StringType(), False), T.StructField("amount_minor", T.LongType(), False), T.StructField("account_from", T.StringType(), False),
    T.StructField("account_to", T.StringType(), False), T.StructField("src_balance_before_minor", T.LongType()), T.StructField("src_balance_after_minor", T.LongType()),
    T.StructField("dst_balance_before_minor", T.LongType()), T.StructField("dst_balance_after_minor", T.LongType()), T.StructField("label_is_fraud", T.IntegerType(), False),
    T.StructField("label_is_flagged", T.IntegerType(), False), T.StructField("label_typology", T.StringType()), T.StructField("source_dataset", T.StringType(), False),
    T.StructField("batch_id", T.StringType(), False), T.StructField("event_ts_utc", T.TimestampType(), False), T.StructField("run_id", T.StringType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
])
RAW_A = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]
RAW_B = ["ts", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_ccy", "amount_paid", "payment_ccy", "payment_format", "is_laundering"]
TYPES_A = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
CURRENCY_NAMES = money.CURRENCY_NAMES
FORMATS_B = ("ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Reinvestment", "Wire")


class ContractError(ValueError):
    """A frame that breaks its contract; it is refused, never coerced."""


def check_schema(df: DataFrame, schema: T.StructType = CANONICAL) -> DataFrame:
    """``df`` if its columns and types are exactly the contract's, in order."""
    want = [(f.name, f.dataType) for f in schema]
    got = [(f.name, f.dataType) for f in df.schema]
    if want != got:
        raise ContractError(f"columns or types differ: {[x for x in got if x not in want]} for {[x for x in want if x not in got]}")
    return df


def reason_a(c=F.col) -> Column:
    """First failing check of a source A row, null if none."""
    return (
        F.when(c("amount").isNull() | ~c("amount").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "amount_format")
        .when(~c("type").isin(*TYPES_A) | c("type").isNull(), "unknown_type")
        .when(~c("isFraud").isin(0, 1) | c("isFraud").isNull(), "label_not_binary")
        .when(c("amount").startswith("-"), "negative_amount")
        .when(c("nameOrig").isNull() | c("nameDest").isNull(), "null_account")
        .when(c("nameOrig") == c("nameDest"), "self_transfer")
    )


def reason_b(c=F.col, zone: str = "UTC") -> Column:
    """First failing check of a source B row: eleven of them, in fixed order."""
    ccy = F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv]), c("payment_ccy"))
    plain = r"^[0-9]+(\.[0-9]+)?$"
    any_null = F.greatest(*[c(x).isNull().cast("int") for x in RAW_B]) == 1
    return (
        F.when(any_null, "null_field")
        .when(~c("ts").rlike(r"^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}$"), "timestamp_shape")
        .when(times.from_local(c("ts"), zone).isNull(), "timestamp_range")
        .when(~c("amount_paid").rlike(plain) | ~c("amount_received").rlike(plain), "amount_shape")
        .when(~c("is_laundering").isin("0", "1"), "label_not_binary")
        .when(ccy.isNull(), "unknown_currency")
        .when(c("amount_paid").try_cast("decimal(38,8)").isNull() | (F.length(F.regexp_extract(c("amount_paid"), r"^([0-9]+)", 1)) > 16), "amount_overflow")
        .when(money.by_currency(c("amount_paid"), ccy).isNull(), "amount_scale")
        .when(~c("payment_format").isin(*FORMATS_B), "unknown_format")
        .when((F.trim(c("from_account")) == "") | (F.trim(c("to_account")) == ""), "blank_account")
        .when((F.trim(c("from_bank")) == "") | (F.trim(c("to_bank")) == ""), "blank_bank")
    )


def structural(raw: DataFrame, columns: list[str], batch_id: str, dataset: str) -> DataFrame | None:
    """One quarantine row for a batch that lacks columns, or None: a broken batch costs one row."""
    missing = [c for c in columns if c not in raw.columns]
    if not missing:
        return None
    return raw.sparkSession.createDataFrame(
        [(batch_id, dataset, None, "structure", f"missing {', '.join(missing)}", None)],
        "batch_id string, source_dataset string, row_index long, reason string, detail string, payload_json string")


def quarantine(bad: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """Rows with a reason, and the raw row as JSON."""
    return bad.select(
        "batch_id", F.lit(dataset).alias("source_dataset"), "row_index", "reason", F.lit(None).cast("string").alias("detail"),
        F.to_json(F.struct(*columns)).alias("payload_json"))


def first_of(rows: DataFrame, key: list[str], payload: list[str], order: str) -> DataFrame:
    """Per key: (n, same, first): its rows, whether their payloads agree, and the first row whole.

    Payloads are compared by digest in one aggregate, so a key with many copies is never
    gathered and the first row needs no join.
    """
    digest = keys.row_digest(*[F.col(c) for c in payload])
    whole = F.struct(F.col(order).alias("__o"), F.struct(*rows.columns).alias("row"))
    return rows.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(
        F.count(F.lit(1)).alias("n"), (F.min(digest) == F.max(digest)).alias("same"), F.min(whole)["row"].alias("first"))


def split_duplicates(rows: DataFrame, key: list[str], payload: list[str], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, conflicts, counts): equal rows of a key once, keys with differing payloads not at all.

    ``counts`` is one row: dropped and conflicting rows. Only the few keys whose payloads
    differ look up their rows again.
    """
    per = first_of(rows, key, payload, order)
    differ = per.filter("not same").select(*[f"__k_{c}" for c in key])
    conflicts = rows.join(differ, _null_safe(key), "left_semi")
    counts = per.agg(F.coalesce(F.sum(F.when(F.col("same"), F.col("n") - 1)), F.lit(0)).alias("dropped"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("n"))), F.lit(0)).alias("conflicting"))
    return per.filter("same").select("first.*"), conflicts, counts


def _null_safe(key: list[str]) -> Column:
    cond = F.lit(True)
    for c in key:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return cond


def landed(events: DataFrame, run_id: str, ingested_us: int) -> DataFrame:
    """Events with the columns of their landing: the instant as a timestamp, the run, and when it came in."""
    return events.withColumns({"event_ts_utc": F.timestamp_micros("ts_us"), "run_id": F.lit(run_id), "ingested_at": F.timestamp_micros(F.lit(ingested_us))})


def canonical_a(
    raw: DataFrame, batch_id: str, secret: bytes, epoch_us: int, dataset: str = "source_a", zone: str = "Africa/Kampala", now_us: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of a source A batch with ``row_index``; one lazy plan each."""
    d = raw.withColumns({"batch_id": F.lit(batch_id), "reason": reason_a()})
    ident = ["step", "type", "amount", "nameOrig", "nameDest"]
    good = d.filter("reason is null")
    kept, conflicts, _ = split_duplicates(good, ident, [c for c in RAW_A if c not in ident], "row_index")
    digest = keys.row_digest(*[F.col(c) for c in ident])
    minor = lambda c: money.any_decimal(F.col(c).cast("string"))[0]
    k = kept.withColumn("digest", digest)
    k = k.withColumn("ts_us", times.step_instant(F.col("step").cast("long"), epoch_us, keys.digest_offset(F.col("digest"), times.HOUR_US, 9)))
    k = k.withColumns({c: keys.account_key(secret, F.col(c)) for c in ("nameOrig", "nameDest")})
    future = F.lit(False) if now_us is None else F.col("ts_us") > F.lit(now_us)
    events = k.filter(~future).select(
        F.concat(F.lit(dataset + ":"), F.substring("digest", 1, 24)).alias("txn_id"), "ts_us", times.local_date(F.col("ts_us"), zone).alias("event_date_local"),
        times.local_hour(F.col("ts_us"), zone).alias("local_hour"), F.lower("type").alias("txn_type"), F.lit("mobile").alias("channel"), F.lit("UGX").alias("currency"),
        minor("amount").alias("amount_minor"), F.col("nameOrig").alias("account_from"), F.col("nameDest").alias("account_to"),
        minor("oldbalanceOrg").alias("src_balance_before_minor"), minor("newbalanceOrig").alias("src_balance_after_minor"), minor("oldbalanceDest").alias("dst_balance_before_minor"),
        minor("newbalanceDest").alias("dst_balance_after_minor"), F.col("isFraud").cast("int").alias("label_is_fraud"), F.col("isFlaggedFraud").cast("int").alias("label_is_flagged"),
        F.lit(None).cast("string").alias("label_typology"), F.lit(dataset).alias("source_dataset"), "batch_id")
    bad = d.filter("reason is not null").unionByName(conflicts.withColumn("reason", F.lit("duplicate_conflict")))
    q = quarantine(bad, dataset, RAW_A)
    if now_us is not None:
        late = k.filter(future).withColumn("reason", F.lit("future_timestamp"))
        q = q.unionByName(quarantine(late, dataset, RAW_A))
    return events, q


def canonical_b(
    raw: DataFrame, batch_id: str, secret: bytes, typologies: DataFrame | None = None, dataset: str = "source_b", zone: str = "UTC", now_us: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of a source B batch with ``ordinal``; typologies join by ordinal."""
    d = raw.withColumns({"batch_id": F.lit(batch_id), "row_index": F.col("ordinal"), "reason": reason_b(zone=zone)})
    ccy = F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv])[F.col("payment_ccy")]
    k = d.filter("reason is null").withColumns({
        "ts_us": times.from_local(F.col("ts"), zone), "iso": ccy, "digest": keys.row_digest(*[F.col(c) for c in RAW_B]),
        "account_from": F.concat_ws("/", "from_bank", "from_account"), "account_to": F.concat_ws("/", "to_bank", "to_account")})
    k = k.withColumn("amount_minor", money.by_currency(F.col("amount_paid"), F.col("iso")))
    k = k.withColumns({c: keys.account_key(secret, F.col(c)) for c in ("account_from", "account_to")})
    future = F.lit(False) if now_us is None else F.col("ts_us") > F.lit(now_us)
    late, k = k.filter(future).withColumn("reason", F.lit("future_timestamp")), k.filter(~future)
    if typologies is not None:
        k = k.join(typologies.select(F.col("txn_ordinal").alias("ordinal"), "typology"), "ordinal", "left")
    else:
        k = k.withColumn("typology", F.lit(None).cast("string"))
    none = F.lit(None).cast("long")
    events = k.select(
        keys.ordinal_id(dataset, F.col("ordinal"), F.col("digest")).alias("txn_id"), "ts_us", times.local_date(F.col("ts_us"), zone).alias("event_date_local"),
        times.local_hour(F.col("ts_us"), zone).alias("local_hour"), F.lower("payment_format").alias("txn_type"), F.lit("bank").alias("channel"), F.col("iso").alias("currency"),
        "amount_minor", "account_from", "account_to", *[none.alias(c) for c in ("src_balance_before_minor", "src_balance_after_minor", "dst_balance_before_minor", "dst_balance_after_minor")],
        F.col("is_laundering").cast("int").alias("label_is_fraud"), F.lit(0).alias("label_is_flagged"), F.col("typology").alias("label_typology"), F.lit(dataset).alias("source_dataset"), "batch_id")
    q = quarantine(d.filter("reason is not null"), dataset, RAW_B)
    return events, q if now_us is None else q.unionByName(quarantine(late, dataset, RAW_B))


def checks(events: DataFrame) -> DataFrame:
    """One row of counts, each 0 for a sound table: ids, order, money, labels, hours, dates, balances."""
    order = events.groupBy("ts_us", "txn_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("order_not_unique"))
    drift = F.abs(F.datediff("event_date_local", F.to_date(F.timestamp_micros("ts_us"))))
    nulls = sum((F.col(c).isNull().cast("int") for c in ("src_balance_before_minor", "src_balance_after_minor", "dst_balance_before_minor", "dst_balance_after_minor")), F.lit(0))
    plain = events.agg(
        F.count_if(~F.col("txn_id").startswith(F.concat(F.col("source_dataset"), F.lit(":")))).alias("id_not_namespaced"),
        F.count_if(F.col("amount_minor") < 0).alias("negative_amount"), F.count_if(~F.col("label_is_fraud").isin(0, 1) | ~F.col("label_is_flagged").isin(0, 1)).alias("label_not_binary"),
        F.count_if(~F.col("local_hour").between(0, 23)).alias("hour_range"), F.count_if(drift > 1).alias("date_drift"),
        F.count_if(~F.col("account_from").rlike("^[0-9a-f]{12}$") | ~F.col("account_to").rlike("^[0-9a-f]{12}$")).alias("key_shape"),
        F.count_if(~nulls.isin(0, 4)).alias("partial_balances"))
    return plain.join(order)  # one row each


def balances_per_source(events: DataFrame) -> DataFrame:
    """Per source: rows, rows with balances (all or none must have them), typologies and fraud labels."""
    return events.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count("src_balance_before_minor").alias("with_balance"), F.count("label_typology").alias("with_typology"),
        F.sum("label_is_fraud").alias("fraud"), F.count_if(F.col("label_typology").isNotNull() & (F.col("label_is_fraud") == 0)).alias("typology_without_label"))


def batch_manifest(events: DataFrame) -> DataFrame:
    """Per batch: rows, window, base rate, and an order-free digest."""
    d = F.conv(F.substring(keys.row_digest(F.col("txn_id")), 1, 15), 16, 10).cast("decimal(38,0)")
    return events.groupBy("source_dataset", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us"), F.avg("label_is_fraud").alias("fraud_rate"),
        F.lpad(F.hex(F.pmod(F.sum(d), F.lit(2**60).cast("decimal(38,0)")).cast("long")), 15, "0").alias("digest"))


def reconcile(events: DataFrame) -> DataFrame:
    """Per currency: entity rows are twice the events, and debits equal credits equal what moved."""
    side = lambda s: F.struct(F.lit(s).alias("sign"))
    two = events.select("currency", "amount_minor", F.inline(F.array(side(-1), side(1))))
    a = two.groupBy("currency").agg(
        F.count(F.lit(1)).alias("entity_rows"), F.sum(F.when(F.col("sign") < 0, F.col("amount_minor"))).alias("debits_minor"), F.sum(F.when(F.col("sign") > 0, F.col("amount_minor"))).alias("credits_minor"))
    b = events.groupBy("currency").agg(F.count(F.lit(1)).alias("events"), F.sum("amount_minor").alias("moved_minor"))
    j = b.join(a, "currency")
    ok = (F.col("entity_rows") == 2 * F.col("events")) & (F.col("debits_minor") == F.col("credits_minor")) & (F.col("credits_minor") == F.col("moved_minor"))
    return j.withColumn("reconciled", ok)


def connected_slice(events: DataFrame, n: int, pool: int = 64) -> DataFrame:
    """About ``n`` events among the busiest accounts: the pool doubles until its own events cover n, then a stride over time.

    The account ranking is one table, ordered by ranges; each round is two semi-joins
    against it. ``n`` is the size asked for.
    """
    busy = events.select(F.explode(F.array("account_from", "account_to")).alias("account")).groupBy("account").agg(F.count(F.lit(1)).alias("d"))
    rank = checkpoint(running(busy, [F.desc("d"), F.col("account")], name="r"))
    total = rank.count()
    while True:
        top = rank.filter(F.col("r") <= pool).select("account")
        inside = events.join(top.withColumnRenamed("account", "account_from"), "account_from", "left_semi").join(top.withColumnRenamed("account", "account_to"), "account_to", "left_semi")
        have = inside.count()
        if have >= n or pool >= total:
            break
        pool *= 2
    at = running(inside, [F.col("ts_us"), F.col("txn_id")], name="i").withColumn("i", F.col("i") - 1)
    step = lambda i: F.floor(i * F.lit(n) / F.lit(max(have, n)))
    return at.filter(step(F.col("i")) != step(F.col("i") - 1)).drop("i")


def corpus_shape(events: DataFrame) -> DataFrame:
    """Distinct senders, reuse ratio, degree quantiles, self loops, edges, label rate."""
    s = events.groupBy("account_from").agg(F.count(F.lit(1)).alias("k"))
    a = s.agg(F.count(F.lit(1)).alias("senders"), F.count_if(F.col("k") > 1).alias("reused"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY k)").alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)])
    e = events.groupBy("account_from", "account_to").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("account_from") != F.col("account_to")).alias("edges"))
    t = events.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("account_from") == F.col("account_to")).alias("self_loops"), F.avg("label_is_fraud").alias("label_rate"))
    return t.join(a).join(e).withColumn("reuse_ratio", F.col("reused") / F.col("senders"))  # one row each


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n, rows...): rows of either table that the other lacks, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def annotations(lines: DataFrame) -> DataFrame:
    """BEGIN/END blocks of (n, line) to rows (n, attempt_id, typology, description, line).

    The running number of BEGIN lines names the block, and its head is carried down.
    """
    begin = F.col("line").rlike("^BEGIN ")
    d = running(lines, [F.col("n")], value=begin.cast("long"), name="attempt")
    d = running(d, [F.col("n")], value=F.col("line").rlike("^END ").cast("long"), name="ended")
    heads = d.filter(begin).select(F.col("attempt").alias("of"), F.col("line").alias("head"))
    d = d.join(heads, F.col("attempt") == F.col("of"))
    rows = d.filter(~begin & ~F.col("line").rlike("^END ") & (F.col("attempt") > F.col("ended")) & (F.trim("line") != ""))
    return rows.select(
        "n", F.format_string("attempt-%06d", "attempt").alias("attempt_id"), F.lower(F.regexp_extract("head", r"^BEGIN [A-Z ]+ - ([A-Z-]+)", 1)).alias("typology"),
        F.trim(F.regexp_extract("head", r"^BEGIN [A-Z ]+ - [A-Z-]+:?(.*)$", 1)).alias("attempt_description"), "line")


def fifo_match(annotated: DataFrame, txns: DataFrame, key: list[str], order_a: str, order_t: str) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): annotated rows to transactions of equal key, first in first out."""
    a = annotated.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(order_a)))
    t = txns.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(order_t)))
    return a.join(t, [*key, "__k"]).drop("__k"), a.join(t.select(*key, "__k"), [*key, "__k"], "left_anti").drop("__k")
