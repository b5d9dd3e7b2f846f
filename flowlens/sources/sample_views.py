"""Transactions, accounts, rates and messages derived from order and event tables, for trying
the library where no bank data is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Declared, so that planning reads no file footers and streams can use the same tables.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _bank(key: str) -> Column:
    return F.lpad((F.col(key) % 25).cast("string"), 3, "0")


def _account(key: str) -> Column:
    return F.col(key).cast("string")


def transactions_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers pay suppliers, each by its own number as account; a number belongs to one of 25
    banks. Customers and suppliers of one number are one account, which joins payments to paths.
    Each order belongs to one of three clients."""
    currency = (
        F.when(F.col("l_returnflag") == "R", "US Dollar")
        .when(F.col("l_returnflag") == "A", "Euro")
        .when(F.col("l_linenumber") % 2 == 0, "Yen")
        .otherwise("Bitcoin")
    )
    payment_format = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Wire")
        .when(F.col("o_orderpriority") == "2-HIGH", "ACH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Cheque")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Credit Card")
        .otherwise("Cash")
    )
    return lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat(F.lit("client_"), (F.col("o_orderkey") % 3).cast("string")).alias("client_id"),
        F.col("o_orderdate").alias("ts"),
        _bank("o_custkey").alias("from_bank"),
        _account("o_custkey").alias("from_account"),
        _bank("l_suppkey").alias("to_bank"),
        _account("l_suppkey").alias("to_account"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"),
        currency.alias("receiving_currency"),
        F.col("l_extendedprice").alias("amount_paid"),
        currency.alias("payment_currency"),
        payment_format.alias("payment_format"),
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return transactions_of(table(spark, folder, "lineitem"), table(spark, folder, "orders"))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Banks are nations; those of one region are missing, so some names stay unknown."""
    nation = table(spark, folder, "nation").where(F.col("n_regionkey") != 4)
    return nation.select(
        F.col("n_name").alias("bank_name"), F.col("n_nationkey").cast("string").alias("bank_id")
    )


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """One rate per currency and day with a suitable order; other days are gaps."""
    orders = table(spark, folder, "orders")
    euro = orders.where(F.col("o_orderstatus") == "P").groupBy(F.to_date("o_orderdate")).agg(
        (F.lit(0.8) + F.max(F.col("o_custkey") % 40).cast("double") / 100).alias("rate")
    )
    yen = orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.to_date("o_orderdate")).agg(
        (F.lit(100.0) + F.max(F.col("o_custkey") % 50).cast("double")).alias("rate")
    )
    return (
        euro.toDF("rate_date", "rate")
        .withColumn("code", F.lit("EUR"))
        .unionByName(yen.toDF("rate_date", "rate").withColumn("code", F.lit("JPY")))
        .select("rate_date", "code", "rate")
    )


def messages_of(events: DataFrame, repeats: bool = False) -> DataFrame:
    """One message per event: user as client, event type as sender, event id as number.
    Error events have no sender. With `repeats` the purchases are delivered a second time."""
    message = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("sender"),
        F.col("event_id").alias("msg_id"),
        F.col("value").alias("amount_paid"),
        F.col("event_type").alias("kind"),
    )
    if not repeats:
        return message.drop("kind")
    times = F.when(F.col("kind") == "purchase", 2).otherwise(1)
    return message.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("kind")


def messages(spark: SparkSession, folder: str, repeats: bool = False) -> DataFrame:
    return messages_of(table(spark, folder, "events"), repeats)
