"""Queries over whole tables in a folder of Parquet files, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowlens.functions import cleaning, predicates as P
from flowlens.operators import aggregates, fx, graph, joins, routing, validate
from flowlens.operators.projection import project_to
from flowlens.plans import questions
from flowlens.plans.stages import run_stages
from flowlens.schema import FROM, RESULTS, TO, TRANSACTIONS
from flowlens.session import run_folder
from flowlens.sources import csv_tables, envelopes, results, sample_views as views, shards

Query = Callable[[SparkSession, str], DataFrame]

JANUARY, FEB_MARCH, QUARTER, YEAR = (
    ("1997-01-01", "1997-01-31"),
    ("1997-02-01", "1997-03-31"),
    ("1997-01-01", "1997-03-31"),
    ("1997-01-01", "1997-12-31"),
)
PARAMETERS = questions.Parameters(
    small_amount=2000,
    history=JANUARY,
    candidates=FEB_MARCH,
    divisor=10,
    scatter=YEAR,
    min_paths=2,
    micro=QUARTER,
    micro_amount=2000,
    as_of_rates=True,
)
RESULT_COLUMNS = ("from_bank", "from_account", "to_bank", "to_account", "amount_paid")

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _usd(spark: SparkSession, folder: str) -> DataFrame:
    return questions.in_currency(views.transactions(spark, folder))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "orders")


def money(name: str) -> Column:
    """Sums differ in their last digits with the order of addition."""
    return F.round(name, 4).alias(name)


# --- sources -------------------------------------------------------------------------


@query
def scan_transactions(spark, folder):
    tx = views.transactions(spark, folder)
    path = run_folder(spark, "transactions-csv")
    fields = {"Timestamp": F.date_format("ts", "yyyy/MM/dd HH:mm"), "Is Laundering": F.lit("0")}
    for name, field in csv_tables.TRANSACTION_COLUMNS.items():
        fields.setdefault(name, F.col(field) if field in tx.columns else None)
    tx.select(*(c.alias(n) for n, c in fields.items())).write.option("header", True).csv(path)
    return csv_tables.read_transactions(spark, path)


@query
def scan_accounts(spark, folder):
    path = run_folder(spark, "accounts-csv")
    suppliers = views.table(spark, folder, "supplier")
    suppliers.select(
        F.concat(F.lit(" Bank, "), F.col("s_nationkey")).alias("Bank Name"),
        F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("Bank ID"),
        F.col("s_name").alias("Account Number"),
        F.col("s_suppkey").cast("string").alias("Entity ID"),
        F.lit("").alias("Entity Name"),
    ).write.option("header", True).csv(path)
    return csv_tables.read_accounts(spark, path)


def mixed_layouts(spark: SparkSession, folder: str, each: Callable[[str], None] = lambda path: None) -> str:
    """A folder of files with other column orders, a missing column and a repeated name; `each` is
    called with it whenever the files of another layout have come."""
    orders = _orders(spark, folder).select(
        F.col("o_custkey").cast("string").alias("Account"),
        F.col("o_orderkey").cast("string").alias("Account "),  # a header's blanks don't count: one name twice
        F.col("o_totalprice").cast("string").alias("Amount Paid"),
        F.date_format("o_orderdate", "yyyy/MM/dd HH:mm").alias("Timestamp"),
        (F.col("o_orderkey") % 3).alias("part"),
    )
    layouts = [
        ("Timestamp", "Account", "Account ", "Amount Paid"),
        ("Amount Paid", "Account", "Account ", "Timestamp"),
        ("Account", "Amount Paid"),
    ]
    path = run_folder(spark, "mixed-csv")
    for part, layout in enumerate(layouts):
        orders.where(F.col("part") == part).select(*layout).write.mode("append").option("header", True).csv(path)
        each(path)
    return path


MIXED_FIELDS = ("ts", "from_account", "to_account", "amount_paid")


@query
def scan_mixed_layouts(spark, folder):
    return csv_tables.read_transactions(spark, mixed_layouts(spark, folder)).select(*MIXED_FIELDS)


@query
def sink_results(spark, folder):
    """Answers of each client written one after the other, and the first once more."""
    path, by = run_folder(spark, "sink-results"), ["client_id"]
    small = questions.small_payments(_usd(spark, folder), PARAMETERS, by)
    for client in ("client_0", "client_1", "client_2", "client_0"):
        results.write_results({"q1": small.where(F.col("client_id") == client)}, path, "client_id")
    return results.read_result(spark, f"{path}/q1", "q1", "client_id")


@query
def sink_chunks(spark, folder):
    """Rows per file of a result written in bounded files."""
    path = run_folder(spark, "sink-chunks")
    tx = questions.project_to(views.transactions(spark, folder), RESULTS["q1"])
    results.write_results({"q1": tx}, path, max_records_per_file=results.CHUNK_ROWS)
    rows = results.read_result(spark, f"{path}/q1", "q1").groupBy(F.input_file_name().alias("file")).count()
    return rows.agg(F.sum("count").alias("rows"), (F.max("count") <= results.CHUNK_ROWS).alias("bounded"))


@query
def clean_fields(spark, folder):
    raw = _orders(spark, folder).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.lit(" \r"))
        .otherwise(F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\r\n")))
        .alias("priority"),
        F.when(F.col("o_orderstatus") == "O", F.lit("n/a"))
        .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
        .alias("amount"),
    )
    return raw.select(
        "o_orderkey",
        cleaning.blank_to_null(F.col("priority")).alias("priority"),
        cleaning.to_amount(F.col("amount")).alias("amount"),
    )


@query
def parse_timestamp(spark, folder):
    hour, minute = F.col("o_custkey") % 24, F.col("o_custkey") % 60
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"),
               F.format_string(" %02d:%02d", hour, minute)))
        .when(F.col("o_orderstatus") == "O", F.concat(F.date_format("o_orderdate", "yyyy/M/d"),
              F.format_string(" %d:%d:%d", hour, minute, minute)))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    )
    return _orders(spark, folder).select("o_orderkey", cleaning.parse_timestamp(text).alias("ts"))


PAYMENT = T.StructType(
    [f for f in TRANSACTIONS.fields if f.name in ("from_bank", "amount_paid", "payment_format")]
)


def envelope_texts(spark, folder):
    """Events packed hundred by hundred; every seventh message miscounts, every eleventh
    has lost its payload."""
    rows = views.table(spark, folder, "events").select(
        F.floor(F.col("event_id") / 100).alias("msg_id"),
        F.struct(
            F.concat(F.lit("B"), "user_id").alias("from_bank"),
            F.col("value").alias("amount_paid"),
            F.col("event_type").alias("payment_format"),
        ).alias("row"),
    )
    packed = rows.groupBy("msg_id").agg(F.collect_list("row").alias("batch"))
    size = F.size("batch") + F.when(F.col("msg_id") % 7 == 0, 1).otherwise(0)
    payload = F.struct(size.alias("batch_size"), "batch")
    message = F.struct(
        F.lit("raw_transactions").alias("type"),
        F.concat(F.lit("client_"), F.col("msg_id") % 3).alias("client"),
        F.concat(F.lit("gateway_"), F.col("msg_id") % 5).alias("sender"),
        "msg_id",
        F.when(F.col("msg_id") % 11 != 0, payload).alias("payload"),
    )
    return packed.select(F.to_json(message).alias("value"))


def _envelopes(spark, folder):
    return envelopes.parse_envelopes(envelope_texts(spark, folder), PAYMENT)


@query
def envelope_explode(spark, folder):
    return envelopes.envelope_rows(_envelopes(spark, folder), "raw_transactions")


@query
def envelope_quarantine(spark, folder):
    bad = envelopes.quarantined(_envelopes(spark, folder))
    return bad.select("type", "client", "sender", "msg_id", F.col("payload").isNull().alias("no_payload"))


# --- filters and projections ---------------------------------------------------------


@query
def filter_currency(spark, folder):
    return views.transactions(spark, folder).where(P.currency_is("Yen"))


def _amount_filter(op: str, threshold: float) -> Query:
    def run(spark, folder):
        tx = views.transactions(spark, folder)
        return tx.where(P.amount_compares(op, threshold)).select(*RESULT_COLUMNS, "amount_received")

    return run


QUERIES["filter_amount_lt"] = _amount_filter("<", 1500)
QUERIES["filter_amount_eq"] = _amount_filter("=", 5743.5575)
QUERIES["filter_amount_gt"] = _amount_filter(">", 90000)


@query
def having_count_gt(spark, folder):
    pairs = aggregates.count_pairs(views.transactions(spark, folder), min_count=1)
    return pairs.where(P.count_compares(">", 2))


@query
def filter_format_in(spark, folder):
    return views.transactions(spark, folder).where(P.format_in(["Wire", "ACH"]))


@query
def filter_date_range(spark, folder):
    return views.transactions(spark, folder).where(P.date_between(*JANUARY))


@query
def filter_usd_below(spark, folder):
    p = questions.Parameters(micro=("1995-01-01", "2001-12-31"), micro_amount=2000)
    return questions.micro_payments(views.transactions(spark, folder), views.rates(spark, folder), p)


_CONJUNCTION = [
    {"type": "currency", "value": "Euro"},
    {"type": "date_range", "from": "1997-01-01", "to": "1997-12-31"},
    {"type": "payment_format_in", "values": ["Cheque", "Cash"]},
]


@query
def filter_conjunction(spark, folder):
    return views.transactions(spark, folder).where(P.all_of(_CONJUNCTION))


@query
def project_to_schema(spark, folder):
    return project_to(views.transactions(spark, folder), RESULTS["q2"])


@query
def norm_bank_id(spark, folder):
    tx = views.transactions(spark, folder)
    return tx.groupBy("from_bank").agg(F.count("*").alias("n")).select(
        "from_bank", cleaning.strip_leading_zeros(F.col("from_bank")).alias("bank_key"), "n"
    )


# --- routing -------------------------------------------------------------------------

ROUTES = {
    "history": [{"type": "date_range", "from": "1997-01-01", "to": "1997-01-31"}],
    "candidates": [{"type": "date_range", "from": "1997-02-01", "to": "1997-03-31"}],
    "scatter": [
        {"type": "currency", "value": "US Dollar"},
        {"type": "date_range", "from": "1997-01-01", "to": "1997-03-31"},
    ],
}


@query
def route_multi(spark, folder):
    return routing.route(views.transactions(spark, folder), ROUTES)


@query
def route_endpoints(spark, folder):
    tx = views.transactions(spark, folder).select(*FROM, *TO, "amount_paid")
    return routing.endpoints(tx)


@query
def shard_assign(spark, folder):
    accounts = aggregates.distinct_accounts(views.transactions(spark, folder))
    return routing.with_shard(accounts, ["bank", "account"], 7)


@query
def shard_export(spark, folder):
    """Transactions in seven shards by their origin, read back shard by shard beside the manifest."""
    tx, path = views.transactions(spark, folder), run_folder(spark, "export")
    shards.write_shards(tx, FROM, 7, path, rows_per_file=5_000)
    read = [shards.read_shard(spark, path, n, tx.schema).withColumn("shard", F.lit(n)) for n in range(1, 8)]
    found = joins.union_streams(*read).groupBy("shard").agg(
        F.count("*").alias("rows"), F.countDistinct(*FROM).alias("accounts"), F.round(F.sum("amount_paid"), 2).alias("paid")
    )
    listed = shards.manifest(spark, path).select("shard", F.col("rows").alias("listed"), (F.col("most_rows") <= 5_000).alias("bounded"))
    return found.join(listed, "shard")


# --- aggregates ----------------------------------------------------------------------


@query
def agg_bank_max(spark, folder):
    return aggregates.largest_per_group(views.transactions(spark, folder))


@query
def agg_format_avg(spark, folder):
    averages = aggregates.average_per_group(views.transactions(spark, folder))
    return averages.select("payment_format", money("average_amount"))


@query
def agg_pair_count(spark, folder):
    return aggregates.count_pairs(views.transactions(spark, folder), min_count=2)


@query
def agg_pair_count_merge(spark, folder):
    """Counts of the quarter come pre-aggregated, the other rows count once each."""
    tx = views.transactions(spark, folder)
    inside = P.date_between(*QUARTER)
    counted = aggregates.count_pairs(tx.where(inside), min_count=1)
    plain = tx.where(~inside).select(*FROM, *TO)
    return aggregates.merge_pair_counts(joins.union_streams(counted, plain), min_count=2)


@query
def agg_count(spark, folder):
    return aggregates.row_count(views.transactions(spark, folder))


@query
def agg_distinct_accounts(spark, folder):
    return aggregates.distinct_accounts(views.transactions(spark, folder))


@query
def scatter_origins(spark, folder):
    return graph.scatter_origins(views.transactions(spark, folder), min_destinations=30)


@query
def scatter_transactions(spark, folder):
    tx = views.transactions(spark, folder).select(*FROM, *TO, "amount_paid")
    return graph.scatter_transactions(tx, min_destinations=30)


# --- joins and sets ------------------------------------------------------------------


@query
def join_bank_name(spark, folder):
    tx = views.transactions(spark, folder).select("from_bank", "from_account", "amount_paid")
    return joins.with_bank_name(tx, views.accounts(spark, folder))


@query
def join_two_hop(spark, folder):
    return graph.two_hop_pairs(views.transactions(spark, folder))


@query
def two_hop_grid(spark, folder):
    """The same with every middle of some weight cut into a grid."""
    return graph.two_hop_pairs(views.transactions(spark, folder), cell_pairs=500)


@query
def join_not_broadcast(spark, folder):
    """The joins with small sides, by shuffle: nothing counts as small."""
    tx = views.transactions(spark, folder)
    averages = aggregates.average_per_group(tx.where(P.date_between(*JANUARY)))
    below = joins.below_average(tx.select(*FROM, *RESULTS["q3"].names[2:]), averages, 20, small_rows=0)
    named = joins.with_bank_name(below, views.accounts(spark, folder), small_rows=0)
    dated = tx.select(*FROM, "ts", "payment_currency", "payment_format", "amount_paid")
    converted = fx.with_base_amount(dated, views.rates(spark, folder), as_of=True, rate_rows=0)
    counted = converted.groupBy("from_bank").agg(F.count("*").alias("converted"))
    return named.groupBy("from_bank", "bank_name").agg(F.count("*").alias("below")).join(counted, "from_bank")


@query
def join_below_average(spark, folder):
    tx = views.transactions(spark, folder)
    averages = aggregates.average_per_group(tx.where(P.date_between(*JANUARY)))
    return joins.below_average(tx.select(*RESULTS["q3"].names), averages, divisor=20)


@query
def join_fx_exact(spark, folder):
    return fx.with_base_amount(views.transactions(spark, folder), views.rates(spark, folder))


@query
def join_fx_asof(spark, folder):
    tx, rates = views.transactions(spark, folder), views.rates(spark, folder)
    return fx.with_base_amount(tx, rates, as_of=True)


@query
def union_streams(spark, folder):
    tx = views.transactions(spark, folder).select(*FROM, "amount_paid")
    return joins.union_streams(tx, views.accounts(spark, folder))


@query
def union_averages(spark, folder):
    """Partial sums of two disjoint halves, merged."""
    tx = views.transactions(spark, folder)
    early = P.date_between("1995-01-01", "1997-12-31")
    parts = joins.union_streams(
        aggregates.average_parts(tx.where(early)), aggregates.average_parts(tx.where(~early))
    )
    return aggregates.merge_average_parts(parts).select("payment_format", money("average_amount"))


@query
def diff_multiset(spark, folder):
    """All payments against those in dollars: every other one is missing."""
    columns = [*FROM, "payment_format"]
    tx = views.transactions(spark, folder)
    return validate.diff_multiset(_usd(spark, folder).select(*columns), tx.select(*columns))


@query
def check_counts(spark, folder):
    tx = views.transactions(spark, folder)
    results = {
        "banks": tx.select("from_bank").distinct(),
        "formats": tx.select("payment_format").distinct(),
        "reds": tx.where(P.currency_is("Red")),
        "count": aggregates.row_count(tx.where(P.currency_is("Red"))),
    }
    expected = {"banks": 25, "formats": 4, "reds": 0, "count": 1, "absent": 0}
    return validate.check_counts(results, expected, {"count": 0})


@query
def diff_clients(spark, folder):
    """Clients send different payments over the same banks: only the latter agree."""
    tx = views.transactions(spark, folder)
    clients = tx.select("client_id").distinct()
    payments = validate.diff_clients(tx.select("client_id", *FROM, "amount_paid"), clients)
    banks = validate.diff_clients(tx.select("client_id", "from_bank").distinct(), clients)
    return payments.withColumn("of", F.lit("payments")).unionByName(
        banks.withColumn("of", F.lit("banks"))
    )


@query
def purge_clients(spark, folder):
    """Clients with a very large payment have been cancelled."""
    messages = views.messages(spark, folder)
    return joins.purge_clients(messages, messages.where(F.col("amount_paid") > 250))


# --- the five questions --------------------------------------------------------------


@query
def q1_small_usd(spark, folder):
    return questions.small_payments(_usd(spark, folder), PARAMETERS)


@query
def q2_bank_max(spark, folder):
    return questions.bank_maxima(_usd(spark, folder), views.accounts(spark, folder))


@query
def q3_below_avg(spark, folder):
    return questions.far_below_average(_usd(spark, folder), PARAMETERS)


@query
def q4_scatter_gather(spark, folder):
    return questions.scatter_gather(_usd(spark, folder), PARAMETERS)


@query
def q4_pruned(spark, folder):
    """Q4 by the form that doesn't enumerate every pair, grids included."""
    usd = _usd(spark, folder).where(P.date_between(*YEAR))
    return graph.scatter_gather_accounts(usd, 5, PARAMETERS.min_paths, direct_pairs=0, cell_pairs=500)


@query
def q4_distinct_middle(spark, folder):
    """Paths counted in middle accounts, over all dollar payments."""
    return graph.scatter_gather_accounts(_usd(spark, folder), 5, 4, distinct_middle=True)


@query
def q5_micro_count(spark, folder):
    tx, rates = views.transactions(spark, folder), views.rates(spark, folder)
    return questions.micro_payment_count(tx, rates, PARAMETERS)


@query
def all_queries_by_client(spark, folder):
    by = ["client_id"]
    each_client = F.explode(F.array(*(F.lit(f"client_{i}") for i in range(3))))
    accounts = views.accounts(spark, folder).withColumn("client_id", each_client)
    clients = accounts.select("client_id").distinct()
    tx, rates = views.transactions(spark, folder), views.rates(spark, folder)
    answers = questions.answer_all(tx, accounts, rates, PARAMETERS, by, clients)
    return questions.as_one_table(answers, by)


# --- declarative configuration -------------------------------------------------------


def _dates(name: str, output: str, window: tuple[str, str]) -> dict:
    spec = {"type": "date_range", "from": window[0], "to": window[1]}
    return {"name": name, "output": output, "filters": [spec]}


STAGES = {
    "stages": [
        {
            "input": "transactions",
            "outputs": ["usd_small", "usd_banks", "usd_dates"],
            "strategy": [{"type": "currency"}, {"value": "US Dollar"}],
        },
        {
            "input": "usd_small",
            "output": "q1",
            "strategy": [{"type": "amount"}, {"condition": "<"}, {"threshold": 2000}],
        },
        {"input": "usd_banks", "output": "bank_max", "strategy": {"type": "bank_max_amount"}},
        {
            "input": "bank_max",
            "output": "named",
            "with": {"accounts": "accounts"},
            "strategy": {"type": "accounts"},
        },
        {"input": "named", "output": "q2", "strategy": [{"type": "query_result"}, {"query": 2}]},
        {
            "input": "usd_dates",
            "routes": [
                _dates("q3_historic", "history", JANUARY),
                _dates("q3_candidates", "candidates", FEB_MARCH),
                _dates("q4_transactions", "scatter", YEAR),
            ],
        },
        {"input": "history", "output": "averages", "strategy": {"type": "payment_format_average"}},
        {
            "input": "candidates",
            "output": "below",
            "with": {"averages": "averages"},
            "strategy": {"type": "historical_average", "threshold_divisor": 10},
        },
        {"input": "below", "output": "q3", "strategy": [{"type": "query_result"}, {"query": 3}]},
        {
            "input": "scatter",
            "output": "q4",
            "strategy": {"type": "scatter_gather", "min_paths": 2},
        },
        {
            "input": "transactions",
            "routes": [_dates("q5_dates", "micro", QUARTER)],
        },
        {
            "input": "micro",
            "output": "converted",
            "with": {"rates": "rates"},
            "strategy": [
                {"type": "currency_conversion"},
                {"conditions": ["Wire", "ACH"]},
                {"as_of": True},
                {"below": 2000},
            ],
        },
        {"input": "converted", "output": "q5", "strategy": {"type": "count"}},
    ]
}


@query
def stages_from_config(spark, folder):
    inputs = {
        "transactions": views.transactions(spark, folder),
        "accounts": views.accounts(spark, folder),
        "rates": views.rates(spark, folder),
    }
    return questions.as_one_table(run_stages(STAGES, inputs))
