"""The incremental forms as queries: each runs its stream over the whole table, in several
micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.catalog.queries import MIXED_FIELDS, PARAMETERS, PAYMENT, ROUTES, STAGES, envelope_texts, mixed_layouts, money, query
from flowlens.operators.aggregates import row_count
from flowlens.operators.joins import union_streams
from flowlens.operators.routing import split
from flowlens.plans.questions import as_one_table, in_currency
from flowlens.schema import TRANSACTIONS
from flowlens.session import GIVEN_BACK, materialize, run_folder, settings
from flowlens.sources import sample_views as views
from flowlens.sources.envelopes import CANCEL_TYPE, END_TYPE
from flowlens.streaming import questions
from flowlens.streaming.completion import CompletedClients
from flowlens.streaming.graphs import StreamedStages
from flowlens.streaming.ingest import land_transactions, stream_parquet
from flowlens.streaming.live import SHORT_RUN_CONF, Tally, above_live_mark, completed
from flowlens.streaming.messages import CONTROL, QUARANTINED, envelope_stream, named_maxima_of_two, stream_lines
from flowlens.streaming.replays import above_high_mark, drop_repeats, high_mark_branches
from flowlens.streaming.running import keep_totals, standing
from flowlens.streaming.runs import appended, committed, numbered, run


BATCHES = 8


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table written as several files, which come one in a batch: what belongs together is
    spread over batches, so that every query has to carry it from one to the next."""
    path = run_folder(spark, f"in-{name}")
    views.table(spark, folder, name).repartition(BATCHES).write.parquet(path)
    return stream_parquet(spark, path, views.SCHEMAS[name], 1)


LINES = ("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag")


def _transactions(spark: SparkSession, folder: str, used_up: bool = False) -> DataFrame:
    """Line items stream past the orders, with the columns that payments are made of. A table of many
    files is written as it lies, a part of its files in a batch: an account's payments are in all of them.
    `used_up` lines go as they are read."""
    lines, path = views.table(spark, folder, "lineitem").select(*LINES), run_folder(spark, "in-lineitem")
    parts = lines.rdd.getNumPartitions()
    files = parts // BATCHES
    spread = lines.coalesce(files * BATCHES) if files else lines.repartition(BATCHES)
    with settings(spark, GIVEN_BACK):
        spread.write.parquet(path)
    arrived = stream_parquet(spark, path, lines.schema, max(files, 1), used_up=used_up)
    return views.transactions_of(arrived, views.table(spark, folder, "orders"))


def _arriving(rows: DataFrame, name: str, steps: int, started: Callable[[DataFrame], None]) -> None:
    """Writes the rows of each step, in as many files as they come in, and runs the stream after it:
    what arrives in a step is one micro-batch, and each starts anew from the checkpoint."""
    spark, path = rows.sparkSession, run_folder(rows.sparkSession, f"in-{name}")
    schema = rows.drop("step").schema
    for step in range(steps):
        rows.where(F.col("step") == step).drop("step").write.mode("append").parquet(path)
        started(stream_parquet(spark, path, schema))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return views.messages_of(_stream(spark, folder, "events"), repeats=True)


@query
def stream_q1(spark, folder):
    path = run_folder(spark, "stream-q1")
    return questions.small_payment_stream(_transactions(spark, folder), path, PARAMETERS)


@query
def stream_routes(spark, folder):
    """One pass over the stream writes every route."""
    tx, path = _transactions(spark, folder), run_folder(spark, "stream-routes")
    run(tx, path, lambda batch, _: split(batch, ROUTES))
    routes = (appended(spark, path, r, tx.schema).withColumn("route", F.lit(r)) for r in ROUTES)
    return union_streams(*routes)


@query
def stream_bank_max(spark, folder):
    usd = in_currency(_transactions(spark, folder))
    return questions.bank_maximum_stream(usd, run_folder(spark, "stream-bank-max"))


@query
def stream_format_avg(spark, folder):
    tx = _transactions(spark, folder)
    averages = questions.format_average_stream(tx, run_folder(spark, "stream-format-avg"))
    return averages.select("payment_format", money("average_amount"))


@query
def stream_count(spark, folder):
    return questions.count_stream(_transactions(spark, folder), run_folder(spark, "stream-count"))


@query
def stream_count_empty(spark, folder):
    """A source without any file yet, and after filtering out everything: zero both times."""
    nothing = _transactions(spark, folder).where(F.col("payment_currency") == "Red")
    counts = questions.count_stream(nothing, run_folder(spark, "stream-nothing"))
    path = run_folder(spark, "no-input")
    views.table(spark, folder, "events").limit(0).write.parquet(path)
    empty = stream_parquet(spark, path, views.SCHEMAS["events"], 1)
    return union_streams(
        counts.withColumn("of", F.lit("filtered")),
        questions.count_stream(empty, run_folder(spark, "stream-empty")).withColumn("of", F.lit("empty")),
    )


@query
def stream_count_by_client(spark, folder):
    tx = _transactions(spark, folder)
    return questions.count_stream(tx, run_folder(spark, "stream-clients"), by=["client_id"])


@query
def stream_q3(spark, folder):
    def open_stream() -> DataFrame:
        return _transactions(spark, folder)

    return questions.far_below_average_stream(open_stream, run_folder(spark, "stream-q3"), PARAMETERS)


@query
def stream_two_hop(spark, folder):
    return questions.two_hop_pairs_stream(_transactions(spark, folder, used_up=True), run_folder(spark, "stream-two-hop"))


@query
def stream_q2(spark, folder):
    usd, accounts = in_currency(_transactions(spark, folder)), views.accounts(spark, folder)
    return questions.named_maximum_stream(usd, accounts, run_folder(spark, "stream-q2"))


@query
def stream_q4(spark, folder):
    tx = _transactions(spark, folder)
    return questions.scatter_gather_stream(tx, run_folder(spark, "stream-q4"), PARAMETERS)


@query
def stream_q5(spark, folder):
    tx, rates = _transactions(spark, folder), views.rates(spark, folder)
    return questions.micro_count_stream(tx, rates, run_folder(spark, "stream-q5"), PARAMETERS)


@query
def stream_restart(spark, folder):
    """Half of the input, an end, the other half, and a start on the same folder."""
    source, state = run_folder(spark, "in-restart"), run_folder(spark, "stream-restart")
    items, orders = views.table(spark, folder, "lineitem"), views.table(spark, folder, "orders")
    for odd in (0, 1):
        part = items.where(F.col("l_orderkey") % 2 == odd)
        part.repartition(BATCHES // 2).write.mode("append").parquet(source)
        arrived = stream_parquet(spark, source, views.SCHEMAS["lineitem"], 1)
        answer = questions.bank_maximum_stream(in_currency(views.transactions_of(arrived, orders)), state)
    return answer


@query
def stream_dedup(spark, folder):
    fresh = drop_repeats(_messages(spark, folder).drop("copy"))
    return questions.rows_of(fresh, run_folder(spark, "stream-dedup"))


def _arrivals(messages: DataFrame) -> DataFrame:
    """Second copies arrive after everything else, and every fifth view is late."""
    late = (F.col("sender") == "view") & (F.col("msg_id") % 5 == 0)
    order = F.col("copy") * 1_000_000_000_000 + F.col("msg_id") + F.when(late, 400).otherwise(0)
    return messages.select("*", order.alias("arrival"))


@query
def high_mark(spark, folder):
    return above_high_mark(_arrivals(views.messages(spark, folder, repeats=True)), "arrival", block=1000)


@query
def stream_high_mark(spark, folder):
    """The messages in the order of their arrival, four steps of first deliveries and four of
    second ones: the marks of a batch hold for all later ones."""
    arrived = _arrivals(views.messages(spark, folder, repeats=True))
    last = views.table(spark, folder, "events").agg(F.max("event_id")).first()[0] or 0
    path, copy = run_folder(spark, "stream-high-mark"), F.floor(F.col("arrival") / 1_000_000_000_000)
    part = F.floor((F.col("arrival") - copy * 1_000_000_000_000) / (last // 4 + 200))
    steps = arrived.withColumn("step", (copy - 1) * 4 + part)
    _arriving(steps, "arrivals", 8, lambda messages: run(messages, path, high_mark_branches("arrival", path, block=1000)))
    return appended(spark, path, "rows", arrived.schema)


@query
def stream_end_markers(spark, folder):
    """Signups end a client's input (ten of them complete it) and large errors cancel it; the
    answer counts the other messages of clients that are complete. All but the errors come twice,
    and errors come last: a tombstone is for what its client has sent so far."""
    table, source = views.table(spark, folder, "events"), run_folder(spark, "in-markers")
    error = F.col("event_type") == "error"
    job = _counting_job(run_folder(spark, "stream-end-markers"))
    for some, files in ((table.where(~error).repartition(BATCHES - 1), 1), (table.where(error), None)):
        some.write.mode("append").parquet(source)
        job.run(_twice(stream_parquet(spark, source, views.SCHEMAS["events"], files)))
    return job.answer(spark)


def _twice(events: DataFrame) -> DataFrame:
    """The events as messages of the kinds above, those with a sender delivered twice."""
    kind = (
        F.when(F.col("event_type") == "signup", END_TYPE)
        .when((F.col("event_type") == "error") & (F.col("value") > 150), CANCEL_TYPE)
        .otherwise("raw_transactions")
    )
    messages = events.select(
        F.concat(F.lit("u"), "user_id").alias("client_id"),
        kind.alias("type"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("sender"),
        F.col("event_id").alias("msg_id"),
    )
    times = F.when(F.col("sender").isNotNull(), 2).otherwise(1)
    return messages.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def _counting_job(folder: str) -> CompletedClients:
    return CompletedClients(
        folder,
        partial=lambda rows: row_count(rows, ["client_id"]),
        merge=lambda partials, complete: complete.join(
            partials.groupBy("client_id").agg(F.sum("count").alias("count")), "client_id", "left"
        ).fillna(0, ["count"]),
        schema="client_id string, count bigint",
        expected_markers=10,
    )


STEPS = 5


def _live_events(spark: SparkSession, folder: str, cancels: bool) -> DataFrame:
    """All events in five steps by id; signups end an input, large errors cancel it, all but errors
    are delivered twice, the second time in the same or the next step."""
    events = views.table(spark, folder, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    cancel = (F.col("event_type") == "error") & (F.col("value") > 180) & F.lit(cancels)
    step = F.floor(F.col("event_id") * STEPS / (last + 1))
    kind = F.when(F.col("event_type") == "signup", END_TYPE).when(cancel, CANCEL_TYPE).otherwise("raw_transactions")
    messages = events.select(
        F.concat(F.lit("u"), "user_id").alias("client_id"), kind.alias("type"), "event_type", "value",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("sender"), F.col("event_id").alias("msg_id"), step.alias("step"),
    )
    again = messages.where(F.col("sender").isNotNull() & (F.col("type") != CANCEL_TYPE))
    later = F.least(F.col("step") + F.col("msg_id") % 2, F.lit(STEPS - 1))
    return messages.unionByName(again.withColumn("step", later))


def _live_answers(spark: SparkSession, folder: str, name: str, cancels: bool) -> DataFrame:
    path, tally = run_folder(spark, name), Tally(keys=("event_type",), rows="count", sums=("value",), largest="largest", named_by="named")
    rows, schemas = _live_events(spark, folder, cancels), []

    def started(messages: DataFrame) -> None:
        named = drop_repeats(messages).withColumns({"largest": F.col("value"), "named": F.lpad(F.col("msg_id").cast("string"), 12, "0")})
        answers = completed(named, tally, expected_markers=3)
        schemas.append(answers.schema)
        run(answers, path, conf=SHORT_RUN_CONF)

    _arriving(rows, name, STEPS, started)
    found = numbered(spark, path, "rows", schemas[-1])
    return found.select("client_id", "event_type", "count", money("value"), money("largest"), "named", F.col("batch").alias("step"))


@query
def stream_live_answers(spark, folder):
    """Answers given in the micro-batch in which a client's third end marker comes, and again with
    the next three; `step` is that micro-batch."""
    return _live_answers(spark, folder, "stream-live-answers", cancels=False)


@query
def stream_live_tombstones(spark, folder):
    """The same with cancellations: a client's rows and markers up to the tombstone's micro-batch are
    gone, those of later ones count from nothing."""
    return _live_answers(spark, folder, "stream-live-tombstones", cancels=True)


@query
def stream_live_marks(spark, folder):
    """Messages above the mark of earlier micro-batches. Every fifth view comes a step late, second
    copies of purchases one step after the first."""
    messages = views.messages(spark, folder, repeats=True)
    last = messages.agg(F.max("msg_id")).first()[0] or 0
    late = F.when((F.col("sender") == "view") & (F.col("msg_id") % 5 == 0), 1).otherwise(0)
    step = F.floor(F.col("msg_id") * STEPS / (last + 1)) + late + F.col("copy") - 1
    path, rows = run_folder(spark, "stream-live-marks"), messages.withColumn("step", step).drop("copy")
    _arriving(rows, "live-marks", STEPS + 1, lambda stream: run(above_live_mark(stream), path, conf=SHORT_RUN_CONF))
    found = numbered(spark, path, "rows", rows.drop("step").schema)
    return found.select("client_id", "sender", "msg_id", money("amount_paid"), F.col("batch").alias("step"))


@query
def stream_all_by_client(spark, folder):
    """All five answers per client from one pass over one stream."""
    by = ["client_id"]
    each_client = F.explode(F.array(*(F.lit(f"client_{i}") for i in range(3))))
    accounts = views.accounts(spark, folder).withColumn("client_id", each_client)
    clients = accounts.select("client_id").distinct()
    answers = questions.answer_all_stream(
        _transactions(spark, folder), accounts, views.rates(spark, folder), run_folder(spark, "stream-all"), PARAMETERS, by, clients
    )
    return as_one_table(answers, by)


@query
def stream_failed_batch(spark, folder):
    """A writer that fails between the branches of its third micro-batch, and a second run: rows that
    a reader sees in each branch, before the second run (`seen` 1) and after it (`seen` 2)."""
    path, rows = run_folder(spark, "stream-failed"), _messages(spark, folder).drop("copy")

    def branches(fails: bool):
        def made(batch: DataFrame, number: int) -> dict[str, DataFrame]:
            broken = batch.where(F.raise_error(F.lit("the writer is gone")).isNull())
            return {"all": batch, "named": broken if fails and number == 2 else batch.where(F.col("sender").isNotNull())}

        return made

    seen = []
    for attempt, fails in ((1, True), (2, False)):
        try:
            run(rows, path, branches(fails), atomic=True)
        except StreamingQueryException:
            if not fails:
                raise
        parts = [committed(spark, path, b, rows.schema).withColumn("branch", F.lit(b)) for b in ("all", "named")]
        counts = union_streams(*parts).groupBy("branch").agg(F.count("*").alias("rows"), F.countDistinct("batch").alias("batches"))
        seen.append(materialize(counts.withColumn("seen", F.lit(attempt))))
    whole = seen[1].select("branch", "rows", "batches")
    first = seen[0].select("branch", F.col("batches").alias("batches_before"), F.col("rows").alias("rows_before"))
    # which rows a micro-batch holds is up to the files, so that of the first run only its batches count
    return whole.join(first, "branch").select("branch", "rows", "batches", "batches_before", (F.col("rows_before") < F.col("rows")).alias("fewer_before"))


@query
def stream_envelopes(spark, folder):
    """Message texts in several micro-batches, some of them cut short, end markers among them: all
    tables of one pass."""
    texts, path = envelope_texts(spark, folder), run_folder(spark, "in-envelopes")
    number = F.get_json_object("value", "$.msg_id").cast("bigint")
    cut = texts.where(number % 13 == 0).select(F.substring("value", 1, 12).alias("value"))
    end = F.struct(F.lit(END_TYPE).alias("type"), F.get_json_object("value", "$.client").alias("client"), number.alias("msg_id"))
    ends = texts.where(number % 17 == 0).select(F.to_json(end).alias("value"))
    union_streams(texts, cut, ends).repartition(BATCHES).write.text(path)
    found = envelope_stream(stream_lines(spark, path, 1), run_folder(spark, "stream-envelopes"), {"raw_transactions": PAYMENT})
    kept = ("client", "msg_id")
    rows = found["raw_transactions"].select(F.lit("rows").alias("part"), *kept, "from_bank", "amount_paid", "payment_format")
    others = (
        found[part].select(F.lit(part).alias("part"), *kept, *(F.lit(None).cast(t).alias(n) for n, t in
        (("from_bank", "string"), ("amount_paid", "double"), ("payment_format", "string")))) for part in (CONTROL, QUARANTINED)
    )
    return union_streams(rows, *others)


@query
def stream_q2_two_inputs(spark, folder):
    """Q2 with payments and accounts both as streams. Payments end with step 3. The accounts of
    client_0 are there before, those of client_1 come along and end a step later, those of client_2
    come last. Markers are delivered twice. `step` is the micro-batch of the answer."""
    steps, nothing = 6, F.lit(None).cast("string")
    usd = in_currency(views.transactions(spark, folder))
    paid = usd.select(
        "client_id", F.lit("raw_transactions").alias("type"), nothing.alias("sender"), F.lit(None).cast("bigint").alias("msg_id"),
        "from_bank", "from_account", "amount_paid", (F.dayofmonth("ts") % 4).alias("step"),
    )
    last = F.col("client_id").substr(-1, 1).cast("int")
    each_client = F.explode(F.array(*(F.lit(f"client_{i}") for i in range(3))))
    accounts = views.accounts(spark, folder).withColumn("client_id", each_client)
    step = F.when(last == 0, 0).when(last == 1, F.col("bank_id").cast("int") % 5).otherwise(5)
    known = accounts.select(
        "client_id", F.lit("raw_accounts").alias("type"), nothing.alias("sender"), F.lit(None).cast("bigint").alias("msg_id"),
        "bank_id", "bank_name", step.alias("step"),
    )

    def with_ends(rows: DataFrame, at: tuple[int, int, int]) -> DataFrame:
        ends = [(f"client_{i}", END_TYPE, "gateway", 1, s) for i, first in enumerate(at) for s in (first, min(first + 1, steps - 1))]
        marked = spark.createDataFrame(ends, "client_id string, type string, sender string, msg_id bigint, step int")
        return rows.unionByName(marked, allowMissingColumns=True)

    inputs = [(with_ends(paid, (3, 3, 3)), run_folder(spark, "in-paid")), (with_ends(known, (0, 4, 5)), run_folder(spark, "in-known"))]
    path = run_folder(spark, "stream-q2-two")
    for number in range(steps):
        for rows, source in inputs:
            rows.where(F.col("step") == number).drop("step").write.mode("append").parquet(source)
        schema = named_maxima_of_two(*(stream_parquet(spark, source, rows.drop("step").schema) for rows, source in inputs), path)
    return numbered(spark, path, "rows", schema).withColumnRenamed("batch", "step")


@query
def stream_mixed_layouts(spark, folder):
    """CSV files of three layouts as a stream that is started anew when another layout has come, two
    files in a micro-batch; each file is read by its own header. A second stream counts on."""
    landed = run_folder(spark, "landed-csv")
    mixed_layouts(spark, folder, lambda path: land_transactions(spark, path, landed, max_files=2))
    schema = T.StructType([*TRANSACTIONS.fields, T.StructField("batch", T.LongType())])
    further = stream_parquet(spark, f"{landed}/rows", schema, 1).select(*MIXED_FIELDS)
    path = run_folder(spark, "stream-mixed")
    run(further, path)
    return appended(spark, path, "rows", further.schema)


def _running_totals(spark: SparkSession, folder: str, name: str) -> tuple[str, T.StructType]:
    """Events of six days in a step, every seventh a step late, added up per day and type."""
    step = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    events = views.table(spark, folder, "events").select("ts", "event_type", "value", step.alias("step"))
    path, schemas = run_folder(spark, name), []
    totals = {"count": F.count("*"), "total": F.sum("value"), "step": F.max("of_step")}

    def started(stream: DataFrame) -> None:
        schemas.append(keep_totals(stream, path, totals, "ts", span="1 day", delay="12 days", by=["event_type"]))

    _arriving(events.withColumn("of_step", F.col("step")), name, 7, started)
    return path, schemas[-1]


@query
def stream_running_totals(spark, folder):
    """Totals per day and type as they were after every step that changed them."""
    path, schema = _running_totals(spark, folder, "stream-running")
    return appended(spark, path, "rows", schema).select("since", "event_type", "step", "count", money("total"))


@query
def stream_standing_totals(spark, folder):
    """The same totals as they stand in the end."""
    path, schema = _running_totals(spark, folder, "stream-standing")
    return standing(spark, path, schema, ["event_type"]).select("since", "event_type", "count", money("total"))


@query
def stream_stages(spark, folder):
    """The configured stages with payments as a stream: one pass over it feeds all five questions."""
    sides = {"accounts": views.accounts(spark, folder), "rates": views.rates(spark, folder)}
    stages = StreamedStages(STAGES, {"transactions": _transactions(spark, folder)}, sides, run_folder(spark, "stream-stages"))
    stages.run()
    return as_one_table(stages.answers(spark))


@query
def stream_stages_two_inputs(spark, folder):
    """The same with the banks' names as a second stream."""
    nations = run_folder(spark, "in-names")
    names = views.accounts(spark, folder)
    names.repartition(4).write.parquet(nations)
    streams = {"transactions": _transactions(spark, folder), "accounts": stream_parquet(spark, nations, names.schema, 1)}
    path = run_folder(spark, "stream-stages-two")
    stages = StreamedStages(STAGES, streams, {"rates": views.rates(spark, folder)}, path)
    stages.run()
    return as_one_table(stages.answers(spark))
