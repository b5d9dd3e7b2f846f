"""Plain SQL for the queries of this package, written from the question and not from the
DataFrame code."""

from __future__ import annotations

_TX = """
tx AS (
  SELECT 'client_' || CAST(o_orderkey % 3 AS STRING) AS client_id, o_orderdate AS ts,
         lpad(CAST(o_custkey % 25 AS STRING), 3, '0') AS from_bank,
         CAST(o_custkey AS STRING) AS from_account,
         lpad(CAST(l_suppkey % 25 AS STRING), 3, '0') AS to_bank,
         CAST(l_suppkey AS STRING) AS to_account,
         l_extendedprice * (1 - l_discount) AS amount_received,
         CASE l_returnflag WHEN 'R' THEN 'US Dollar' WHEN 'A' THEN 'Euro'
              ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'Yen' ELSE 'Bitcoin' END END AS receiving_currency,
         l_extendedprice AS amount_paid,
         CASE l_returnflag WHEN 'R' THEN 'US Dollar' WHEN 'A' THEN 'Euro'
              ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'Yen' ELSE 'Bitcoin' END END AS payment_currency,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Wire' WHEN '2-HIGH' THEN 'ACH'
              WHEN '3-MEDIUM' THEN 'Cheque' WHEN '4-NOT SPECIFIED' THEN 'Credit Card'
              ELSE 'Cash' END AS payment_format
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_USD = """
usd AS (SELECT * FROM tx WHERE payment_currency = 'US Dollar')"""
_ACC = """
acc AS (SELECT n_name AS bank_name, CAST(n_nationkey AS STRING) AS bank_id
        FROM nation WHERE n_regionkey <> 4),
names AS (SELECT regexp_replace(bank_id, '^0+', '') AS k, max(bank_name) AS bank_name
          FROM acc GROUP BY 1)"""
_RATES = """
rates AS (
  SELECT CAST(o_orderdate AS DATE) AS rate_date, 'EUR' AS code, 'Euro' AS cur,
         CAST(0.8 AS DOUBLE) + CAST(max(o_custkey % 40) AS DOUBLE) / 100 AS rate
  FROM orders WHERE o_orderstatus = 'P' GROUP BY 1
  UNION ALL
  SELECT CAST(o_orderdate AS DATE), 'JPY', 'Yen',
         CAST(100 AS DOUBLE) + CAST(max(o_custkey % 50) AS DOUBLE)
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
spans AS (
  SELECT rate_date, cur, rate,
         lead(rate_date) OVER (PARTITION BY cur ORDER BY rate_date) AS until FROM rates)"""
_EXACT = """
usd_exact AS (
  SELECT tx.*, CASE WHEN payment_currency = 'US Dollar' THEN amount_paid
                    ELSE amount_paid / rate END AS usd
  FROM tx LEFT JOIN rates ON cur = payment_currency AND rate_date = CAST(ts AS DATE)
  WHERE payment_currency = 'US Dollar' OR rate IS NOT NULL)"""
_ASOF = """
usd_asof AS (
  SELECT tx.*, CASE WHEN payment_currency = 'US Dollar' THEN amount_paid
                    ELSE amount_paid / rate END AS usd
  FROM tx LEFT JOIN spans ON cur = payment_currency AND CAST(ts AS DATE) >= rate_date
                         AND (until IS NULL OR CAST(ts AS DATE) < until)
  WHERE payment_currency = 'US Dollar' OR rate IS NOT NULL)"""
_MSG = """
msg AS (
  SELECT 'u' || CAST(user_id AS STRING) AS client_id,
         CASE WHEN event_type <> 'error' THEN event_type END AS sender,
         event_id AS msg_id, value AS amount_paid
  FROM events)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _in(window: str) -> str:
    first, last = {
        "january": ("1997-01-01", "1997-01-31"),
        "feb_march": ("1997-02-01", "1997-03-31"),
        "quarter": ("1997-01-01", "1997-03-31"),
        "year": ("1997-01-01", "1997-12-31"),
        "early": ("1995-01-01", "1997-12-31"),
    }[window]
    return f"CAST(ts AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'"


def _bank_max(source: str, client: str = "") -> str:
    keys = f"{client}from_bank"
    return f"""
      SELECT {client}from_bank, from_account, amount_paid FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY amount_paid DESC, from_account) AS rn
        FROM {source}) WHERE rn = 1"""


def _two_hop(source: str) -> str:
    return f"""
      SELECT l.from_bank, l.from_account, r.to_bank, r.to_account,
             CAST(sum(l.n * r.n) AS BIGINT) AS count
      FROM {source} l JOIN {source} r ON l.to_bank = r.from_bank AND l.to_account = r.from_account
      WHERE NOT (l.from_bank = r.to_bank AND l.from_account = r.to_account)
      GROUP BY 1, 2, 3, 4"""


_EDGES = """
edges AS (SELECT from_bank, from_account, to_bank, to_account, count(*) AS n FROM usd GROUP BY 1, 2, 3, 4)"""


def _questions(client: str) -> dict[str, str]:
    """The five answers; `client` is "" or "client_id, "."""
    same = " AND {0}.client_id = {1}.client_id" if client else ""
    on = same.format
    c = client.replace(", ", "")

    def of(alias: str) -> str:
        return f"{alias}.{client}" if client else ""

    group_c = f"GROUP BY {c}" if c else ""
    return {
        "q1": f"SELECT {client}from_bank, from_account, to_bank, to_account, amount_paid "
        "FROM usd WHERE amount_received < 2000",
        "q2": f"SELECT {client}from_bank, from_account, coalesce(bank_name, 'Unknown') AS bank_name, amount_paid "
        f"FROM ({_bank_max('usd', client)}) m LEFT JOIN names ON regexp_replace(from_bank, '^0+', '') = k",
        "q3": f"""
          SELECT {of('u')}from_bank, from_account, u.payment_format, amount_paid
          FROM usd u JOIN (
            SELECT {client}payment_format, sum(amount_paid) / count(*) AS av FROM usd
            WHERE {_in('january')} GROUP BY {client}payment_format) a
          ON u.payment_format = a.payment_format{on('u', 'a')}
          WHERE {_in('feb_march')} AND amount_paid < av / 10""",
        "q4": f"""
          SELECT {client}from_bank AS bank, from_account AS account FROM ends_{c or 'all'}
          UNION SELECT {client}to_bank, to_account FROM ends_{c or 'all'}""",
        "q5": f"""SELECT {client}count(*) AS count FROM usd_asof
          WHERE payment_format IN ('Wire', 'ACH') AND {_in('quarter')} AND usd < 2000 {group_c}""",
    }


def _ends(client: str) -> str:
    name = client.replace(", ", "") or "all"
    on = "".join(f" AND {{0}}.{k} = {{1}}.{k}" for k in [client.replace(", ", "")] if k).format
    lead = f"l.{client}" if client else ""
    hub = f"h.{client}" if client else ""
    return f"""
ends_{name} AS (
  WITH w AS (SELECT {client}from_bank, from_account, to_bank, to_account FROM usd WHERE {_in('year')}),
  h AS (SELECT {client}from_bank, from_account FROM (SELECT DISTINCT * FROM w) GROUP BY ALL HAVING count(*) >= 5),
  s AS (SELECT w.* FROM w JOIN h ON w.from_bank = h.from_bank AND w.from_account = h.from_account{on('w', 'h')})
  SELECT {lead}l.from_bank, l.from_account, r.to_bank, r.to_account
  FROM s l JOIN s r ON l.to_bank = r.from_bank AND l.to_account = r.from_account{on('l', 'r')}
  WHERE NOT (l.from_bank = r.to_bank AND l.from_account = r.to_account)
  GROUP BY ALL HAVING count(*) >= 2)"""


_COLUMNS = {
    "from_bank": "VARCHAR", "from_account": "VARCHAR", "to_bank": "VARCHAR", "to_account": "VARCHAR",
    "amount_paid": "DOUBLE", "bank_name": "VARCHAR", "payment_format": "VARCHAR",
    "bank": "VARCHAR", "account": "VARCHAR", "count": "BIGINT",
}
_FIELDS = {
    "q1": ("from_bank", "from_account", "to_bank", "to_account", "amount_paid"),
    "q2": ("from_bank", "from_account", "bank_name", "amount_paid"),
    "q3": ("from_bank", "from_account", "payment_format", "amount_paid"),
    "q4": ("bank", "account"),
    "q5": ("count",),
}


def _one_table(client: str) -> str:
    selects = []
    for name, sql in _questions(client).items():
        columns = ", ".join(
            (col if col in _FIELDS[name] else f"CAST(NULL AS {kind})") + f' AS "{col}"'
            for col, kind in _COLUMNS.items()
        )
        selects.append(f"SELECT '{name}' AS query, {client}{columns} FROM ({sql})")
    return "\nUNION ALL\n".join(selects)


_ALL_PARTS = (_TX, _USD, _ACC, _RATES, _ASOF)
_Q = _questions("")
_BATCH = ("from_bank", "amount_paid", "payment_format")

ORACLE: dict[str, str] = {
    "scan_transactions": _with(_TX, select="SELECT * EXCLUDE (client_id) FROM tx"),
    "scan_accounts": """
        SELECT 'Bank, ' || CAST(s_nationkey AS STRING) AS bank_name,
               lpad(CAST(s_nationkey AS STRING), 4, '0') AS bank_id, s_name AS account_number,
               CAST(s_suppkey AS STRING) AS entity_id, CAST(NULL AS VARCHAR) AS entity_name
        FROM supplier""",
    "clean_fields": """
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority,
               CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS amount FROM orders""",
    "parse_timestamp": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'F'
                 THEN o_orderdate + to_hours(o_custkey % 24) + to_minutes(o_custkey % 60)
               WHEN o_orderstatus = 'O'
                 THEN o_orderdate + to_hours(o_custkey % 24) + to_minutes(o_custkey % 60)
                      + to_seconds(o_custkey % 60) END AS ts
        FROM orders""",
    "envelope_explode": """
        SELECT 'client_' || CAST(msg_id % 3 AS STRING) AS client,
               'gateway_' || CAST(msg_id % 5 AS STRING) AS sender, msg_id,
               'B' || CAST(user_id AS STRING) AS from_bank, value AS amount_paid,
               event_type AS payment_format
        FROM (SELECT *, event_id // 100 AS msg_id FROM events)
        WHERE msg_id % 7 <> 0 AND msg_id % 11 <> 0""",
    "envelope_quarantine": """
        SELECT DISTINCT 'raw_transactions' AS type, 'client_' || CAST(msg_id % 3 AS STRING) AS client,
               'gateway_' || CAST(msg_id % 5 AS STRING) AS sender, msg_id,
               msg_id % 11 = 0 AS no_payload
        FROM (SELECT *, event_id // 100 AS msg_id FROM events)
        WHERE msg_id % 7 = 0 OR msg_id % 11 = 0""",
    "filter_currency": _with(_TX, select="SELECT * FROM tx WHERE payment_currency = 'Yen'"),
    "filter_conjunction": _with(
        _TX,
        select=f"""SELECT * FROM tx WHERE payment_currency = 'Euro' AND {_in('year')}
                   AND payment_format IN ('Cheque', 'Cash')""",
    ),
    "having_count_gt": _with(
        _TX,
        select="""SELECT from_bank, from_account, to_bank, to_account, count(*) AS count
                  FROM tx GROUP BY 1, 2, 3, 4 HAVING count(*) > 2""",
    ),
    "filter_format_in": _with(_TX, select="SELECT * FROM tx WHERE payment_format IN ('Wire', 'ACH')"),
    "filter_date_range": _with(_TX, select=f"SELECT * FROM tx WHERE {_in('january')}"),
    "filter_usd_below": _with(
        _TX, _RATES, _EXACT,
        select="""SELECT * FROM usd_exact WHERE payment_format IN ('Wire', 'ACH') AND usd < 2000
                  AND CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""",
    ),
    "project_to_schema": _with(
        _TX,
        select="SELECT from_bank, from_account, CAST(NULL AS VARCHAR) AS bank_name, amount_paid FROM tx",
    ),
    "norm_bank_id": _with(
        _TX,
        select="SELECT from_bank, regexp_replace(from_bank, '^0+', '') AS bank_key, count(*) AS n FROM tx GROUP BY 1",
    ),
    "route_multi": _with(
        _TX,
        select=f"""SELECT *, 'history' AS route FROM tx WHERE {_in('january')}
          UNION ALL SELECT *, 'candidates' FROM tx WHERE {_in('feb_march')}
          UNION ALL SELECT *, 'scatter' FROM tx WHERE {_in('quarter')} AND payment_currency = 'US Dollar'""",
    ),
    "route_endpoints": _with(
        _TX,
        """
e AS (SELECT from_bank, from_account, to_bank, to_account, amount_paid FROM tx)""",
        select="""SELECT from_bank AS bank, from_account AS account, * FROM e
          UNION ALL SELECT to_bank, to_account, * FROM e
          WHERE NOT (from_bank = to_bank AND from_account = to_account)""",
    ),
    "shard_assign": _with(
        _TX,
        """
ends AS (SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx),
bytes AS (SELECT *, list_transform(string_split(bank || '_' || account, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM ends)""",
        select="""SELECT bank, account, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
            lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
              lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) % 7 + 1 AS INTEGER) AS shard
          FROM bytes""",
    ),
    "agg_bank_max": _with(_TX, select=_bank_max("tx")),
    "agg_format_avg": _with(
        _TX,
        select="""SELECT payment_format, round(sum(amount_paid) / count(*), 4) AS average_amount
                  FROM tx GROUP BY 1""",
    ),
    "agg_pair_count": _with(
        _TX,
        select="""SELECT from_bank, from_account, to_bank, to_account, count(*) AS count
                  FROM tx GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""",
    ),
    "agg_count": _with(_TX, select="SELECT count(*) AS count FROM tx"),
    "agg_distinct_accounts": _with(
        _TX,
        select="SELECT from_bank AS bank, from_account AS account FROM tx UNION SELECT to_bank, to_account FROM tx",
    ),
    "scatter_origins": _with(
        _TX,
        select="""SELECT from_bank, from_account, count(*) AS destinations FROM (
            SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM tx)
          GROUP BY 1, 2 HAVING count(*) >= 30""",
    ),
    "scatter_transactions": _with(
        _TX,
        """
h AS (SELECT from_bank, from_account FROM (
        SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM tx)
      GROUP BY 1, 2 HAVING count(*) >= 30)""",
        select="""SELECT tx.from_bank, tx.from_account, to_bank, to_account, amount_paid
          FROM tx JOIN h ON tx.from_bank = h.from_bank AND tx.from_account = h.from_account""",
    ),
    "join_bank_name": _with(
        _TX, _ACC,
        select="""SELECT from_bank, from_account, amount_paid, coalesce(bank_name, 'Unknown') AS bank_name
          FROM tx LEFT JOIN names ON regexp_replace(from_bank, '^0+', '') = k""",
    ),
    "join_two_hop": _with(_TX, _EDGES.replace("FROM usd", "FROM tx"), select=_two_hop("edges")),
    "join_below_average": _with(
        _TX,
        select=f"""SELECT from_bank, from_account, tx.payment_format, amount_paid FROM tx JOIN (
            SELECT payment_format, sum(amount_paid) / count(*) AS av FROM tx WHERE {_in('january')} GROUP BY 1) a
          ON tx.payment_format = a.payment_format WHERE amount_paid < av / 20""",
    ),
    "join_fx_exact": _with(_TX, _RATES, _EXACT, select="SELECT * FROM usd_exact"),
    "join_fx_asof": _with(_TX, _RATES, _ASOF, select="SELECT * FROM usd_asof"),
    "union_streams": _with(
        _TX, _ACC,
        select="""SELECT from_bank, from_account, amount_paid, CAST(NULL AS VARCHAR) AS bank_name,
                         CAST(NULL AS VARCHAR) AS bank_id FROM tx
          UNION ALL SELECT NULL, NULL, NULL, bank_name, bank_id FROM acc""",
    ),
    "diff_multiset": _with(
        _TX,
        select="""SELECT from_bank, from_account, payment_format,
                 CAST(sum(CASE WHEN payment_currency = 'US Dollar' THEN 1 ELSE 0 END) AS BIGINT) AS got,
                 count(*) AS expected
          FROM tx GROUP BY 1, 2, 3 HAVING got <> expected""",
    ),
    "check_counts": _with(
        _TX,
        select="""SELECT query, expected, actual, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS status
          FROM (SELECT 'banks' AS query, CAST(25 AS BIGINT) AS expected, count(DISTINCT from_bank) AS actual FROM tx
                UNION ALL SELECT 'formats', 4, count(DISTINCT payment_format) FROM tx
                UNION ALL SELECT 'reds', 0, count(*) FROM tx WHERE payment_currency = 'Red'
                UNION ALL SELECT 'count', 1, 1 UNION ALL SELECT 'absent', 0, 0)""",
    ),
    "diff_clients": _with(
        _TX,
        """
pay AS (SELECT client_id, from_bank, from_account, amount_paid, count(*) AS n FROM tx GROUP BY ALL),
bank AS (SELECT DISTINCT client_id, from_bank FROM tx),
ref AS (SELECT min(client_id) AS c FROM tx)""",
        select="""
SELECT client_id, CAST((SELECT sum(n) FROM pay x WHERE x.client_id = o.client_id) AS BIGINT) AS rows,
       NOT EXISTS (SELECT from_bank, from_account, amount_paid, n FROM pay, ref WHERE client_id = c
                   EXCEPT SELECT from_bank, from_account, amount_paid, n FROM pay x WHERE x.client_id = o.client_id)
       AND NOT EXISTS (SELECT from_bank, from_account, amount_paid, n FROM pay x WHERE x.client_id = o.client_id
                   EXCEPT SELECT from_bank, from_account, amount_paid, n FROM pay, ref WHERE client_id = c)
       AS agrees, 'payments' AS of
FROM (SELECT DISTINCT client_id FROM tx) o
UNION ALL
SELECT client_id, (SELECT count(*) FROM bank x WHERE x.client_id = o.client_id),
       NOT EXISTS (SELECT from_bank FROM bank, ref WHERE client_id = c
                   EXCEPT SELECT from_bank FROM bank x WHERE x.client_id = o.client_id)
       AND NOT EXISTS (SELECT from_bank FROM bank x WHERE x.client_id = o.client_id
                   EXCEPT SELECT from_bank FROM bank, ref WHERE client_id = c), 'banks'
FROM (SELECT DISTINCT client_id FROM tx) o""",
    ),
    "purge_clients": _with(
        _MSG,
        select="SELECT * FROM msg WHERE client_id NOT IN (SELECT client_id FROM msg WHERE amount_paid > 250)",
    ),
    "q1_small_usd": _with(_TX, _USD, select=_Q["q1"]),
    "q2_bank_max": _with(_TX, _USD, _ACC, select=_Q["q2"]),
    "q3_below_avg": _with(_TX, _USD, select=_Q["q3"]),
    "q4_scatter_gather": _with(_TX, _USD, _ends(""), select=_Q["q4"]),
    "q5_micro_count": _with(_TX, _RATES, _ASOF, select=_Q["q5"]),
    "all_queries_by_client": _with(*_ALL_PARTS, _ends("client_id, "), select=_one_table("client_id, ")),
    "stages_from_config": _with(*_ALL_PARTS, _ends(""), select=_one_table("")),
}

for _key, _op, _threshold in (("lt", "<", 1500), ("eq", "=", 5743.5575), ("gt", ">", 90000)):
    ORACLE[f"filter_amount_{_key}"] = _with(
        _TX,
        select=f"""SELECT from_bank, from_account, to_bank, to_account, amount_paid, amount_received
                   FROM tx WHERE amount_received {_op} CAST({_threshold} AS DOUBLE)""",
    )

ORACLE["two_hop_grid"] = ORACLE["join_two_hop"]
ORACLE["q4_pruned"] = ORACLE["q4_scatter_gather"]
ORACLE["q4_distinct_middle"] = _with(
    _TX, _USD,
    """
e AS (SELECT DISTINCT from_bank, from_account, to_bank, to_account FROM usd),
h AS (SELECT from_bank, from_account FROM e GROUP BY 1, 2 HAVING count(*) >= 5),
s AS (SELECT e.* FROM e JOIN h ON e.from_bank = h.from_bank AND e.from_account = h.from_account),
p AS (SELECT l.from_bank, l.from_account, r.to_bank, r.to_account
      FROM s l JOIN s r ON l.to_bank = r.from_bank AND l.to_account = r.from_account
      WHERE NOT (l.from_bank = r.to_bank AND l.from_account = r.to_account)
      GROUP BY ALL HAVING count(*) >= 4)""",
    select="""SELECT from_bank AS bank, from_account AS account FROM p
              UNION SELECT to_bank, to_account FROM p""",
)
ORACLE["join_not_broadcast"] = _with(
    _TX, _ACC, _RATES, _ASOF,
    """
b AS (SELECT from_bank, tx.payment_format FROM tx JOIN (
        SELECT payment_format, sum(amount_paid) / count(*) AS av FROM tx
        WHERE CAST(ts AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-31' GROUP BY 1) a
      ON tx.payment_format = a.payment_format WHERE amount_paid < av / 20),
g AS (SELECT from_bank, count(*) AS below FROM b GROUP BY 1),
c AS (SELECT from_bank, count(*) AS converted FROM usd_asof GROUP BY 1)""",
    select="""SELECT g.from_bank, coalesce(bank_name, 'Unknown') AS bank_name, below, converted
              FROM g JOIN c ON g.from_bank = c.from_bank
              LEFT JOIN names ON regexp_replace(g.from_bank, '^0+', '') = k""",
)
ORACLE["scan_mixed_layouts"] = """
    SELECT CASE WHEN o_orderkey % 3 < 2 THEN date_trunc('minute', o_orderdate) END AS ts,
           CAST(o_custkey AS STRING) AS from_account,
           CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey AS STRING) END AS to_account, o_totalprice AS amount_paid
    FROM orders"""
ORACLE["sink_results"] = _with(
    _TX, _USD,
    select="""SELECT from_bank, from_account, to_bank, to_account, amount_paid, client_id FROM usd
              WHERE amount_received < 2000""",
)
ORACLE["sink_chunks"] = "SELECT count(*) AS rows, true AS bounded FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

# The merged forms must equal the plain ones.
ORACLE["agg_pair_count_merge"] = ORACLE["agg_pair_count"]
ORACLE["union_averages"] = ORACLE["agg_format_avg"]

# So must the streams.
ORACLE["stream_mixed_layouts"] = ORACLE["scan_mixed_layouts"]
ORACLE["stream_q1"] = ORACLE["q1_small_usd"]
ORACLE["stream_bank_max"] = _with(_TX, _USD, select=_bank_max("usd"))
ORACLE["stream_format_avg"] = ORACLE["agg_format_avg"]
ORACLE["stream_routes"] = ORACLE["route_multi"]
ORACLE["stream_count"] = ORACLE["agg_count"]
ORACLE["stream_count_empty"] = "SELECT CAST(0 AS BIGINT) AS count, 'filtered' AS of UNION ALL SELECT 0, 'empty'"
ORACLE["stream_q2"] = ORACLE["q2_bank_max"]
ORACLE["stream_q4"] = ORACLE["q4_scatter_gather"]
ORACLE["stream_q5"] = ORACLE["q5_micro_count"]
ORACLE["stream_restart"] = ORACLE["stream_bank_max"]
ORACLE["stream_count_by_client"] = _with(
    _TX, select="SELECT client_id, count(*) AS count FROM tx GROUP BY 1"
)
ORACLE["stream_q3"] = ORACLE["q3_below_avg"]
ORACLE["stream_two_hop"] = ORACLE["join_two_hop"]
# Only messages that name their sender can be recognised as repeated; purchases do.
ORACLE["stream_dedup"] = _with(_MSG, select="SELECT * FROM msg")
ORACLE["high_mark"] = _with(
    _MSG,
    """
arrived AS (
  SELECT client_id, sender, msg_id, amount_paid, CAST(c AS INTEGER) AS copy,
         CAST(c AS BIGINT) * 1000000000000 + msg_id
         + CASE WHEN sender = 'view' AND msg_id % 5 = 0 THEN 400 ELSE 0 END AS arrival
  FROM msg JOIN (SELECT 1 AS c UNION ALL SELECT 2) ON c = 1 OR sender = 'purchase'),
marked AS (
  SELECT *, max(msg_id) OVER (PARTITION BY client_id, sender ORDER BY arrival
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM arrived)""",
    select="""SELECT client_id, sender, msg_id, amount_paid, copy, arrival FROM marked
              WHERE sender IS NULL OR mark IS NULL OR msg_id > mark""",
)
ORACLE["stream_high_mark"] = ORACLE["high_mark"]
ORACLE["stream_end_markers"] = """
    SELECT 'u' || CAST(user_id AS STRING) AS client_id,
           count(*) FILTER (WHERE event_type <> 'signup') AS count
    FROM events GROUP BY 1
    HAVING count(*) FILTER (WHERE event_type = 'signup') >= 10
       AND count(*) FILTER (WHERE event_type = 'error' AND value > 150) = 0"""


def _live(cancelled: str) -> str:
    """Walks each client through the steps: markers so far, and the step its open input began in."""
    return f"""
    WITH RECURSIVE ev AS (
        SELECT 'u' || CAST(user_id AS STRING) AS client_id, event_type, value, event_id,
            event_id * 5 // ((SELECT max(event_id) FROM events) + 1) AS step,
            event_type = 'signup' AS ends, {cancelled} AS cancels
        FROM events
    ), per_step AS (
        SELECT client_id, s.step, count(*) FILTER (ev.step = s.step AND ends) AS ends, bool_or(ev.step = s.step AND cancels) AS cancelled
        FROM ev, range(0, 5) AS s(step) GROUP BY 1, 2
    ), walk AS (
        SELECT DISTINCT client_id, CAST(-1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS ends, CAST(0 AS BIGINT) AS since,
            CAST(NULL AS BIGINT) AS given_from FROM ev
        UNION ALL
        SELECT n.client_id, n.step,
            CASE WHEN n.cancelled OR w.ends + n.ends >= 3 THEN 0 ELSE w.ends + n.ends END,
            CASE WHEN n.cancelled OR w.ends + n.ends >= 3 THEN n.step + 1 ELSE w.since END,
            CASE WHEN NOT n.cancelled AND w.ends + n.ends >= 3 THEN w.since END
        FROM walk AS w JOIN per_step AS n ON n.client_id = w.client_id AND n.step = w.step + 1
    )
    SELECT ev.client_id, event_type, count(*) AS count, round(sum(value), 4) AS value, round(max(value), 4) AS largest,
        arg_max(lpad(CAST(event_id AS STRING), 12, '0'), (value, -event_id)) AS named, walk.step
    FROM walk JOIN ev ON ev.client_id = walk.client_id AND ev.step BETWEEN given_from AND walk.step
    WHERE NOT ev.ends AND NOT cancels GROUP BY ev.client_id, event_type, walk.step"""


ORACLE["stream_live_answers"] = _live("false")
ORACLE["stream_live_tombstones"] = _live("event_type = 'error' AND value > 180")
ORACLE["stream_live_marks"] = """
    WITH deliveries AS (
        SELECT 'u' || CAST(user_id AS STRING) AS client_id, CASE WHEN event_type <> 'error' THEN event_type END AS sender,
            event_id AS msg_id, round(value, 4) AS amount_paid,
            event_id * 5 // ((SELECT max(event_id) FROM events) + 1) + copy
                + CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS step
        FROM events, range(0, 2) AS c(copy) WHERE copy = 0 OR event_type = 'purchase'
    ), tops AS (SELECT client_id, sender, step, max(msg_id) AS top FROM deliveries GROUP BY 1, 2, 3)
    SELECT * FROM deliveries AS d WHERE sender IS NULL OR msg_id > coalesce(
        (SELECT max(top) FROM tops AS t WHERE t.client_id = d.client_id AND t.sender = d.sender AND t.step < d.step), -1)"""
ORACLE["stream_all_by_client"] = ORACLE["all_queries_by_client"]
ORACLE["stream_failed_batch"] = """
    SELECT branch, count(*) AS rows, CAST(8 AS BIGINT) AS batches, CAST(2 AS BIGINT) AS batches_before, true AS fewer_before
    FROM (SELECT event_type, unnest(CASE WHEN event_type = 'error' THEN ['all'] WHEN event_type = 'purchase'
        THEN ['all', 'named', 'all', 'named'] ELSE ['all', 'named'] END) AS branch FROM events) GROUP BY 1"""

ORACLE["stream_envelopes"] = """
    WITH m AS (SELECT *, event_id // 100 AS msg_id, 'client_' || CAST(event_id // 100 % 3 AS STRING) AS client FROM events),
    n AS (SELECT DISTINCT msg_id, client FROM m)
    SELECT 'rows' AS part, client, msg_id, 'B' || CAST(user_id AS STRING) AS from_bank, value AS amount_paid,
           event_type AS payment_format
    FROM m WHERE msg_id % 7 <> 0 AND msg_id % 11 <> 0
    UNION ALL SELECT 'quarantined', client, msg_id, NULL, NULL, NULL FROM n WHERE msg_id % 7 = 0 OR msg_id % 11 = 0
    UNION ALL SELECT 'quarantined', NULL, NULL, NULL, NULL, NULL FROM n WHERE msg_id % 13 = 0
    UNION ALL SELECT 'control', client, msg_id, NULL, NULL, NULL FROM n WHERE msg_id % 17 = 0"""
ORACLE["stream_q2_two_inputs"] = _with(
    _TX, _USD, _ACC,
    select=f"""SELECT q.*, CAST(CASE client_id WHEN 'client_0' THEN 3 WHEN 'client_1' THEN 4 ELSE 5 END AS BIGINT) AS step
               FROM ({_questions('client_id, ')['q2']}) q""",
)
ORACLE["shard_export"] = _with(
    _TX,
    """
ends AS (SELECT DISTINCT from_bank, from_account FROM tx),
bytes AS (SELECT *, list_transform(string_split(from_bank || '_' || from_account, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM ends),
dealt AS (
  SELECT from_bank, from_account, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) % 7 + 1 AS INTEGER) AS shard FROM bytes)""",
    select="""SELECT shard, count(*) AS rows, count(DISTINCT (from_bank, from_account)) AS accounts,
                     round(sum(amount_paid), 2) AS paid, count(*) AS listed, true AS bounded
              FROM tx JOIN dealt USING (from_bank, from_account) GROUP BY 1""",
)
ORACLE["stream_running_totals"] = """
    WITH steps AS (
        SELECT date_trunc('day', ts) AS since, event_type,
            CAST((day(ts) - 1) // 6 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS step,
            count(*) AS n, sum(value) AS v
        FROM events GROUP BY 1, 2, 3
    )
    SELECT CAST(since AS TIMESTAMP) AS since, event_type, step, CAST(sum(n) OVER w AS BIGINT) AS count, round(sum(v) OVER w, 4) AS total
    FROM steps WINDOW w AS (PARTITION BY since, event_type ORDER BY step)"""
ORACLE["stream_standing_totals"] = """
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS since, event_type, count(*) AS count, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2"""
ORACLE["stream_stages"] = ORACLE["stages_from_config"]
ORACLE["stream_stages_two_inputs"] = ORACLE["stages_from_config"]
