"""Row types of the two input tables, the rates and the five results."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STR, _DBL, _LONG = T.StringType(), T.DoubleType(), T.LongType()

# The fields of rows and answers, which whoever reads the answers relies on.
TRANSACTIONS = _struct(
    ts=T.TimestampNTZType(),
    from_bank=_STR,
    from_account=_STR,
    to_bank=_STR,
    to_account=_STR,
    amount_received=_DBL,
    receiving_currency=_STR,
    amount_paid=_DBL,
    payment_currency=_STR,
    payment_format=_STR,
)
ACCOUNTS = _struct(
    bank_name=_STR, bank_id=_STR, account_number=_STR, entity_id=_STR, entity_name=_STR
)
RATES = _struct(rate_date=T.DateType(), code=_STR, rate=_DBL)

# An account is known by its bank and its number.
FROM = ("from_bank", "from_account")
TO = ("to_bank", "to_account")

RESULTS = {
    "q1": _struct(
        from_bank=_STR, from_account=_STR, to_bank=_STR, to_account=_STR, amount_paid=_DBL
    ),
    "q2": _struct(from_bank=_STR, from_account=_STR, bank_name=_STR, amount_paid=_DBL),
    "q3": _struct(from_bank=_STR, from_account=_STR, payment_format=_STR, amount_paid=_DBL),
    "q4": _struct(bank=_STR, account=_STR),
    "q5": _struct(count=_LONG),
}

# A result row without a count stands for a count of nothing.
RESULT_DEFAULTS = {"count": 0}

# Header names of the input files and the fields they fill.
TRANSACTION_COLUMNS = {
    "Timestamp": "timestamp",
    "From Bank": "from_bank",
    "Account": "from_account",
    "To Bank": "to_bank",
    "Account.1": "to_account",
    "Amount Received": "amount_received",
    "Receiving Currency": "receiving_currency",
    "Amount Paid": "amount_paid",
    "Payment Currency": "payment_currency",
    "Payment Format": "payment_format",
}
ACCOUNT_COLUMNS = {
    "Bank Name": "bank_name",
    "Bank ID": "bank_id",
    "Account Number": "account_number",
    "Entity ID": "entity_id",
    "Entity Name": "entity_name",
}
