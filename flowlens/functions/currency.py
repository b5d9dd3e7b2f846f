"""Currency names as they occur in transactions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

BASE_CURRENCY = "US Dollar"
BASE_CODE = "USD"

# Currency name -> ISO code. Bitcoin has no official rate and is absent.
CURRENCY_CODES = {
    "Euro": "EUR",
    "UK Pound": "GBP",
    "Australian Dollar": "AUD",
    "Canadian Dollar": "CAD",
    "Yen": "JPY",
    "Yuan": "CNY",
    "Swiss Franc": "CHF",
    "Ruble": "RUB",
    "Rupee": "INR",
    "Mexican Peso": "MXN",
    "Saudi Riyal": "SAR",
    "Shekel": "ILS",
    "Brazil Real": "BRL",
}


def currency_code(name: Column) -> Column:
    """ISO code, NULL for a currency outside the table. A constant map, so no join."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(CURRENCY_CODES.items())))
    return table[name]
