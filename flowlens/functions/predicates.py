"""Row predicates, directly or from a typed specification such as
``{"type": "date_range", "from": "2022-09-01", "to": "2022-09-05"}``."""

from __future__ import annotations

import datetime
import operator
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": operator.lt,
    "=": operator.eq,
    ">": operator.gt,
}


def compares(col: Column, op: str, threshold: float | int) -> Column:
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}, expected one of {sorted(_COMPARE)}")
    return _COMPARE[op](col, F.lit(threshold))


def currency_is(currency: str) -> Column:
    return F.col("payment_currency") == F.lit(currency)


def amount_compares(op: str, threshold: float, column: str = "amount_received") -> Column:
    """The amount compared is the one received, not the one paid."""
    return compares(F.col(column), op, float(threshold))


def count_compares(op: str, threshold: int, column: str = "count") -> Column:
    """HAVING on a pre-aggregated count; a missing count is zero."""
    return compares(F.coalesce(F.col(column), F.lit(0)), op, int(threshold))


def format_in(formats: Iterable[str]) -> Column:
    return F.col("payment_format").isin(list(formats))


def plain_date(value: str | datetime.date) -> datetime.date:
    """A bound as a date. A time of day has no place in a range of whole days and is refused."""
    if isinstance(value, datetime.datetime) or not isinstance(value, (str, datetime.date)):
        raise ValueError(f"not a plain date: {value!r}")
    return datetime.date.fromisoformat(value) if isinstance(value, str) else value


def date_between(first: str | datetime.date, last: str | datetime.date, column: str = "ts") -> Column:
    """Both ends inclusive. Written on the date, which Catalyst turns into a half-open
    range on the timestamp itself, so it still reaches the file scan."""
    return F.to_date(F.col(column)).between(F.lit(plain_date(first)), F.lit(plain_date(last)))


@dataclass(frozen=True)
class RowFilter:
    """A condition on rows as configurations write it. Subclasses name their fields; a field that is
    missing, unknown or of a wrong kind is an error when the filter is made, not when it runs."""

    def column(self) -> Column:
        raise NotImplementedError

    @classmethod
    def read(cls, spec: Mapping[str, Any]) -> RowFilter:
        own = {cls.field_of(name): value for name, value in spec.items() if name != "type"}
        wanted = {f.name for f in fields(cls)}
        if own.keys() != wanted:
            raise ValueError(f"{cls.__name__} takes {sorted(wanted)}, not {sorted(own)}")
        return cls(**own)

    @staticmethod
    def field_of(name: str) -> str:
        """`from` and `to` cannot be names of fields."""
        return {"from": "first", "to": "last"}.get(name, name)


@dataclass(frozen=True)
class Currency(RowFilter):
    value: str

    def column(self) -> Column:
        return currency_is(self.value)


@dataclass(frozen=True)
class DateRange(RowFilter):
    first: str | datetime.date
    last: str | datetime.date

    def __post_init__(self):
        if plain_date(self.first) > plain_date(self.last):
            raise ValueError(f"the range ends before it begins: {self.first} to {self.last}")

    def column(self) -> Column:
        return date_between(self.first, self.last)


@dataclass(frozen=True)
class Formats(RowFilter):
    values: Sequence[str]

    def __post_init__(self):
        if isinstance(self.values, str):
            raise ValueError("values is a list of formats")

    def column(self) -> Column:
        return format_in(self.values)


@dataclass(frozen=True)
class Amount(RowFilter):
    condition: str
    threshold: float

    def column(self) -> Column:
        return amount_compares(self.condition, self.threshold)


@dataclass(frozen=True)
class Count(RowFilter):
    condition: str
    threshold: int

    def column(self) -> Column:
        return count_compares(self.condition, self.threshold)


# The names are those configurations use and thereby fixed values.
KINDS: dict[str, type[RowFilter]] = {
    "currency": Currency, "date_range": DateRange, "payment_format_in": Formats, "amount": Amount, "count": Count,
}


def predicate(spec: Mapping[str, Any]) -> Column:
    """The condition of a specification with its kind under `type`."""
    kind = KINDS.get(spec.get("type", ""))
    if kind is None:
        raise ValueError(f"unknown filter {spec.get('type')!r}; there are {', '.join(KINDS)}")
    return kind.read(spec).column()


def all_of(specs: Iterable[Mapping[str, Any]]) -> Column:
    """Conjunction; no filters at all match every row."""
    return reduce(operator.and_, map(predicate, specs), F.lit(True))
