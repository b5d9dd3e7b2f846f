"""Queries wired from a declarative configuration.

A stage names its `input` (or a list to be united), its `output` (or several `outputs` that
all get the same rows), side inputs under `with`, and either one `strategy` or `routes`:

    stages:
      - input: transactions
        outputs: [usd_q1, usd_dates]
        strategy: {type: currency, value: US Dollar}
      - input: usd_dates
        routes:
          - name: historic
            output: history
            filters: [{type: date_range, from: 2022-09-01, to: 2022-09-05}]

A strategy may also be a list of one-entry mappings. Order of the stages does not matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from flowlens.functions.predicates import all_of
from flowlens.operators.joins import union_streams
from flowlens.plans.strategies import strategy


def load_config(path: str) -> dict[str, Any]:
    """A configuration from a YAML file (needs PyYAML; a plain dict needs nothing)."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs PyYAML; pass a dict instead") from error
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def _names(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def _parameters(spec: Mapping[str, Any] | Sequence[Mapping[str, Any]] | None) -> dict[str, Any]:
    entries = [spec] if isinstance(spec, Mapping) else list(spec or [])
    return {key: value for entry in entries for key, value in entry.items()}


Producers = dict[str, list[tuple[Mapping[str, Any], Mapping[str, Any] | None]]]


def producers_of(config: Mapping[str, Any]) -> tuple[Producers, list[str]]:
    """The stages, with the route if there is one, that write each name; and the names that no
    other stage reads."""
    producers: Producers = {}
    read: set[str] = set()
    for stage in config["stages"]:
        if stage.get("output") or stage.get("outputs"):
            for name in _names(stage.get("output")) + _names(stage.get("outputs")):
                producers.setdefault(name, []).append((stage, None))
        for route in stage.get("routes", ()):
            producers.setdefault(route["output"], []).append((stage, route))
        read.update(_names(stage["input"]), stage.get("with", {}).values())
    return producers, [n for n in producers if n not in read]


def strategy_of(stage: Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
    """Name and parameters of a stage's strategy."""
    params = _parameters(stage.get("strategy"))
    return params.get("type", "none"), params


def inputs_of(stage: Mapping[str, Any]) -> list[str]:
    return _names(stage["input"])


def run_stages(
    config: Mapping[str, Any],
    inputs: Mapping[str, DataFrame],
    outputs: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """DataFrames for `outputs`, or for every output no other stage reads. Only what they
    depend on is built."""
    producers, unread = producers_of(config)
    built: dict[str, DataFrame] = dict(inputs)
    open_names: list[str] = []

    def resolve(name: str) -> DataFrame:
        if name in built:
            return built[name]
        if name not in producers:
            raise ValueError(f"no stage writes {name!r} and it is not an input")
        if name in open_names:
            raise ValueError(f"stages form a cycle: {' -> '.join([*open_names, name])}")
        open_names.append(name)
        built[name] = union_streams(*(apply(stage, route) for stage, route in producers[name]))
        open_names.pop()
        return built[name]

    def apply(stage: Mapping[str, Any], route: Mapping[str, Any] | None) -> DataFrame:
        df = union_streams(*(resolve(n) for n in inputs_of(stage)))
        kind, params = strategy_of(stage)
        side = {key: resolve(name) for key, name in stage.get("with", {}).items()}
        df = strategy(kind)(df, side, params, by)
        return df if route is None else df.where(all_of(route.get("filters", ())))

    wanted = list(outputs) if outputs is not None else unread
    return {name: resolve(name) for name in wanted}
