"""A configuration of stages over streams.

Stages that work row by row run in the micro-batches: one query per stream goes over its source once
and feeds every branch of the graph that needs it. Where rows have to be brought together, the graph
is cut. What lies before the cut is written batch by batch, maxima, averages and distinct accounts
as partial rows; what lies behind it is asked of the tables so far, at any time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.aggregates import average_parts
from flowlens.operators.joins import union_streams
from flowlens.plans.stages import inputs_of, producers_of, run_stages, strategy_of
from flowlens.plans.strategies import strategy
from flowlens.streaming.runs import committed, run

ROW_BY_ROW = {"none", "currency", "amount", "currency_conversion", "merge_routing", "scatter_group", "query_result", "accounts"}
#: Strategies that take their own output, or that of a partial step, as input.
IN_PARTS = {"bank_max_amount", "payment_format_average", "account"}


class StreamedStages:
    """The stages of `config` over `streams`, with tables under `sides`, in `folder`. A stage whose
    input and side inputs come from several streams is behind the cut."""

    def __init__(
        self,
        config: Mapping,
        streams: Mapping[str, DataFrame],
        sides: Mapping[str, DataFrame],
        folder: str,
        outputs: Sequence[str] | None = None,
        by: Sequence[str] = (),
    ):
        self.config, self.streams, self.sides, self.folder, self.by = config, dict(streams), dict(sides), folder, by
        self.producers, unread = producers_of(config)
        self.outputs = list(outputs) if outputs is not None else unread
        self._sources: dict[str, frozenset[str]] = {}
        #: What each stream writes: names before the cut.
        self.rows: dict[str, list[str]] = {s: [] for s in self.streams}
        self.parts: dict[str, list[str]] = {s: [] for s in self.streams}
        self._cut()

    def _sources_of(self, name: str, above: tuple[str, ...] = ()) -> frozenset[str]:
        """The streams that a name depends on."""
        if name in self.streams:
            return frozenset([name])
        if name in self.sides:
            return frozenset()
        if name not in self.producers:
            raise ValueError(f"no stage writes {name!r} and it is not an input")
        if name in above:
            raise ValueError(f"stages form a cycle: {' -> '.join([*above, name])}")
        if name not in self._sources:
            read = [n for stage, _ in self.producers[name] for n in (*inputs_of(stage), *stage.get("with", {}).values())]
            self._sources[name] = frozenset().union(*(self._sources_of(n, (*above, name)) for n in read))
        return self._sources[name]

    def _row_by_row(self, name: str) -> bool:
        if name in self.streams:
            return True
        return len(self._sources_of(name)) == 1 and all(
            (strategy_of(stage)[0] in ROW_BY_ROW or (strategy_of(stage)[0] == "count" and "threshold" in strategy_of(stage)[1]))
            and all(self._row_by_row(n) for n in inputs_of(stage))
            and not any(self._sources_of(n) for n in stage.get("with", {}).values())
            for stage, _ in self.producers[name]
        )

    def _in_parts(self, name: str) -> bool:
        made = self.producers[name]
        if len(made) != 1 or made[0][1] is not None or len(self._sources_of(name)) != 1:
            return False
        stage = made[0][0]
        return strategy_of(stage)[0] in IN_PARTS and not stage.get("with") and all(self._row_by_row(n) for n in inputs_of(stage))

    def _cut(self) -> None:
        waiting, seen = list(self.outputs), set()
        while waiting:
            name = waiting.pop()
            if name in seen or not self._sources_of(name):
                continue
            seen.add(name)
            if self._row_by_row(name) or self._in_parts(name):
                (source,) = self._sources_of(name)
                (self.rows if self._row_by_row(name) else self.parts)[source].append(name)
            else:
                waiting += [n for stage, _ in self.producers[name] for n in (*inputs_of(stage), *stage.get("with", {}).values())]

    def _before(self, source: str, rows: DataFrame) -> dict[str, DataFrame]:
        """What is written of some rows of a stream."""
        stages = {name: self.producers[name][0][0] for name in self.parts[source]}
        asked = {n for stage in stages.values() for n in inputs_of(stage)}
        built = run_stages(self.config, {**self.sides, source: rows}, [*self.rows[source], *asked], self.by)
        out = {name: built[name] for name in self.rows[source]}
        for name, stage in stages.items():
            (kind, params), df = strategy_of(stage), union_streams(*(built[n] for n in inputs_of(stage)))
            out[name] = average_parts(df, by=self.by) if kind == "payment_format_average" else strategy(kind)(df, {}, params, self.by)
        return out

    def run(self) -> None:
        """Takes in what is available of every stream; to be called again when there is more."""
        for source, stream in self.streams.items():
            if self.rows[source] or self.parts[source]:
                run(stream, f"{self.folder}/{source}", lambda batch, _, s=source: self._before(s, batch), atomic=True)

    def answers(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The outputs over all whole micro-batches so far."""
        tables = dict(self.sides)
        for source, stream in self.streams.items():
            for name, nothing in self._before(source, spark.createDataFrame([], stream.schema)).items():
                tables[name] = committed(spark, f"{self.folder}/{source}", name, nothing.schema).select(*nothing.columns)
                if name in self.parts[source]:
                    kind, params = strategy_of(self.producers[name][0][0])
                    tables[name] = strategy(kind)(tables[name], {}, params, self.by)
        return run_stages(self.config, tables, self.outputs, self.by)
