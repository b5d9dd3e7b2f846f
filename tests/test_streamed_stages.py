"""A configuration of stages over streams: where it is cut, several runs, clients."""

import pytest

from flowlens.plans.stages import run_stages
from flowlens.session import run_folder
from flowlens.streaming.graphs import StreamedStages
from flowlens.streaming.ingest import stream_parquet

CONFIG = {
    "stages": [
        {"input": "in", "outputs": ["a", "b"], "strategy": {"type": "currency", "value": "US Dollar"}},
        {"input": "a", "output": "small", "strategy": [{"type": "amount"}, {"condition": "<"}, {"threshold": 50}]},
        {"input": "b", "output": "largest", "strategy": {"type": "bank_max_amount"}},
        {"input": "b", "output": "average", "strategy": {"type": "payment_format_average"}},
        {"input": "b", "output": "ends", "strategy": {"type": "account"}},
        {"input": "small", "output": "n", "strategy": {"type": "count"}},
    ]
}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_answers_after_each_run_equal_those_of_all_rows(spark, tx, tmp_path):
    source, folder, so_far = str(tmp_path / "in"), run_folder(spark, "stages"), None
    usd = {"payment_currency": "US Dollar", "from_bank": "1", "payment_format": "Wire", "from_account": "x", "to_bank": "2", "to_account": "y"}
    steps = [
        tx({**usd, "amount_received": 1.0, "amount_paid": 5.0}, {"payment_currency": "Euro"}, {**usd, "from_bank": None}),
        tx({**usd, "amount_received": 70.0, "amount_paid": 9.0, "from_account": "z"}, {**usd, "payment_format": None}),
        tx(),
    ]
    for part in steps:
        part.coalesce(1).write.mode("append").parquet(source)
        so_far = part if so_far is None else so_far.unionByName(part)
        stages = StreamedStages(CONFIG, {"in": stream_parquet(spark, source, part.schema)}, {}, folder)
        stages.run()
        found, wanted = stages.answers(spark), run_stages(CONFIG, {"in": so_far})
        assert set(found) == set(wanted) == {"largest", "average", "ends", "n"}
        assert {k: rows(v) for k, v in found.items()} == {k: rows(v) for k, v in wanted.items()}
    assert stages.rows == {"in": ["small"]} and sorted(stages.parts["in"]) == ["average", "ends", "largest"]


def test_no_input_yet(spark, tx, tmp_path):
    source, folder = str(tmp_path / "in"), run_folder(spark, "stages-none")
    tx().write.parquet(source)
    stages = StreamedStages(CONFIG, {"in": stream_parquet(spark, source, tx().schema)}, {}, folder, ["small", "n"])
    found = stages.answers(spark)
    assert found["small"].count() == 0 and found["n"].first()["count"] == 0


def test_cycles_and_unknown_names_are_errors(spark, tx):
    loop = {"stages": [{"input": "x", "output": "y"}, {"input": "y", "output": "x"}]}
    with pytest.raises(ValueError, match="cycle"):
        StreamedStages(loop, {"in": tx()}, {}, "unused", ["y"])
    with pytest.raises(ValueError, match="no stage writes"):
        StreamedStages({"stages": [{"input": "gone", "output": "y"}]}, {"in": tx()}, {}, "unused")
