"""Wiring of declarative stages."""

import pytest

from flowlens.plans.stages import load_config, run_stages
from flowlens.plans.strategies import STRATEGIES, strategy

USD = {"payment_currency": "US Dollar"}


def test_order_lists_and_fan_out(tx):
    config = {
        "stages": [
            {"input": "usd_a", "output": "small", "strategy": [{"type": "amount"}, {"condition": "<"}, {"threshold": 50}]},
            {"input": "in", "outputs": ["usd_a", "usd_b"], "strategy": {"type": "currency", "value": "US Dollar"}},
            {"input": "usd_b", "output": "n", "strategy": {"type": "count"}},
        ]
    }
    df = tx({**USD, "amount_received": 1.0}, {**USD, "amount_received": 70.0}, {"payment_currency": "Euro"})
    out = run_stages(config, {"in": df})
    assert set(out) == {"small", "n"}
    assert out["small"].count() == 1 and out["n"].first()["count"] == 2
    assert set(run_stages(config, {"in": df}, outputs=["usd_a"])) == {"usd_a"}


def test_routes_and_united_inputs(tx):
    day = {"type": "date_range", "from": "2022-09-01", "to": "2022-09-01"}
    config = {
        "stages": [
            {
                "input": "in",
                "routes": [{"name": "a", "output": "x", "filters": [day]}, {"name": "b", "output": "y"}],
            },
            {"input": ["x", "y"], "output": "all"},
        ]
    }
    df = tx({"ts": "2022-09-01T10:00"}, {"ts": "2022-09-02T10:00"})
    assert run_stages(config, {"in": df})["all"].count() == 3


def test_partial_and_final_steps_chain(tx):
    kinds = ["bank_max_amount", "payment_format_average", "account_pair_count", "account"]
    df = tx(*[{"from_bank": "1", "to_bank": "2", "from_account": "a", "to_account": "b", "amount_paid": 2.0}] * 5)
    for kind in kinds:
        config = {
            "stages": [
                {"input": "in", "output": "partial", "strategy": {"type": kind}},
                {"input": "partial", "output": "final", "strategy": {"type": kind}},
            ]
        }
        out = run_stages(config, {"in": df}, outputs=["partial", "final"])
        assert sorted(map(tuple, out["partial"].collect()), key=str) == sorted(
            map(tuple, out["final"].collect()), key=str
        )


def test_having_against_row_count(spark):
    df = spark.createDataFrame([(5,), (6,)], "count bigint")
    assert STRATEGIES["count"](df, {}, {"condition": ">", "threshold": 5}, ()).count() == 1
    assert STRATEGIES["none"](df, {}, {}, ()) is df


def test_mistakes_are_named(tx):
    with pytest.raises(ValueError, match="unknown strategy"):
        strategy("nope")
    with pytest.raises(ValueError, match="cycle"):
        run_stages(
            {"stages": [{"input": "a", "output": "b"}, {"input": "b", "output": "a"}]}, {}, outputs=["a"]
        )
    with pytest.raises(ValueError, match="no stage writes"):
        run_stages({"stages": []}, {}, outputs=["a"])


def test_yaml_file(tx, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "stages.yaml"
    path.write_text(
        "stages:\n"
        "  - input: in\n"
        "    routes:\n"
        "      - name: early\n"
        "        output: early\n"
        "        filters:\n"
        "          - {type: date_range, from: 2022-09-01, to: 2022-09-05}\n"
        "          - {type: payment_format_in, values: [Wire]}\n"
    )
    df = tx({"ts": "2022-09-05T10:00", "payment_format": "Wire"}, {"ts": "2022-09-05T10:00", "payment_format": "ACH"})
    assert run_stages(load_config(str(path)), {"in": df})["early"].count() == 1
