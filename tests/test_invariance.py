"""Answers must not depend on how Spark partitions or joins."""

import os

import pytest

from flowlens.operators.validate import same_multiset
from flowlens.plans import questions
from flowlens.sources import sample_views as views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

PARAMETERS = questions.Parameters(
    small_amount=5000,
    history=("1995-01-01", "1997-12-31"),
    candidates=("1998-01-01", "2001-12-31"),
    divisor=10,
    scatter=("1995-01-01", "2001-12-31"),
    min_paths=40,
    micro=("1995-01-01", "2001-12-31"),
    micro_amount=5000,
    as_of_rates=True,
)


def answers(spark, partitions):
    tx = views.transactions(spark, FOLDER).repartition(partitions)
    return questions.answer_all(tx, views.accounts(spark, FOLDER), views.rates(spark, FOLDER), PARAMETERS)


@pytest.fixture(scope="module")
def usual(spark):
    return {name: df.cache() for name, df in answers(spark, 4).items()}


@pytest.mark.parametrize(
    "partitions, conf",
    [
        (1, {"spark.sql.shuffle.partitions": "1"}),
        (13, {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.enabled": "false"}),
        (3, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "false"}),
    ],
)
def test_answers(spark, usual, monkeypatch, partitions, conf):
    from flowlens.operators import fx, graph, joins, sizing

    if "spark.sql.autoBroadcastJoinThreshold" in conf:
        for module in (fx, graph, joins):
            monkeypatch.setattr(module, "pin_if_small", lambda df, *rest: sizing.pin_if_small(df, 0))
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        for name, df in answers(spark, partitions).items():
            assert usual[name].count() > 0
            assert same_multiset(df, usual[name]), name
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
