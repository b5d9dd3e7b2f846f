import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "flowlens-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TX_FIELDS = (
    "ts", "from_bank", "from_account", "to_bank", "to_account", "amount_received",
    "receiving_currency", "amount_paid", "payment_currency", "payment_format",
)


@pytest.fixture(scope="session")
def tx(spark):
    """Builds transactions from partial dicts; what is left out is NULL."""
    import datetime

    from flowlens.schema import TRANSACTIONS

    def build(*rows):
        def value(row, field):
            v = row.get(field)
            return datetime.datetime.fromisoformat(v) if field == "ts" and isinstance(v, str) else v

        return spark.createDataFrame([tuple(value(r, f) for f in TX_FIELDS) for r in rows], TRANSACTIONS)

    return build


@pytest.fixture(scope="session")
def edges(spark):
    """Transactions from (origin, destination) pairs of account names, all at bank b."""

    def build(pairs, client=None):
        rows = [("b", a, "b", c) for a, c in pairs]
        return spark.createDataFrame(
            rows, "from_bank string, from_account string, to_bank string, to_account string"
        )

    return build
