import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from order_rows import REF  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def ref():
    return REF


@pytest.fixture
def make_orders(spark):
    """Rows of (cliente_id, fecha, pago_total[, order_id]) as an order table."""
    def make(rows):
        full = [(r[3] if len(r) > 3 else f"O{i:05d}", r[0], r[1], float(r[2])) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "order_id string, cliente_id string, fecha timestamp, pago_total double")

    return make
