"""Trains the packaged segmentation model: python tools/train_model.py <table folder>."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from custscope.operators.rfm import rfm_complete  # noqa: E402
from custscope.operators.segment import PACKAGED_MODELS, fit  # noqa: E402
from custscope.testbed import mapping  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (
        SparkSession.builder.master("local[8]").appName("train")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    )
    model = fit(rfm_complete(mapping.orders(spark, folder), mapping.AS_OF), with_silhouette=True)
    model.pipeline = None
    target = PACKAGED_MODELS / model.version
    target.mkdir(parents=True, exist_ok=True)
    (target / "params.json").write_text(model.to_json(), "utf-8")
    print(model)
