"""Times the headline operators: one JSON line, warm session, median of three runs.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_COPIES replicates the rows (each copy
with its own keys) to show scaling. As in the published step timings, every operator starts from
stored order, line and segment tables; writing those once is reported as `prepare`, outside the
total. Rule operators start from the stored rules of the step before them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from custscope.operators import basket, explore, flatten, rfm, season, segment  # noqa: E402
from custscope.operators import serve_customer as customer  # noqa: E402
from custscope.operators import serve_segments as segs  # noqa: E402
from custscope.sources import tables  # noqa: E402
from custscope.sources.staging import stage  # noqa: E402
from custscope.testbed import catalog  # noqa: E402
from custscope.testbed import mapping as m  # noqa: E402


def replicate(df: DataFrame, copies: int, keys: list[str]) -> DataFrame:
    if copies == 1:
        return df
    many = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return many.withColumns({k: F.concat_ws("-", k, F.col("_copy").cast("string")) for k in keys}).drop("_copy")


def steps(spark: SparkSession, folder: str, copies: int):
    """Name and builder of each timed step, in pipeline order."""
    # The input is one file with one row group. The store holds a table in many files, one for each core at least, so
    # that is how the steps find theirs, at every size.
    files = spark.sparkContext.defaultParallelism
    orders = stage(replicate(m.orders(spark, folder), copies, ["order_id", "cliente_id"]).repartition(files), "orders")
    items = stage(replicate(m.items(spark, folder), copies, ["order_id", "cliente_id"]).repartition(files), "items")
    proxy = stage(replicate(m.proxy_segments(spark, folder), copies, ["cliente_id"]), "proxy")
    scored = stage(segment.segment_customers(orders, None, m.AS_OF), "scored")
    products = flatten.drop_non_products(items)
    limits = catalog.FAMILY_RULES

    def mined():
        baskets = basket.multi_family_baskets(items, proxy)
        return basket.one_rule_per_pair(
            basket.frequent_itemsets(baskets, limits["min_count"], limits["min_pct"]),
            limits["min_confidence"], limits["min_lift"],
        )

    rules = stage(mined(), "rules")
    valued = stage(basket.actionable_rules(rules, products, orders), "valued")
    windowed = season.orders_in_window(orders, m.AS_OF)
    old, new = catalog.two_batches(orders)
    return {
        "rfm_complete": lambda: rfm.rfm_complete(orders, m.AS_OF),
        "segmentos": lambda: segment.segment_customers(orders, None, m.AS_OF),
        "segment_frontier": lambda: segment.score_with_frontier(
            scored.select("cliente_id", *segment.FEATURES, "es_single_buyer"), segment.SegmentModel.packaged()),
        "baskets_multi_family": lambda: basket.multi_family_baskets(items, proxy),
        "mba_por_segmento": mined,
        "mba_accionables": lambda: basket.actionable_rules(rules, products, orders),
        "temp_hora_dia": lambda: season.hour_by_weekday(windowed, proxy),
        "temp_mensual": lambda: season.monthly(windowed, proxy),
        "temp_diario": lambda: season.daily(orders, proxy, m.AS_OF),
        "temp_bundles": lambda: season.bundles_by_month(windowed, proxy, products, valued),
        "upsert_orders": lambda: tables.merge_keep_last(old, new, ["order_id"], ["secuencia"]),
        "kpis_globales": lambda: segs.global_kpis(scored),
        "resumen_por_segmento": lambda: segs.segment_summary(scored),
        "clientes_urgentes": lambda: segs.urgent_customers(scored),
        "pareto": lambda: explore.pareto(scored),
        "cliente_productos_top": lambda: customer.top_products(items),
        "cliente_bundles": lambda: customer.own_bundles(items, proxy, valued),
        "cliente_oportunidades": lambda: customer.missed_opportunities(items, orders),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # Tables of a few megabytes would otherwise be merged into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    start = time.perf_counter()
    timed = steps(spark, folder, copies)
    prepare = round(time.perf_counter() - start, 3)
    timings = {}
    for name, build in timed.items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        # The first run warms the code paths and is left out.
        timings[name] = round(statistics.median(seconds[1:] or seconds), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": Path(folder).name.removeprefix("sf"), "copies": copies, "prepare": prepare,
    }))


if __name__ == "__main__":
    main()
