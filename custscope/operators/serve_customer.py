"""Questions about one customer, computed for all customers at once.

Every operator takes an optional `customer`, which is pushed into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custscope.functions.guards import bounded_int
from custscope.functions.labels import day_text, second_text, share
from custscope.operators.flatten import known_products
from custscope.schema import NON_PRODUCT_SKUS
from custscope.sources.staging import stage

MIN_TOGETHER = 2
STRONG_PAIR = 0.30


def _one(df: DataFrame, customer: str | None) -> DataFrame:
    return df if customer is None else df.where(F.col("cliente_id") == customer)


def _top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """First rows per customer; the rank limit also runs before the shuffle."""
    if limit is None:
        return df
    rank = F.row_number().over(Window.partitionBy("cliente_id").orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def find_customers(segments: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Ids that contain the text in any case; % and _ act as wildcards."""
    if not text:
        raise ValueError("the search text is empty")
    bounded_int("limit", limit, 1, 50)
    return (
        segments.where(F.col("cliente_id").ilike(f"%{text}%"))
        .select("cliente_id").distinct().orderBy("cliente_id").limit(limit)
    )


def profile(segments: DataFrame, customer: str | None = None) -> DataFrame:
    return _one(segments, customer).select(
        "cliente_id", "recency", "frequency", "monetary", "dias_entre_compras", "es_single_buyer",
        F.col("cluster_id").alias("cluster"), F.col("segmento_cluster").alias("segmento"),
    )


def order_history(orders: DataFrame, items: DataFrame, customer: str | None = None) -> DataFrame:
    """Every order with its units, charges left out; an order without lines has 0 units.

    In order of time for one customer. For all customers the rows are in no order: sorting every order there is would
    serve nobody.
    """
    is_product = ~F.col("clave").isin(NON_PRODUCT_SKUS)
    units = (
        _one(items, customer).groupBy("order_id")
        .agg(F.sum(F.when(is_product, F.col("cantidad"))).alias("unidades"))
    )
    history = (
        _one(orders, customer).join(units, "order_id", "left")
        .select(
            "cliente_id", "order_id", second_text(F.col("fecha")).alias("fecha"), "pago_total", "num_productos",
            F.coalesce("unidades", F.lit(0.0)).alias("unidades_totales"),
        )
    )
    return history if customer is None else history.orderBy("fecha", "order_id")


def position_in_segment(segments: DataFrame, customer: str) -> DataFrame:
    """All customers of the target's segment, the target flagged."""
    # max() gives NULL, hence no rows, for an unknown id; ids are unique, so it picks nothing.
    own = segments.where(F.col("cliente_id") == customer).agg(F.max("segmento_cluster")).scalar()
    return segments.where(F.col("segmento_cluster") == own).select(
        "cliente_id", "recency", "monetary", (F.col("cliente_id") == customer).alias("es_objetivo")
    )


def top_products(items: DataFrame, customer: str | None = None, limit: int | None = 10) -> DataFrame:
    per_family = (
        known_products(_one(items, customer)).where(F.col("familia").isNotNull())
        .groupBy("cliente_id", "familia").agg(
            F.count_distinct("order_id").alias("n_pedidos"),
            F.sum("cantidad").alias("unidades_totales"),
            F.sum("subtotal_mxn").alias("revenue_total"),
            day_text(F.max("fecha")).alias("ultima_compra"),
        )
    )
    return _top(per_family, limit, F.desc_nulls_last("revenue_total"), F.asc("familia"))


def _order_families(items: DataFrame, customer: str | None) -> DataFrame:
    """(cliente_id, order_id, familias): the distinct known families of each order."""
    families = (
        known_products(_one(items, customer)).where(F.col("familia").isNotNull() & F.col("cliente_id").isNotNull())
        .groupBy("cliente_id", "order_id").agg(F.collect_set("familia").alias("familias"))
    )
    return _written(families, "order-families", customer)


def _written(df: DataFrame, name: str, customer: str | None) -> DataFrame:
    """All customers: written once, since several joins read it. One customer: a few rows, left lazy.

    Reading a table also puts a shuffle of its own under each join. Adaptive execution splits a
    customer with very many orders only then; a join placed right on an aggregate is left whole.
    """
    return stage(df, name) if customer is None else df


def _pairs(baskets: DataFrame, customer: str | None) -> DataFrame:
    """Family pairs a < b that a customer bought together in two or more orders.

    Columns: n_ordenes (orders with both), n_a and n_b (orders with each). A pair seen twice
    needs both families seen twice, so a customer's rarer families are dropped before any pair is
    built. The count of a family meets the orders by customer and family, a far finer key than the
    customer, and each order builds pairs from its own list only; pairs are counted map-side.
    """
    lines = baskets.select("cliente_id", "order_id", F.explode("familias").alias("familia"))
    repeated = lines.groupBy("cliente_id", "familia").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TOGETHER)
    kept = (
        lines.join(_written(repeated, "repeated", customer), ["cliente_id", "familia"])
        .groupBy("cliente_id", "order_id").agg(F.sort_array(F.collect_list(F.struct("familia", "n"))).alias("_f"))
        .where(F.size("_f") > 1)
    )
    pairs = kept.select("cliente_id", "_f", F.posexplode("_f").alias("_i", "_a")).select(
        "cliente_id", "_a", F.explode(F.slice("_f", F.col("_i") + 2, F.size("_f"))).alias("_b"))
    return (
        pairs.select(
            "cliente_id", F.col("_a.familia").alias("familia_a"), F.col("_b.familia").alias("familia_b"),
            F.col("_a.n").alias("n_a"), F.col("_b.n").alias("n_b"))
        .groupBy("cliente_id", "familia_a", "familia_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n_ordenes"))
        .where(F.col("n_ordenes") >= MIN_TOGETHER)
    )


def own_bundles(
    items: DataFrame,
    segments: DataFrame,
    actionable: DataFrame,
    customer: str | None = None,
    limit: int | None = 10,
) -> DataFrame:
    """Pairs a customer repeats, with the matching 1→1 rule of the customer's segment."""
    baskets = _order_families(items, customer)
    pairs = _top(
        _pairs(baskets, customer), limit,
        F.desc("n_ordenes"), F.asc("familia_a"), F.asc("familia_b"),
    )
    totals = baskets.groupBy("cliente_id").agg(F.count(F.lit(1)).alias("_orders"))
    rules = actionable.where(~F.contains(F.col("consequents"), F.lit(","))).select(
        F.col("segmento").alias("segmento_cluster"),
        F.least("antecedents", "consequents").alias("familia_a"),
        F.greatest("antecedents", "consequents").alias("familia_b"),
        F.col("confidence").alias("confidence_segmento"),
        F.col("lift").alias("lift_segmento"),
    )
    return (
        pairs.join(totals, "cliente_id")
        .join(_one(segments, customer).select("cliente_id", "segmento_cluster"), "cliente_id", "left")
        .join(rules, ["segmento_cluster", "familia_a", "familia_b"], "left")
        .select(
            "cliente_id", "familia_a", "familia_b", "n_ordenes", "confidence_segmento", "lift_segmento",
            share(F.col("n_ordenes"), F.col("_orders")).alias("pct_aparicion"),
        )
    )


def strong_pairs(baskets: DataFrame, customer: str | None = None) -> DataFrame:
    """Pairs that occur together in at least 30 % of the orders of their rarer family."""
    return (
        _pairs(baskets, customer)
        .withColumn("co_occurrence", F.col("n_ordenes") / F.least("n_a", "n_b"))
        .where(F.col("co_occurrence") >= STRONG_PAIR)
        .select("cliente_id", "familia_a", "familia_b", "co_occurrence")
    )


def missed_opportunities(
    items: DataFrame, orders: DataFrame, customer: str | None = None, limit: int | None = 10
) -> DataFrame:
    """Orders with exactly one family of a strong pair, the most expensive first.

    Each order looks up the strong pairs of a family it holds and keeps those whose other family
    it lacks; no order is ever paired with a bundle it does not touch.
    """
    baskets = _order_families(items, customer)
    strong = strong_pairs(baskets, customer)
    lookup = strong.select(
        "cliente_id", "co_occurrence",
        F.inline(F.array(
            F.struct(F.col("familia_a").alias("compro"), F.col("familia_b").alias("le_falto")),
            F.struct(F.col("familia_b").alias("compro"), F.col("familia_a").alias("le_falto")),
        )),
    )
    priced = baskets.join(
        _one(orders, customer).select("cliente_id", "order_id", "fecha", "pago_total"), ["cliente_id", "order_id"]
    )
    found = (
        priced.withColumn("compro", F.explode("familias"))
        .join(lookup, ["cliente_id", "compro"])
        .where(~F.array_contains("familias", F.col("le_falto")))
        .select(
            "cliente_id", "order_id", second_text(F.col("fecha")).alias("fecha"), "pago_total",
            "compro", "le_falto", "co_occurrence",
        )
    )
    return _top(
        found, limit, F.desc_nulls_last("pago_total"), F.asc("order_id"), F.asc("compro"), F.asc("le_falto")
    )
