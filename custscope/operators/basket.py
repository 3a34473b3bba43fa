"""Market-basket rules per segment: baskets, frequent sets, rules and their money value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custscope.functions.guards import require_columns
from custscope.functions.labels import item_label, rule_items
from custscope.functions.ordered import exact_quantiles
from custscope.operators.flatten import drop_non_products
from custscope.schema import NON_PRODUCT_SKUS, RULES
from custscope.sources.staging import stage

MIN_SUPPORT_COUNT = 30
MIN_SUPPORT_PCT = 0.001
MIN_CONFIDENCE = 0.20
MIN_LIFT = 3.0
TOP_ACTIONABLE = 30

_ITEMSETS = "segmento string, items array<string>, freq bigint, n_pedidos bigint"


def order_families(items: DataFrame) -> DataFrame:
    """Distinct families per order. collect_set combines map-side, so an order with very many
    lines reaches the shuffle with at most one entry per family of the catalogue."""
    return (
        items.where(F.col("familia").isNotNull())
        .groupBy("order_id", "cliente_id").agg(F.collect_set("familia").alias("familias"))
    )


def multi_family_baskets(
    items: DataFrame, segments: DataFrame, ignore: Sequence[str] = tuple(NON_PRODUCT_SKUS)
) -> DataFrame:
    """Orders with two or more families, with the segment of their customer."""
    require_columns(items, ["order_id", "clave", "cliente_id", "familia"], "items")
    require_columns(segments, ["cliente_id", "segmento_cluster"], "segments")
    return (
        order_families(drop_non_products(items, ignore))
        .where(F.size("familias") > 1)
        .join(segments.select("cliente_id", F.col("segmento_cluster").alias("segmento")), "cliente_id")
        .select("order_id", "cliente_id", "segmento", F.sort_array("familias").alias("familias"))
    )


def support_thresholds(
    baskets: DataFrame, min_count: int = MIN_SUPPORT_COUNT, min_pct: float = MIN_SUPPORT_PCT, weight: str | None = None
) -> DataFrame:
    """Baskets and the count an item set needs, per segment; small segments are left out. `weight` counts equal baskets."""
    n = F.col("n_pedidos")
    return (
        baskets.groupBy("segmento").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n_pedidos"))
        .withColumn("umbral", F.greatest(F.lit(min_count).cast("bigint"), F.floor(F.lit(float(min_pct)) * n)))
        .withColumn("se_omite", n < 2 * min_count)
    )


def frequent_itemsets(
    baskets: DataFrame, min_count: int = MIN_SUPPORT_COUNT, min_pct: float = MIN_SUPPORT_PCT,
) -> DataFrame:
    """Item sets of every size that reach their segment's threshold, grown like FP-Growth's, for all segments at once.

    A row stands for equal baskets: a set found so far, the items that may still join it, and how many baskets. Items are
    ordered by their count, the rarest first, so the many baskets of a frequent item have few items left behind it and fall
    together. A round counts the items behind each set, keeps those that reach the threshold, and grows each set by
    each of them. Counts combine map-side, no group is gathered anywhere, and there are at most as many rounds as the
    largest set has items.
    """
    spark = baskets.sparkSession
    equal = stage(
        baskets.groupBy("segmento", F.sort_array("familias").alias("_rest")).agg(F.count(F.lit(1)).alias("_n")), "baskets")
    sizes = stage(
        support_thresholds(equal, min_count, min_pct, "_n").where(~F.col("se_omite")).drop("se_omite"),
        "thresholds")
    if equal.where(F.size(F.array_distinct("_rest")) < F.size("_rest")).limit(1).count():
        raise ValueError("a basket names an item twice")
    rows = equal.join(sizes, "segmento").select(
        "segmento", "umbral", "n_pedidos", F.expr("cast(array() as array<string>)").alias("_set"), "_rest", "_n")
    found = spark.createDataFrame([], _ITEMSETS)
    keys = ["segmento", "_set"]
    while True:
        counts = rows.select("segmento", "umbral", "n_pedidos", "_set", F.explode("_rest").alias("_item"), "_n").groupBy(
            *keys, "_item").agg(F.sum("_n").alias("freq"), F.first("umbral").alias("umbral"), F.first("n_pedidos").alias("n_pedidos"))
        level = stage(counts.where(F.col("freq") >= F.col("umbral")).drop("umbral"), "itemsets-level")
        if level.isEmpty():
            break
        found = found.unionByName(level.select(
            "segmento", F.sort_array(F.concat("_set", F.array("_item"))).alias("items"), "freq", "n_pedidos"))
        # At most the items of the catalogue behind each set, in the order in which they may join it.
        allowed = level.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("freq", "_item"))).alias("_a")).where(
            F.size("_a") > 1).select(*keys, F.col("_a._item").alias("_allowed"))
        left = rows.join(allowed, keys).withColumn("_rest", F.array_intersect("_allowed", "_rest")).where(F.size("_rest") > 1)
        grown = left.select(
            "segmento", "umbral", "n_pedidos", "_n", F.col("_set").alias("_before"), F.col("_rest").alias("_all"),
            F.posexplode(F.slice("_rest", 1, F.size("_rest") - 1)).alias("_at", "_item"))
        rows = stage(
            grown.groupBy(
                "segmento", "umbral", "n_pedidos", F.concat("_before", F.array("_item")).alias("_set"),
                F.slice("_all", F.col("_at") + 2, F.size("_all")).alias("_rest"),
            ).agg(F.sum("_n").alias("_n")), "baskets-left")
    # Read three times by the rules (set, left side, right side): mine once.
    return stage(found, "itemsets")


def _confident_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """(segmento, freq, n_pedidos, x, y, fx, fy): rules x → y of every set that reach the confidence.

    Consequents grow level by level. Moving an item from the antecedent to the consequent can only
    lower the confidence, so a longer consequent is built only from two that passed and differ in
    their last item; a set whose single consequents fail is never split further. Each level is a written table, and there
    are at most as many as the longest set has items.
    """
    known = itemsets.select("segmento", F.col("items").alias("x"), F.col("freq").alias("fx"))
    sets = stage(itemsets.where(F.size("items") > 1).withColumn("_set", F.monotonically_increasing_id()), "rule-sets")
    longest = sets.agg(F.max(F.size("items"))).first()[0] or 0
    columns = ["_set", "segmento", "items", "freq", "n_pedidos", "y"]
    candidates = sets.withColumn("y", F.explode(F.transform("items", lambda i: F.array(i)))).select(columns)
    enough = F.col("freq").cast("double") / F.col("fx").cast("double") >= min_confidence
    found = None
    for size in range(1, max(longest, 2)):
        checked = candidates.withColumn("x", F.array_except("items", "y")).join(known, ["segmento", "x"]).where(enough)
        level = stage(checked.select(*columns, "x", "fx"), "rule-level")
        found = level if found is None else found.unionByName(level)
        longer = level.where(F.size("items") > size + 1).select(
            *columns, F.slice("y", 1, size - 1).alias("_head"), F.element_at("y", -1).alias("_last"))
        if size + 1 >= longest:
            break
        other = longer.select("_set", "_head", F.col("_last").alias("_next"))
        candidates = longer.join(other, ["_set", "_head"]).where(F.col("_last") < F.col("_next")).select(
            *columns[:-1], F.concat("y", F.array("_next")).alias("y"))
        if candidates.isEmpty():
            break
    side = known.select("segmento", F.col("x").alias("y"), F.col("fx").alias("fy"))
    return found.join(side, ["segmento", "y"])


def _metrics(ante: Column, cons: Column, c_ante: Column, c_cons: Column) -> list[Column]:
    c, n = F.col("freq").cast("double"), F.col("n_pedidos").cast("double")
    ca, cc = c_ante.cast("double"), c_cons.cast("double")
    confidence = c / ca
    return [
        F.col("segmento"),
        item_label(ante).alias("antecedents"),
        item_label(cons).alias("consequents"),
        (ca / n).alias("antecedent_support"),
        (cc / n).alias("consequent_support"),
        (c / n).alias("support"),
        confidence.alias("confidence"),
        (c * n / (ca * cc)).alias("lift"),
        (c / n - (ca / n) * (cc / n)).alias("leverage"),
        F.when(F.col("freq") < c_ante, (1 - cc / n) / (1 - confidence)).alias("conviction"),
        F.size(ante).alias("n_antecedents"),
        F.size(cons).alias("n_consequents"),
        (F.size(ante) + F.size(cons)).alias("tamano_total"),
        F.col("n_pedidos").alias("n_pedidos_segmento"),
        F.col("freq").alias("support_count"),
    ]


def _passing(rules: DataFrame, min_confidence: float, min_lift: float) -> DataFrame:
    return rules.where((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))


def association_rules(
    itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT
) -> DataFrame:
    """Every directed rule that passes the thresholds."""
    rules = _confident_rules(itemsets, min_confidence).select(*_metrics(F.col("x"), F.col("y"), F.col("fx"), F.col("fy")))
    return _passing(rules, min_confidence, min_lift)


def one_rule_per_pair(
    itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT
) -> DataFrame:
    """The direction with the higher confidence (the rarer antecedent); ties go to the label."""
    rarer = (F.col("fx") < F.col("fy")) | ((F.col("fx") == F.col("fy")) & (item_label(F.col("x")) < item_label(F.col("y"))))
    chosen = _confident_rules(itemsets, min_confidence).where(rarer)
    rules = chosen.select(*_metrics(F.col("x"), F.col("y"), F.col("fx"), F.col("fy")))
    return _passing(rules, min_confidence, min_lift)


def exclusive_rules(rules: DataFrame, segment: str | None = None) -> DataFrame:
    """Rules whose directed name appears in one segment only."""
    alone = (
        rules.groupBy("antecedents", "consequents")
        .agg(F.count_distinct("segmento").alias("_n")).where(F.col("_n") == 1)
    )
    out = rules.join(alone, ["antecedents", "consequents"], "left_semi").select(*rules.columns)
    return out if segment is None else out.where(F.col("segmento") == segment)


def top_by_lift(rules: DataFrame, top_n: int) -> DataFrame:
    """The first rules of each segment; the rank limit is applied before the shuffle as well."""
    order = Window.partitionBy("segmento").orderBy(F.desc("lift"), "antecedents", "consequents")
    return (
        rules.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= top_n).drop("_rank")
    )


def orders_matching(rules: DataFrame, items: DataFrame) -> DataFrame:
    """(antecedents, consequents, order_id): orders that hold all families of a rule.

    A set containment join: each rule is looked up by the rarest of its families and then checked against the
    order's whole family list in place, so only real matches are produced and nothing is grouped by
    rule. Where even the rarest family of a rule is in very many orders, those orders are dealt to
    several parts by their id and the few rules of the family are copied to each, so that no part gets
    more than a quarter of a partition's share. Lines of families that no rule names are dropped before the
    shuffle by order. `rules` should be a written table: its known size lets the planner broadcast it
    when, and only when, it is below the broadcast threshold.
    """
    spark = rules.sparkSession
    named = rules.select("antecedents", "consequents").distinct().withColumn(
        "_need", rule_items(F.col("antecedents"), F.col("consequents"))
    )
    wanted = named.select(F.explode("_need").alias("familia")).distinct()
    baskets = stage(
        items.select("order_id", "familia").where(F.col("familia").isNotNull())
        .join(wanted, "familia", "left_semi")
        .groupBy("order_id").agg(F.collect_set("familia").alias("_have")),
        "rule-baskets",
    )
    held = stage(baskets.select(F.explode("_have").alias("familia")).groupBy("familia").count(), "families")
    anchors = (
        named.select("*", F.explode("_need").alias("familia"))
        .join(held, "familia", "left")
        .groupBy("antecedents", "consequents")
        .agg(F.first("_need").alias("_need"), F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "familia")).alias("_rarest"))
    )
    named_orders = held.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    share = max(1, named_orders // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = stage(anchors.select(
        "antecedents", "consequents", "_need", F.col("_rarest.familia").alias("_anchor"),
        F.greatest(F.lit(1), F.ceil(F.col("_rarest.n") / share)).cast("int").alias("_parts")), "anchors")
    parts = dealt.select("_anchor", "_parts").distinct()
    entries = baskets.select("order_id", "_have", F.explode("_have").alias("_anchor")).join(parts, "_anchor").withColumn(
        "_part", F.pmod(F.xxhash64("order_id"), F.col("_parts")).cast("int"))
    copies = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return (
        entries.drop("_parts").join(copies, ["_anchor", "_part"])
        .where(F.size(F.array_except("_need", "_have")) == 0)
        .select("antecedents", "consequents", "order_id")
    )


def lists_matching(rules: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (order_id, _list) with the families of each order that a rule names, and (antecedents,
    consequents, _list) with the lists that hold all families of a rule.

    Few families are named, so very many orders share a list; each list is matched once.
    """
    wanted = rules.select(F.explode(rule_items(F.col("antecedents"), F.col("consequents"))).alias("familia")).distinct()
    held = stage(
        items.select("order_id", "familia").where(F.col("familia").isNotNull())
        .join(wanted, "familia", "left_semi")
        .groupBy("order_id").agg(F.sort_array(F.collect_set("familia")).alias("_have"))
        .select("order_id", F.to_json("_have").alias("_list"), "_have"),
        "order-lists",
    )
    lists = stage(held.groupBy("_list", "_have").agg(F.count(F.lit(1)).alias("_n")), "lists")
    lines = lists.select(F.col("_list").alias("order_id"), F.explode("_have").alias("familia"))
    matched = orders_matching(rules, lines).select("antecedents", "consequents", F.col("order_id").alias("_list"))
    return held.select("order_id", "_list"), stage(matched, "matched-lists")


def rule_value(rules: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, mean, median and total money per rule, over all segments and all time."""
    require_columns(orders, ["order_id", "pago_total"], "orders")
    keys = ["antecedents", "consequents"]
    # Orders that hold the same families hold the same rules: lists are matched, and money is summed and ranked by list.
    held, matched = lists_matching(rules, items)
    paid = stage(
        held.join(orders.select("order_id", "pago_total"), "order_id", "left")
        .groupBy("_list", "pago_total").agg(F.count(F.lit(1)).alias("veces")),
        "paid",
    )
    of_lists = paid.groupBy("_list").agg(
        F.sum(F.col("pago_total") * F.col("veces")).alias("_money"),
        F.sum(F.when(F.col("pago_total").isNotNull(), F.col("veces"))).alias("_known"),
        F.sum("veces").alias("veces"),
    )
    totals = matched.join(of_lists, "_list").groupBy(*keys).agg(
        F.try_divide(F.sum("_money"), F.sum("_known")).alias("ticket_medio"),
        F.sum("veces").alias("n_pedidos"),
        F.coalesce(F.sum("_money"), F.lit(0.0)).alias("revenue_total"),
    )
    medians = exact_quantiles(paid, keys, "pago_total", {"ticket_mediano": 0.5}, weight="veces", members=matched)
    zero = F.lit(0.0)
    return (
        rules.select(*keys).distinct()
        .join(totals, keys, "left").join(medians, keys, "left")
        .select(
            *keys,
            F.when(F.col("n_pedidos").isNull(), zero).otherwise(F.col("ticket_medio")).alias("ticket_medio"),
            F.when(F.col("n_pedidos").isNull(), zero).otherwise(F.col("ticket_mediano")).alias("ticket_mediano"),
            F.coalesce("n_pedidos", F.lit(0)).alias("n_pedidos"),
            F.coalesce("revenue_total", zero).alias("revenue_total"),
        )
    )


def actionable_rules(
    rules: DataFrame, items: DataFrame, orders: DataFrame, top_n: int = TOP_ACTIONABLE
) -> DataFrame:
    """1→1 and 1→2 rules, the top of each segment by lift, with their money value.

    Ranked before they are valued; the ranked list holds at most top_n rows per segment.
    """
    small = rules.where((F.col("n_antecedents") == 1) & (F.col("n_consequents") <= 2))
    ranked = stage(top_by_lift(small, top_n), "actionable")
    value = rule_value(ranked, items, orders)
    return ranked.join(value, ["antecedents", "consequents"]).select(
        *rules.columns, "ticket_medio", "ticket_mediano", "n_pedidos", "revenue_total"
    )


def basket_analysis(
    items: DataFrame,
    segments: DataFrame,
    orders: DataFrame,
    min_support_count: int = MIN_SUPPORT_COUNT,
    min_support_pct: float = MIN_SUPPORT_PCT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    top_n_actionable: int = TOP_ACTIONABLE,
    ignore: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All rules, the exclusive ones and the actionable ones; empty results keep their schema."""
    require_columns(orders, ["order_id", "pago_total"], "orders")
    skus = NON_PRODUCT_SKUS if ignore is None else list(ignore)
    products = drop_non_products(items, skus)
    itemsets = frequent_itemsets(
        multi_family_baskets(items, segments, skus), min_support_count, min_support_pct
    )
    rules = stage(one_rule_per_pair(itemsets, min_confidence, min_lift), "rules")
    return {
        "por_segmento": rules,
        "exclusivas": exclusive_rules(rules),
        "accionables": actionable_rules(rules, products, orders, top_n_actionable),
    }


def empty_rules(spark) -> DataFrame:
    return spark.createDataFrame([], RULES)


QUADRANTS = ["Oportunidades fuertes", "Co-compras frecuentes", "Nichos interesantes", "Ruido"]


def rule_quadrants(rules: DataFrame) -> DataFrame:
    """Each rule against the median confidence and lift of the rules shown."""
    cut = exact_quantiles(
        rules.withColumn("_all", F.lit(1)), ["_all"], "confidence", {"c": 0.5}
    ).select("c").scalar(), exact_quantiles(
        rules.withColumn("_all", F.lit(1)), ["_all"], "lift", {"l": 0.5}
    ).select("l").scalar()
    sure, strong = F.col("confidence") >= cut[0], F.col("lift") >= cut[1]
    return rules.withColumn(
        "cuadrante",
        F.when(sure & strong, QUADRANTS[0]).when(sure, QUADRANTS[1]).when(strong, QUADRANTS[2]).otherwise(QUADRANTS[3]),
    )


def quadrant_counts(rules: DataFrame) -> DataFrame:
    return rule_quadrants(rules).groupBy("cuadrante").agg(F.count(F.lit(1)).alias("n_reglas"))
