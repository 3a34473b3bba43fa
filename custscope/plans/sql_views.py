"""The composite views as SQL table functions.

    SELECT * FROM cliente_pedidos(customer_id => '7')
    SELECT * FROM heatmap_bundles_serie(segment => 'MVPs')
    SELECT * FROM alertas_urgentes()

Each member of a view is a function over all its rows; its argument is a filter that the optimizer moves down to the
stored tables. An argument that is not given means all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.operators import serve_customer as customer
from custscope.operators import serve_rules as rules
from custscope.operators import serve_segments as segs
from custscope.plans import views
from custscope.plans.views import Tables


@dataclass(frozen=True)
class Member:
    """All rows of a member; the argument of its function, the column that it filters, and whether that column is shown."""

    rows: DataFrame
    argument: str | None = None
    column: str | None = None
    shown: bool = True


def members(t: Tables, as_of=None, min_confidence: float = 0.30, min_lift: float = 1.5, limit: int = 10) -> dict[str, Member]:
    """Function name to member. `as_of` is the day that months and changes are seen from."""
    found: dict[str, Member] = {}

    def add(view: str, frames: dict[str, DataFrame], argument: str | None = None, column: str | None = None) -> None:
        for name, rows in frames.items():
            filtered = column is not None and column in rows.columns
            found[f"{view}_{name}"] = Member(rows, argument if filtered else None, column if filtered else None)

    add("overview", views.overview(t))
    add("bundles", views.bundles(t, None, "accionables", min_confidence, min_lift))
    add("estacionalidad", views.seasonality(t, None, as_of), "segment", "segmento")
    add("ultimo_mes", views.last_month(t, as_of), "segment", "segmento")
    add("comparador", {"ranges": segs.median_ranges(t.segmentos), "radar": segs.radar(t.segmentos)})
    add("comparador", {"metricas": segs.segment_metrics(t.segmentos), "bundles": rules.top_bundles(t.mba_accionables, None, 3)}, "segment", "segmento")
    money = t.segmentos.select(F.col("segmento_cluster").alias("segmento"), "monetary")
    found["comparador_monetary"] = Member(money, "segment", "segmento", shown=False)
    add("heatmap_bundles", {
        "serie": rules.bundles_over_time(t.temp_bundles), "mes_pico": rules.peak_month(t.temp_bundles),
        "activos": rules.active_bundles(t.temp_bundles)}, "segment", "segmento_regla")
    add("cliente", {
        "perfil": customer.profile(t.segmentos), "pedidos": customer.order_history(t.orders, t.items),
        "productos_top": customer.top_products(t.items, None, limit),
        "bundles_propios": customer.own_bundles(t.items, t.segmentos, t.mba_accionables, None, limit),
        "oportunidades": customer.missed_opportunities(t.items, t.orders, None, limit)}, "customer_id", "cliente_id")
    add("alertas", views.alerts(t))
    if t.snapshots is not None:
        add("movimientos", views.movements(t, as_of))
    return found


def register_view_functions(spark: SparkSession, t: Tables, as_of=None, **options) -> list[str]:
    """Makes a temporary table function of every member and `cliente_posicion`, and names them."""
    made = []
    for name, member in members(t, as_of, **options).items():
        _function(spark, name, member)
        made.append(name)
    t.segmentos.createOrReplaceTempView("_filas_posicion")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION cliente_posicion(customer_id STRING)
        RETURNS TABLE (cliente_id STRING, recency BIGINT, monetary DOUBLE, es_objetivo BOOLEAN)
        RETURN SELECT other.cliente_id, other.recency, other.monetary, other.cliente_id = own.cliente_id
        FROM _filas_posicion AS own JOIN _filas_posicion AS other ON other.segmento_cluster = own.segmento_cluster
        WHERE own.cliente_id = customer_id""")
    return [*made, "cliente_posicion"]


def _function(spark: SparkSession, name: str, member: Member) -> None:
    shown = [f for f in member.rows.schema if member.shown or f.name != member.column]
    member.rows.createOrReplaceTempView(f"_filas_{name}")
    argument = f"{member.argument} STRING DEFAULT NULL" if member.argument else ""
    condition = ""
    if member.argument:
        condition = f"WHERE {member.argument} IS NULL OR `{member.column}` = {member.argument}"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument})
        RETURNS TABLE ({", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown)})
        RETURN SELECT {", ".join(f"`{f.name}`" for f in shown)} FROM _filas_{name} {condition}""")
