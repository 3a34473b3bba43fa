"""Composite views as queries: all rows of all members of a view, asked for through their table functions, each row as
one text, with check SQL made from the members'.

A member shows what one of the named queries shows, so its columns and its SQL are that query's. Customers are in the
segments of the frozen model throughout, as in the stored tables that the views read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.plans import sql_views, views
from custscope.sources import tables
from custscope.sources.staging import stage
from custscope.testbed import catalog as c
from custscope.testbed import mapping as m
from custscope.testbed.shapes import _parts, shape, shape_sql

TWO = "segmento IN ('MVPs', 'En Riesgo')"
LIMITS = {"min_confidence": 0.08, "min_lift": 1.5}


@dataclass(frozen=True)
class Page:
    """A view, its parameters, and for each member the query whose columns it has, with a filter on that query's rows."""

    view: str
    members: dict[str, tuple[str, str]]
    params: dict = field(default_factory=dict)

    def call(self, member: str) -> str:
        """SQL for the rows of a member, through its table function."""
        function, argument = member, ""
        if self.view == "comparador" and member[-2:] in ("_a", "_b"):
            function, argument = member[:-2], f"segment => '{self.params[member[-1]]}'"
        elif "customer_id" in self.params:
            argument = f"customer_id => '{self.params['customer_id']}'"
        elif "segment" in self.params:
            argument = f"segment => '{self.params['segment']}'"
        chosen = f" WHERE {self.members[member][1]}" if "segments" in self.params else ""
        return f"SELECT * FROM {self.view}_{function}({argument}){chosen}"


def _own(*names: str) -> dict[str, tuple[str, str]]:
    return dict(zip(names[::2], ((q, "true") for q in names[1::2]), strict=True))


_LAST_MONTH = _own("actual", "ultimo_mes", "anterior", "mes_anterior", "variacion", "variacion_mensual",
                   "variacion_total", "variacion_total", "alineado", "mes_alineado")
_CUSTOMER = f"cliente_id = '{c.RANKED_CUSTOMER}'"
PAGES = {
    "vista_overview": Page("overview", _own(
        "kpis", "kpis_globales", "distribucion", "distribucion_clientes", "revenue", "revenue_por_segmento", "resumen", "resumen_por_segmento")),
    "vista_bundles": Page("bundles", _own("top", "bundles_top", "mapa", "mapa_reglas"), LIMITS),
    "vista_estacionalidad": Page("estacionalidad", {
        **{k: (q, TWO) for k, q in (("hora_dia", "hora_dia_pct"), ("por_hora", "pct_por_hora"), ("por_dia", "pct_por_dia"),
                                    ("mensual", "serie_mensual"), ("tipica", "estacionalidad_tipica"))},
        **_LAST_MONTH}, {"segments": "MVPs,En Riesgo", "as_of": c.MONTH_DAY}),
    "vista_ultimo_mes": Page("ultimo_mes", _LAST_MONTH, {"as_of": c.MONTH_DAY}),
    "vista_comparador": Page("comparador", {
        **_own("ranges", "ranges_medianas", "radar", "radar_segmentos"),
        **{f"{k}_{side}": (q, f"segmento = '{name}'") for side, name in (("a", "MVPs"), ("b", "Hibernando"))
           for k, q in (("metricas", "metricas_segmento"), ("bundles", "top_bundles"), ("monetary", "monetary_por_cliente"))},
    }, {"a": "MVPs", "b": "Hibernando"}),
    "vista_heatmap_bundles": Page("heatmap_bundles", {
        k: (q, "segmento_regla = 'MVPs'") for k, q in (("serie", "bundles_temporalidad"), ("mes_pico", "mes_pico"), ("activos", "bundles_activos"))
    }, {"segment": "MVPs"}),
    "vista_cliente": Page("cliente", {
        "posicion": ("cliente_posicion", "true"),
        **{k: (q, _CUSTOMER) for k, q in (
            ("perfil", "cliente_perfil"), ("pedidos", "cliente_pedidos"), ("productos_top", "cliente_productos_top"),
            ("bundles_propios", "cliente_bundles"), ("oportunidades", "cliente_oportunidades"))},
    }, {"customer_id": c.RANKED_CUSTOMER}),
    "vista_alertas": Page("alertas", _own(
        "urgentes_kpis", "kpis_urgentes", "urgentes", "clientes_urgentes", "reactivacion_kpis", "kpis_reactivacion",
        "reactivacion", "clientes_reactivacion")),
    "vista_movimientos": Page("movimientos", _own(
        "kpis", "kpis_movimientos", "frontera", "clientes_frontera", "cambios", "cambios_segmento"), {"as_of": m.AS_OF}),
}
#: Columns of members that have no query of their own.
SPECS = {"mapa_reglas": "segmento:s antecedents:s consequents:s cuadrante:s", "monetary_por_cliente": "monetary:d4"}
PAGE_SPEC = "miembro:s fila:s"


def stored_tables(spark: SparkSession, sf: str) -> views.Tables:
    """The tables of a view, over the driver's data."""
    segments = stage(c.segments(spark, sf), "segments")
    items = stage(m.items(spark, sf), "items")
    counts = items.groupBy("order_id").agg(F.count_if(F.col("clave").isNotNull() & (F.col("clave") != "CARGO100")).alias("num_productos"))
    orders = stage(m.orders(spark, sf).join(counts, "order_id", "left").fillna(0, ["num_productos"]), "orders")
    products = c.flatten.drop_non_products(items)
    limits = c.FAMILY_RULES
    sets = c.basket.frequent_itemsets(c.basket.multi_family_baskets(items, segments), limits["min_count"], limits["min_pct"])
    rules = stage(c.basket.one_rule_per_pair(sets, limits["min_confidence"], limits["min_lift"]), "rules")
    actionable = stage(c.basket.actionable_rules(rules, products, orders), "actionable")
    window = c.order_window(spark, sf)
    return views.Tables(
        segmentos=segments, orders=orders, items=items, mba_accionables=actionable, mba_por_segmento=rules,
        mba_exclusivas=c.basket.exclusive_rules(rules), temp_hora_dia=stage(c.hour_day(spark, sf), "hours"),
        temp_mes=stage(c.season.monthly(window, segments), "months"),
        temp_bundles=stage(c.season.bundles_by_month(window, segments, products, actionable), "bundles"),
        temp_diario=stage(c.season.daily(m.orders(spark, sf), segments, m.AS_OF), "days"),
        snapshots=stage(tables.snapshot_rows(c.snapshot(spark, sf), m.SNAPSHOT_AS_OF), "snapshots"))


def _spec(query: str) -> str:
    return SPECS.get(query) or c.SPECS[query]


def _text(name: str, kind: str) -> Column:
    col = F.col(f"`{name}`")
    return F.coalesce((col.cast(f"decimal(38,{kind[1:]})") if kind.startswith("d") else col).cast("string"), F.lit("-"))


def rows_of(members: dict[str, DataFrame], page: Page) -> DataFrame:
    out = None
    for name, (query, _) in page.members.items():
        spec = _spec(query)
        shaped = shape(members[name], spec)
        one = shaped.select(F.lit(name).alias("miembro"), F.concat_ws("|", *[_text(*p) for p in _parts(spec)]).alias("fila"))
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def build(page: Page):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            t = stored_tables(m.use_utc(spark), sf)
            limits = {k: v for k, v in page.params.items() if k in LIMITS}
            sql_views.register_view_functions(spark, t, page.params.get("as_of"), **limits)
            return shape(rows_of({name: spark.sql(page.call(name)) for name in page.members}, page), PAGE_SPEC)

        return run

    return {name: build(page) for name, page in PAGES.items()}


def page_sql(raw: dict[str, str], page: Page) -> str:
    """`raw`: the members' SQL by query."""
    def text(name: str, kind: str) -> str:
        value = f'CAST("{name}" AS DECIMAL(38,{kind[1:]}))' if kind.startswith("d") else f'"{name}"'
        return f"coalesce(CAST({value} AS VARCHAR), '-')"

    parts = []
    for name, (query, condition) in page.members.items():
        spec = _spec(query)
        columns = ", ".join(text(*p) for p in _parts(spec))
        body = f"SELECT * FROM ({raw[query]}) AS q WHERE {condition}"
        parts.append(f"SELECT '{name}' AS miembro, concat_ws('|', {columns}) AS fila FROM ({shape_sql(body, spec)}) AS s")
    return shape_sql(" UNION ALL ".join(parts), PAGE_SPEC)
