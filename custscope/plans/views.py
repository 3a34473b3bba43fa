"""Composite views: the tables behind one page, as named DataFrames over shared inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from custscope.functions.guards import bounded_int
from custscope.operators import basket
from custscope.operators import serve_customer as customer
from custscope.operators import serve_moves as moves
from custscope.operators import serve_rules as rules
from custscope.operators import serve_segments as segs
from custscope.operators import serve_time as when
from custscope.plans.job import SNAPSHOTS
from custscope.sources.tables import VIEWS, has_table, load_table


class CustomerNotFound(LookupError):
    """No customer with this id."""


@dataclass
class Tables:
    """The stored tables a view reads; members of a view share these DataFrames."""

    segmentos: DataFrame
    orders: DataFrame | None = None
    items: DataFrame | None = None
    mba_accionables: DataFrame | None = None
    mba_por_segmento: DataFrame | None = None
    mba_exclusivas: DataFrame | None = None
    temp_hora_dia: DataFrame | None = None
    temp_mes: DataFrame | None = None
    temp_bundles: DataFrame | None = None
    temp_diario: DataFrame | None = None
    snapshots: DataFrame | None = None

    @staticmethod
    def load(spark: SparkSession, root: str) -> Tables:
        found = {
            view: load_table(spark, root, name)
            for view, name in {**VIEWS, "snapshots": SNAPSHOTS}.items()
            if has_table(spark, root, name)
        }
        return Tables(**found)


def overview(t: Tables) -> dict[str, DataFrame]:
    return {
        "kpis": segs.global_kpis(t.segmentos),
        "distribucion": segs.customers_per_segment(t.segmentos),
        "revenue": segs.revenue_per_segment(t.segmentos),
        "resumen": segs.segment_summary(t.segmentos),
    }


def bundles(
    t: Tables, segment: str | None = None, mode: str = "accionables", min_confidence: float = 0.30, min_lift: float = 1.5
) -> dict[str, DataFrame]:
    shown = rules.bundles_scatter(t.mba_accionables, t.mba_por_segmento, segment, mode, min_confidence, min_lift)
    return {
        "top": rules.bundles_top(t.mba_accionables, t.mba_por_segmento, segment, mode),
        "mapa": basket.rule_quadrants(shown),
    }


def seasonality(t: Tables, segments=None, as_of=None) -> dict[str, DataFrame]:
    """No selection means all segments."""
    shares = when.hour_weekday_share(t.temp_hora_dia, segments)
    return {
        "hora_dia": shares,
        "por_hora": when.share_by_hour(shares),
        "por_dia": when.share_by_weekday(shares),
        "mensual": when.monthly_series(t.temp_mes, segments),
        "tipica": when.typical_months(t.temp_mes, segments),
        **last_month(t, as_of),
    }


def last_month(t: Tables, as_of=None) -> dict[str, DataFrame]:
    return {
        "actual": when.current_month(t.temp_diario, as_of),
        "anterior": when.previous_month_same_days(t.temp_diario, as_of),
        "variacion": when.monthly_change(t.temp_diario, as_of),
        "variacion_total": when.total_change(t.temp_diario, as_of),
        "alineado": when.aligned_months(t.temp_diario, as_of),
    }


def comparison(t: Tables, a: str, b: str) -> dict[str, DataFrame]:
    out = {"ranges": segs.median_ranges(t.segmentos), "radar": segs.radar(t.segmentos)}
    for side, name in (("a", a), ("b", b)):
        out[f"metricas_{side}"] = segs.segment_metrics(t.segmentos, name)
        out[f"bundles_{side}"] = rules.top_bundles(t.mba_accionables, name, 3)
        out[f"monetary_{side}"] = segs.monetary_values(t.segmentos, name)
    return out


def bundle_months(t: Tables, segment: str, top_n: int = 10) -> dict[str, DataFrame]:
    bounded_int("top_n", top_n, 1, 30)
    return {
        "serie": rules.bundles_over_time(t.temp_bundles, segment, top_n),
        "mes_pico": rules.peak_month(t.temp_bundles, segment),
        "activos": rules.active_bundles(t.temp_bundles, segment, 5, top_n),
    }


def customer_360(t: Tables, customer_id: str, limit: int = 10) -> dict[str, DataFrame]:
    own = customer.profile(t.segmentos, customer_id)
    if own.isEmpty():
        raise CustomerNotFound(f"no customer {customer_id!r}")
    return {
        "perfil": own,
        "pedidos": customer.order_history(t.orders, t.items, customer_id),
        "posicion": customer.position_in_segment(t.segmentos, customer_id),
        "productos_top": customer.top_products(t.items, customer_id, limit),
        "bundles_propios": customer.own_bundles(t.items, t.segmentos, t.mba_accionables, customer_id, limit),
        "oportunidades": customer.missed_opportunities(t.items, t.orders, customer_id, limit),
    }


def alerts(t: Tables) -> dict[str, DataFrame]:
    return {
        "urgentes_kpis": segs.urgent_kpis(t.segmentos),
        "urgentes": segs.urgent_customers(t.segmentos),
        "reactivacion_kpis": segs.reactivation_kpis(t.segmentos),
        "reactivacion": segs.reactivation_customers(t.segmentos),
    }


def movements(t: Tables, as_of=None, months: int = 1, threshold: float = moves.FRONTIER_RATIO) -> dict[str, DataFrame]:
    frontier = moves.frontier_customers(t.segmentos, threshold)
    changes = moves.changed_since(t.segmentos, t.snapshots, as_of, months)
    return {"kpis": moves.movement_kpis(frontier, changes), "frontera": frontier, "cambios": changes}


VIEW_BUILDERS = {
    "overview": overview,
    "bundles": bundles,
    "estacionalidad": seasonality,
    "ultimo_mes": last_month,
    "comparador": comparison,
    "heatmap_bundles": bundle_months,
    "cliente": customer_360,
    "alertas": alerts,
    "movimientos": movements,
}


def view(name: str, tables: Tables, **params) -> dict[str, DataFrame]:
    if name not in VIEW_BUILDERS:
        raise ValueError(f"unknown view {name!r}; known views: {sorted(VIEW_BUILDERS)}")
    return VIEW_BUILDERS[name](tables, **params)
