"""Order documents to flat tables, lenient casts, currency and product family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custscope.functions.guards import require_columns
from custscope.schema import NON_PRODUCT_SKUS
from custscope.sources.documents import document_id, document_time, plain


def lenient_double(c: Column) -> Column:
    """A value that is not a finite number becomes NULL: words, NaN, and numbers with a type letter behind them."""
    text = F.trim(plain(c.cast("string")))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def lenient_long(c: Column) -> Column:
    """A whole number in any spelling ('3', '3.0', '3e2'); anything else becomes NULL."""
    number = lenient_double(c)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.try_cast("bigint"))
    return F.coalesce(F.trim(plain(c.cast("string"))).try_cast("bigint"), whole)


def num_products(products: Column) -> Column:
    """Lines that name a SKU other than the charges."""
    valid = F.filter(
        products, lambda p: p["clave"].isNotNull() & ~p["clave"].isin(NON_PRODUCT_SKUS)
    )
    return F.coalesce(F.size(valid), F.lit(0))


def flatten_orders(docs: DataFrame) -> DataFrame:
    header = "pedido.encabezado"
    return docs.select(
        document_id().alias("order_id"),
        plain(F.col(f"{header}.cliente")).alias("cliente_id"),
        F.col(f"{header}.nombre").alias("nombre_cliente"),
        document_time().alias("fecha"),
        lenient_double(F.col(f"{header}.pago")).alias("pago_total"),
        lenient_double(F.col(f"{header}.iva")).alias("iva_aplicado"),
        F.col(f"{header}.plazo").alias("plazo"),
        F.col(f"{header}.tipoPago").alias("tipo_pago"),
        num_products(F.col("pedido.detalle.producto")).alias("num_productos"),
        (F.coalesce(F.size("errores"), F.lit(0)) > 0).alias("tiene_errores"),
    )


def explode_items(docs: DataFrame) -> DataFrame:
    """One row per product, every product kept; an order without products gives no row.

    `posicion` is the place of the line in its document; the upsert needs it to know which of
    two lines of the same SKU came last.
    """
    header = "pedido.encabezado"
    # The values of the document are made before its lines are dealt out, once and not for each line.
    heads = docs.select(
        document_id().alias("order_id"),
        plain(F.col(f"{header}.cliente")).alias("cliente_id"),
        document_time().alias("fecha"),
        lenient_double(F.col(f"{header}.tipodecambio")).alias("valor_dolar"),
        F.col("pedido.detalle.producto").alias("productos"),
    )
    lines = heads.select("order_id", "cliente_id", "fecha", "valor_dolar", F.posexplode("productos").alias("posicion", "p"))
    return lines.select(
        "order_id", "cliente_id", "fecha",
        F.col("p.clave").alias("clave"),
        lenient_double(F.col("p.cantidad")).alias("cantidad"),
        lenient_double(F.col("p.precioFinal")).alias("precio_final"),
        F.col("p.moneda").alias("moneda"),
        "valor_dolar",
        lenient_long(F.col("p.promocion_id")).alias("promocion_id"),
        lenient_long(F.col("p.promocion_tipo")).alias("promocion_tipo"),
        "posicion",
    )


def enrich_items(items: DataFrame) -> DataFrame:
    """Unit price and line total in pesos; dollar prices use the order's exchange rate."""
    price = F.when(
        F.col("moneda") == "USD", F.col("precio_final") * F.col("valor_dolar")
    ).otherwise(F.col("precio_final"))
    return items.withColumn("precio_mxn", price).withColumn(
        "subtotal_mxn", F.col("precio_mxn") * F.col("cantidad")
    )


def family_of(sku: Column) -> Column:
    """The SKU without any digit; NULL stays NULL and an all-digit SKU becomes ''."""
    return F.regexp_replace(sku, "[0-9]+", "")


def add_family(items: DataFrame) -> DataFrame:
    """Always recomputed: the SKU is the source of truth."""
    require_columns(items, ["clave"], "items")
    return items.withColumn("familia", family_of(F.col("clave")))


def family_stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_distinct("familia").alias("n_familias"),
        F.count_if(F.col("familia").isNull()).alias("n_nulas"),
        F.count(F.lit(1)).alias("n_items"),
    )


def drop_non_products(items: DataFrame, skus: Sequence[str] = tuple(NON_PRODUCT_SKUS)) -> DataFrame:
    """Drops the listed SKUs; lines without a SKU stay, and an empty list keeps everything."""
    if not skus:
        return items
    return items.where(F.col("clave").isNull() | ~F.col("clave").isin(list(skus)))


def known_products(items: DataFrame) -> DataFrame:
    """The stricter filter of the customer queries: lines without a SKU go too."""
    return items.where(~F.col("clave").isin(NON_PRODUCT_SKUS))
