"""Fixed vocabulary and table schemas (the data contract between operators), as DDL text."""

from __future__ import annotations

# Segment names ordered best to worst.
SEGMENT_ORDER = ["MVPs", "Alto Valor", "Ocasionales", "En Riesgo", "Hibernando"]

# SKU codes that are charges, not products.
NON_PRODUCT_SKUS = ["CARGO100"]

# Status keys that mark a document as cancelled.
CANCELLED_STATUSES = [
    "Cancelado",
    "FacturadoCancelado",
    "NONCancelado",
    "NONFacturaESDActualizada",
    "NONFacturado",
    "NonCancelado",
    "Rechazado",
    "_FacturaESDActualizada_cancelada",
    "_Facturado_cancelado",
]
INVOICED_STATUS = "Facturado"
ONLINE_ORDER_TYPE = "CTonline"

# Spanish weekday names, Monday first.
WEEKDAY_NAMES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]

LOCAL_TIMEZONE = "America/Mexico_City"

FEATURES = ["recency", "frequency", "monetary", "dias_entre_compras"]

# One product line of a document. Every number inside a document is read as text and cast leniently later, so that one
# malformed value becomes NULL instead of dropping the document.
LINE = """struct<
    clave: string, cantidad: string, precioFinal: string, moneda: string,
    promocion_id: string, promocion_tipo: string>"""

_DOCUMENT = """
    _id string,
    errores array<string>,
    estatus map<string, string>,
    pedido struct<
        tipo: string,
        fecha: string,
        encabezado: struct<
            cliente: string, nombre: string, pago: string, tipodecambio: string,
            iva: string, plazo: string, tipoPago: string>,
        detalle: struct<producto: {producto}>>
    """
DOCUMENT = _DOCUMENT.format(producto=f"array<{LINE}>")
# The same with a single product that stands without its list.
SINGLE_LINE_DOCUMENT = _DOCUMENT.format(producto=LINE)
# The text of a document that could not be read, beside its columns.
CORRUPT = "_corrupto"

ORDERS = """
    order_id string, cliente_id string, nombre_cliente string, fecha timestamp,
    pago_total double, iva_aplicado double, plazo string, tipo_pago string,
    num_productos int, tiene_errores boolean
    """

ITEMS = """
    order_id string, cliente_id string, fecha timestamp, clave string, cantidad double,
    precio_final double, moneda string, valor_dolar double, promocion_id bigint,
    promocion_tipo bigint, precio_mxn double, subtotal_mxn double, familia string
    """

SEGMENTS = """
    cliente_id string, recency bigint, frequency bigint, monetary double,
    dias_entre_compras double, es_single_buyer int, cluster_id int,
    segmento_cluster string, distancia_propia double, distancia_segunda double,
    razon_distancias double, segmento_secundario string
    """

SNAPSHOT_COLUMNS = [
    "cliente_id", "segmento_cluster", "recency", "frequency", "monetary",
    "dias_entre_compras", "razon_distancias",
]

RULES = """
    segmento string, antecedents string, consequents string,
    antecedent_support double, consequent_support double, support double,
    confidence double, lift double, leverage double, conviction double,
    n_antecedents int, n_consequents int, tamano_total int,
    n_pedidos_segmento bigint, support_count bigint
    """

ORDER_KEYS = ["order_id"]
ITEM_KEYS = ["order_id", "clave"]
