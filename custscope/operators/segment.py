"""K-Means segmentation: fit, versioned parameters, expression scoring and frontier signals."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custscope.functions.guards import require_columns
from custscope.functions.labels import share, string_array
from custscope.operators.rfm import DEFAULT_MONTHS, rfm_complete
from custscope.schema import FEATURES, SEGMENT_ORDER
from custscope.sources.files import exists, write_text
from custscope.sources.staging import stage

PACKAGED_MODELS = Path(__file__).resolve().parent.parent / "models"
DEFAULT_VERSION = "v1"


@dataclass
class SegmentModel:
    """A frozen model as plain numbers: log1p, then (x - mean) / std, then nearest centroid."""

    version: str
    features: list[str]
    mean: list[float]
    std: list[float]
    centroids: list[list[float]]
    cluster_names: list[str]
    trained_at: str
    n_clientes_entrenamiento: int
    silhouette_score: float | None = None
    notas: str | None = None
    pipeline: PipelineModel | None = field(default=None, repr=False, compare=False)

    def to_json(self) -> str:
        content = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "pipeline"}
        return json.dumps(content, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> SegmentModel:
        return SegmentModel(**json.loads(text))

    def save(self, spark: SparkSession, models_dir: str) -> str:
        """Writes <models_dir>/<version>/params.json and, when fitted here, the pipeline."""
        out_dir = f"{models_dir.rstrip('/')}/{self.version}"
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{out_dir}/pipeline")
        write_text(spark, f"{out_dir}/params.json", self.to_json(), overwrite=True)
        return out_dir

    @staticmethod
    def load(spark: SparkSession, version: str = DEFAULT_VERSION, models_dir: str | None = None) -> SegmentModel:
        base = models_dir.rstrip("/") if models_dir else PACKAGED_MODELS.as_uri()
        folder = f"{base}/{version}"
        if not exists(spark, f"{folder}/params.json"):
            raise FileNotFoundError(f"no segmentation model at {folder}")
        text = spark.read.text(f"{folder}/params.json", wholetext=True).first()[0]
        return SegmentModel.from_json(text)

    @staticmethod
    def packaged(version: str = DEFAULT_VERSION) -> SegmentModel:
        """The model shipped with the library, read without a session."""
        return SegmentModel.from_json((PACKAGED_MODELS / version / "params.json").read_text("utf-8"))

    @staticmethod
    def from_fitted(
        pipeline: PipelineModel, n_customers: int, version: str = DEFAULT_VERSION, cluster_names=None,
        silhouette: float | None = None, notas: str | None = None, features: list[str] | None = None,
    ) -> SegmentModel:
        """Takes over a pipeline that was fitted elsewhere: assembler, scaler and k-means as `build_pipeline` orders them.

        `cluster_names` is a list by cluster number, or a map from number to name, with a name of its own for every
        cluster; without it clusters are named from best to worst.
        """
        features = list(features or FEATURES)
        scaler, kmeans = pipeline.stages[-2:]
        # Spark scales by the sample deviation; the parameters use the population deviation.
        widen = math.sqrt(n_customers / (n_customers - 1)) if n_customers > 1 else 1.0
        centroids = [[float(x) * widen for x in c] for c in kmeans.clusterCenters()]
        names = _given_names(cluster_names, len(centroids)) if cluster_names is not None else _name_clusters(centroids, features)
        return SegmentModel(
            version=version,
            features=features,
            mean=[float(x) for x in scaler.mean],
            std=[(float(x) / widen) or 1.0 for x in scaler.std],
            centroids=centroids,
            cluster_names=names,
            trained_at=datetime.now(tz=timezone.utc).isoformat(),
            n_clientes_entrenamiento=n_customers,
            silhouette_score=silhouette,
            notas=notas,
            pipeline=pipeline,
        )

    def load_pipeline(self, models_dir: str) -> PipelineModel:
        return PipelineModel.load(f"{models_dir.rstrip('/')}/{self.version}/pipeline")


# --- training -------------------------------------------------------------------------------


def build_pipeline(k: int = 5, seed: int = 42, features: list[str] | None = None) -> Pipeline:
    """log1p sits inside the pipeline, so scoring always takes the original scale."""
    features = features or FEATURES
    logs = ", ".join(f"log1p(CAST({f} AS DOUBLE)) AS log_{f}" for f in features)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"),
        VectorAssembler(inputCols=[f"log_{f}" for f in features], outputCol="log_features"),
        StandardScaler(inputCol="log_features", outputCol="scaled", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster_id", maxIter=300, tol=1e-4),
    ])


def _name_clusters(centroids: list[list[float]], features: list[str]) -> list[str]:
    """Best to worst by value and activity: money and orders count up, days count down."""
    sign = {"recency": -1, "frequency": 1, "monetary": 1, "dias_entre_compras": -1}
    score = [sum(sign.get(f, 0) * x for f, x in zip(features, c)) for c in centroids]
    ranked = sorted(range(len(centroids)), key=lambda i: -score[i])
    names = [""] * len(centroids)
    for place, i in enumerate(ranked):
        names[i] = SEGMENT_ORDER[place] if place < len(SEGMENT_ORDER) else f"Grupo {place + 1}"
    return names


def _given_names(names, k: int) -> list[str]:
    by_number = {int(i): n for i, n in names.items()} if isinstance(names, dict) else dict(enumerate(names))
    if sorted(by_number) != list(range(k)) or len(set(by_number.values())) != k:
        raise ValueError(f"give each of the {k} clusters one name of its own, not {names!r}")
    return [by_number[i] for i in range(k)]


def fit(
    rfm: DataFrame,
    version: str = DEFAULT_VERSION,
    k: int = 5,
    seed: int = 42,
    n_init: int = 10,
    with_silhouette: bool = False,
    notas: str | None = None,
    cluster_names=None,
) -> SegmentModel:
    """Trains with `n_init` seeds and keeps the lowest within-cluster cost.

    The features are staged once: every iteration of every start reads customers, not orders.
    """
    validate_features(rfm)
    data = stage(rfm.select(*FEATURES), "kmeans-features")
    n = data.count()
    preparation = Pipeline(stages=build_pipeline(k, seed).getStages()[:-1]).fit(data)
    prepared = preparation.transform(data)
    starts = [build_pipeline(k, seed + start).getStages()[-1] for start in range(n_init)]
    best = min(_fitted(prepared, starts), key=lambda m: m.summary.trainingCost)
    silhouette = None
    if with_silhouette:
        silhouette = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster_id").evaluate(
            best.transform(prepared)
        )
    return SegmentModel.from_fitted(
        PipelineModel(stages=[*preparation.stages, best]), n, version, cluster_names, silhouette, notas)


def _fitted(prepared: DataFrame, starts: list[KMeans]) -> list:
    """The model of each start, in their order. Iterations are many short jobs, so the starts run side by side, as many
    as there are cores, and share one cached copy of the rows."""
    workers = min(len(starts), max(2, prepared.sparkSession.sparkContext.defaultParallelism))
    prepared.persist()
    try:
        with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
            return list(pool.map(lambda start: start.fit(prepared), starts))
    finally:
        prepared.unpersist()


def k_scan(rfm: DataFrame, ks=range(2, 11), seed: int = 42, n_init: int = 10) -> DataFrame:
    """Inertia and silhouette (squared Euclidean) per number of clusters, of the best of `n_init` starts."""
    data = stage(rfm.select(*FEATURES), "kmeans-features")
    prepared = stage(
        Pipeline(stages=build_pipeline().getStages()[:-1]).fit(data).transform(data).select("scaled"),
        "kmeans-scaled",
    )
    ks = list(ks)
    starts = [
        KMeans(k=k, seed=seed + i, featuresCol="scaled", predictionCol="cluster_id", maxIter=300) for k in ks for i in range(n_init)
    ]
    fitted = _fitted(prepared, starts)
    rows = []
    for at, k in enumerate(ks):
        model = min(fitted[at * n_init : (at + 1) * n_init], key=lambda m: m.summary.trainingCost)
        silhouette = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster_id").evaluate(
            model.transform(prepared)
        )
        rows.append((int(k), float(model.summary.trainingCost), float(silhouette)))
    return rfm.sparkSession.createDataFrame(rows, "k int, inercia double, silueta double")


# --- validation -----------------------------------------------------------------------------


def feature_checks(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """NULL (or NaN) and negative counts per feature in one pass."""
    require_columns(df, features, "the feature table")
    counts = []
    for f in features:
        bad = F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
        counts.append(F.count_if(bad).alias(f"{f}_nulos"))
        counts.append(F.count_if(~bad & (F.col(f) < 0)).alias(f"{f}_negativos"))
    return df.agg(*counts)


def validate_features(df: DataFrame, features: list[str] = FEATURES) -> None:
    found = feature_checks(df, features).first().asDict()
    nulls = {f: found[f"{f}_nulos"] for f in features if found[f"{f}_nulos"]}
    if nulls:
        raise ValueError(f"null feature values: {nulls}; impute before scoring")
    negative = {f: found[f"{f}_negativos"] for f in features if found[f"{f}_negativos"]}
    if negative:
        raise ValueError(f"negative feature values: {negative}; log1p needs values >= 0")


def _checked(f: str) -> Column:
    """The feature as double; scoring a NULL or negative value fails the job, in the same pass."""
    value = F.col(f).cast("double")
    return F.when(
        value.isNull() | F.isnan(value) | (value < 0),
        F.raise_error(F.lit(f"feature {f} is null or negative; impute before scoring")).cast("double"),
    ).otherwise(value)


# --- scoring --------------------------------------------------------------------------------


def _scaled(model: SegmentModel) -> list[Column]:
    return [
        (F.log1p(_checked(f)) - F.lit(m)) / F.lit(s)
        for f, m, s in zip(model.features, model.mean, model.std)
    ]


def scaled_features(df: DataFrame, model: SegmentModel) -> DataFrame:
    """Adds z_<feature>: the space the centroids live in."""
    require_columns(df, model.features, "the feature table")
    return df.withColumns({f"z_{f}": z for f, z in zip(model.features, _scaled(model))})


def _ranked_centroids(df: DataFrame, model: SegmentModel) -> DataFrame:
    """Adds _near: (distance, cluster) of all centroids, nearest first. Native expressions only."""
    z = scaled_features(df, model)
    distances = [
        F.struct(
            F.sqrt(sum((F.col(f"z_{f}") - F.lit(x)) * (F.col(f"z_{f}") - F.lit(x)) for f, x in zip(model.features, c)))
            .alias("d"),
            F.lit(i).alias("i"),
        )
        for i, c in enumerate(model.centroids)
    ]
    return z.withColumn("_near", F.sort_array(F.array(*distances))).drop(*[f"z_{f}" for f in model.features])


def _name(model: SegmentModel, index: Column) -> Column:
    return F.element_at(string_array(model.cluster_names), index + 1)


def score(df: DataFrame, model: SegmentModel, with_distance: bool = False) -> DataFrame:
    """Keeps all input columns; adds cluster_id and segmento_cluster."""
    near = _ranked_centroids(df, model)
    out = near.withColumns({
        "cluster_id": F.col("_near")[0]["i"],
        "segmento_cluster": _name(model, F.col("_near")[0]["i"]),
    })
    if with_distance:
        out = out.withColumn("distancia_centroide", F.col("_near")[0]["d"])
    return out.drop("_near")


def score_with_frontier(df: DataFrame, model: SegmentModel) -> DataFrame:
    """Scores and adds how close each customer is to the next segment (ratio near 1: ambiguous)."""
    first, second = F.col("_near")[0], F.col("_near")[1]
    return (
        _ranked_centroids(df, model)
        .withColumns({
            "cluster_id": first["i"],
            "segmento_cluster": _name(model, first["i"]),
            "distancia_propia": first["d"],
            "distancia_segunda": second["d"],
            "razon_distancias": F.try_divide(first["d"], second["d"]),
            "segmento_secundario": _name(model, second["i"]),
        })
        .drop("_near")
    )


def segment_customers(
    orders: DataFrame,
    model: SegmentModel | None = None,
    as_of=None,
    months: int = DEFAULT_MONTHS,
    cap_at_ref: bool = False,
) -> DataFrame:
    """Orders to scored customers."""
    return score_with_frontier(
        rfm_complete(orders, as_of, months, cap_at_ref), model or SegmentModel.packaged()
    )


def centroid_profile(segments: DataFrame, model: SegmentModel) -> DataFrame:
    """Centroids in the original scale (one decimal) with the customers now nearest to each."""
    rows = [
        (i, name, *[float(x) * s + m for x, s, m in zip(c, model.std, model.mean)])
        for i, (name, c) in enumerate(zip(model.cluster_names, model.centroids))
    ]
    schema = T.StructType([
        T.StructField("cluster_id", T.IntegerType()), T.StructField("segmento_cluster", T.StringType()),
        *[T.StructField(f, T.DoubleType()) for f in model.features],
    ])
    table = segments.sparkSession.createDataFrame(rows, schema)
    for f in model.features:
        table = table.withColumn(f, F.round(F.expm1(f), 1))
    counts = segments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        table.join(counts, "cluster_id", "left")
        .select("cluster_id", "segmento_cluster", *model.features, F.coalesce("n", F.lit(0)).alias("n_clientes"))
    )


# --- comparison with an earlier assignment ----------------------------------------------------


def _paired(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    return now.select("cliente_id", F.col("segmento_cluster").alias("actual")).join(
        snapshot.select("cliente_id", F.col("segmento_cluster").alias("snapshot")), "cliente_id"
    )


def snapshot_agreement(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    same = F.count_if(F.col("actual") == F.col("snapshot"))
    total = F.count(F.lit(1))
    return _paired(now, snapshot).agg(
        total.alias("n_total"),
        same.alias("n_coincidencias"),
        F.coalesce(share(same, total), F.lit(0.0)).alias("pct_coincidencia"),
    )


def segment_confusion(now: DataFrame, snapshot: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows: segment in the snapshot; one column per current segment: the usual five and any further ones."""
    if names is None:
        held = now.select("segmento_cluster").distinct().where(F.col("segmento_cluster").isNotNull()).collect()
        names = [*SEGMENT_ORDER, *sorted({r[0] for r in held} - set(SEGMENT_ORDER))]
    counts = _paired(now, snapshot).groupBy("snapshot").pivot("actual", names).agg(F.count(F.lit(1)))
    return counts.fillna(0, names)
