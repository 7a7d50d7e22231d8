"""History tables and saved models in one folder, as Parquet and Spark ML model folders."""

import json
import platform
from collections.abc import Sequence

import pyspark
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from modelyard import settings
from modelyard.operators.boosting import BoostedTrees
from modelyard.operators.history import latest_per_key, newest
from modelyard.operators.neighbours import NearestNeighbours
from modelyard.operators.partitioning import TableClusters
from modelyard.operators.plain import PlainModel, load_plain
from modelyard.session import cut_lineage

# Table schemas.
SCHEMAS = {
    "models": "id long, model_id string, task_type string, target_column string, creation_date timestamp, "
    "last_updated timestamp, status string, version string, description string, model_info string",
    "predictions": "id long, model_id string, input_data string, prediction string, actual_value string, "
    "prediction_time timestamp, confidence double, processing_time double, prediction_info string",
    "model_metrics": "id long, model_id string, timestamp timestamp, metrics map<string,double>, dataset_size long, "
    "dataset_info string, computation_time double",
    "model_updates": "id long, model_id string, update_time timestamp, update_type string, "
    "performance_before map<string,double>, performance_after map<string,double>, update_info string, "
    "success boolean, error_message string",
    "data_drift": "id long, model_id string, detection_time timestamp, feature_name string, drift_score double, "
    "drift_detected boolean, drift_type string, severity string, drift_info string",
    "feature_importance": "id long, model_id string, feature_name string, importance_score double, "
    "importance_type string, timestamp timestamp, feature_info string",
    "training_jobs": "id long, model_id string, start_time timestamp, end_time timestamp, status string, "
    "error_message string, training_params string, resource_usage string, job_info string",
    "alerts": "id long, template string, timestamp timestamp, severity string, recipients array<string>, "
    "alert_key string, data string",
    "progress": "id long, model_id string, timestamp timestamp, step string, progress double, status string",
}

CHILD_TABLES = ("predictions", "model_metrics", "model_updates", "data_drift", "feature_importance", "training_jobs")

# Tables kept in one folder per day: (time column, folder column).
BY_DAY = {"predictions": ("prediction_time", "pred_date")}


class Store:
    """Append-only tables under `root`. Changing a model appends a new row; the latest row counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in SCHEMAS:
            raise ValueError(f"no table {name}")
        return f"{self.root}/{name}"

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows; absent columns are NULL and the id is a hash of the row."""
        schema = T.StructType.fromDDL(SCHEMAS[name])
        cells = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
            if f.name != "id"
        ]
        text = F.to_json(F.struct(*[c for c in cells]))
        identity = F.col("id").cast("long") if "id" in df.columns else F.xxhash64(text)
        rows = df.select(identity.alias("id"), *cells)
        writer = rows
        if name in BY_DAY:
            time, day = BY_DAY[name]
            writer = rows.withColumn(day, F.date_format(time, "yyyyMMdd"))
            writer.write.mode("append").partitionBy(day).parquet(self.path(name))
        else:
            writer.write.mode("append").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """The rows of a table; empty before the first append."""
        schema = SCHEMAS[name] + (f", {BY_DAY[name][1]} string" if name in BY_DAY else "")
        if not _exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def models(self) -> DataFrame:
        """The latest row of every model that was not deleted."""
        latest = latest_per_key(self.read("models"), ["last_updated", "id"], ["model_id"])
        return latest.where(F.col("status") != "deleted")

    def model_info(self, model_id: str) -> DataFrame:
        return self.models().where(F.col("model_id") == model_id)

    def versions(self, model_id: str, keep: int = settings.VERSIONS_KEPT) -> DataFrame:
        """The newest rows of a model."""
        return newest(self.read("models").where(F.col("model_id") == model_id), keep, ["last_updated", "id"])

    def metrics_history(self, model_id: str) -> DataFrame:
        return self.read("model_metrics").where(F.col("model_id") == model_id).orderBy("timestamp")

    def update_model(self, model_id: str, changes: dict, now: Column) -> bool:
        """Append a new version with `changes` merged into the JSON document; False when there is no such model."""
        row = self.model_info(model_id).first()
        if row is None:
            return False
        merged = {**json.loads(row["model_info"] or "{}"), **changes}
        known = {k: v for k, v in changes.items() if k in ("status", "version", "description", "target_column")}
        df = self.model_info(model_id).drop("id").withColumns(
            {"model_info": F.lit(json.dumps(merged, sort_keys=True)), "last_updated": now.cast("timestamp")}
            | {k: F.lit(v) for k, v in known.items()}
        )
        self.append("models", df)
        return True

    def delete_model(self, model_id: str) -> None:
        """Remove a model and all of its rows: every table is read, cut from its files and written back."""
        for name in ("models", *CHILD_TABLES):
            if not _exists(self.spark, self.path(name)):
                continue
            gone = self.spark.createDataFrame([(model_id,)], "model_id string")
            kept = cut_lineage(self.read(name).join(F.broadcast(gone), "model_id", "left_anti"))
            writer = kept.write.mode("overwrite")
            if name in BY_DAY:
                writer = writer.partitionBy(BY_DAY[name][1])
            writer.parquet(self.path(name))

    def save_model(self, model, model_id: str, info: dict, now: Column) -> str:
        """Write a fitted model and its registry row, with the digest of the files."""
        path = f"{self.root}/fitted/{model_id}/{info.get('version', '1')}"
        write_model(self.spark, model, path)
        digest = folder_digest(self.spark, path).first()
        document = {
            **info,
            "path": path,
            "digest": digest["digest"],
            "size": digest["bytes"],
            "spark_version": pyspark.__version__,
            "python_version": platform.python_version(),
        }
        row = self.spark.range(1).select(
            F.lit(model_id).alias("model_id"),
            F.lit(info.get("task_type")).alias("task_type"),
            F.lit(info.get("target_column")).alias("target_column"),
            now.cast("timestamp").alias("creation_date"),
            now.cast("timestamp").alias("last_updated"),
            F.lit(info.get("status", "active")).alias("status"),
            F.lit(info.get("version", "1")).alias("version"),
            F.lit(info.get("description")).alias("description"),
            F.lit(json.dumps(document, sort_keys=True, default=str)).alias("model_info"),
        )
        self.append("models", row)
        return path

    def load_model(self, model_id: str):
        """(model, document); a digest that differs from the stored one is an error."""
        row = self.model_info(model_id).first()
        if row is None:
            raise ValueError(f"no model {model_id}")
        document = json.loads(row["model_info"])
        if not is_intact(self.spark, document["path"], document["digest"]):
            raise ValueError(f"the files of model {model_id} have changed")
        return read_model(self.spark, document["path"]), document

    def export_model(self, model_id: str, path: str) -> None:
        """Model and document to a folder of its own."""
        model, document = self.load_model(model_id)
        write_model(self.spark, model, f"{path}/fitted")
        self.spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/document"
        )

    def import_model(self, path: str, model_id: str, now: Column):
        document = json.loads(self.spark.read.text(f"{path}/document").first()["value"])
        model = read_model(self.spark, f"{path}/fitted")
        document.pop("path", None)
        self.save_model(model, model_id, document, now)
        return model

    def dependencies(self, model_id: str) -> dict:
        row = self.model_info(model_id).first()
        document = json.loads(row["model_info"]) if row else {}
        return {k: document[k] for k in ("spark_version", "python_version") if k in document}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_model(spark: SparkSession, model, path: str) -> None:
    """Any fitted model to a folder, with a line that says what it is."""
    kind = "plain" if isinstance(model, PlainModel) else "native"
    extra: dict = {}
    if isinstance(model, NearestNeighbours):
        kind, extra = "neighbours", {"task": model.task, "k": model.k, "classes": model.classes}
        if isinstance(model, TableClusters):
            extra |= {"method": model.method, "options": model.options}
        model.rows.write.mode("overwrite").parquet(f"{path}/model")
    elif isinstance(model, BoostedTrees):
        kind = "boosted"
        extra = {"task": model.task, "weights": model.weights, "classes": model.classes, "trees": len(model.trees)}
        for i, tree in enumerate(model.trees):
            tree.write().overwrite().save(f"{path}/model/{i}")
    elif kind == "plain":
        model.save(spark, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    line = json.dumps({"kind": kind, **extra})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/kind")


def read_model(spark: SparkSession, path: str):
    """The model a folder holds."""
    about = json.loads(spark.read.text(f"{path}/kind").first()["value"])
    if about["kind"] == "plain":
        return load_plain(spark, f"{path}/model")
    if about["kind"] == "neighbours":
        model = TableClusters(about["method"], **about["options"]) if "method" in about else NearestNeighbours(about["task"], about["k"])
        model.rows, model.classes = spark.read.parquet(f"{path}/model"), about["classes"]
        return model
    if about["kind"] == "boosted":
        trees = [DefaultParamsReader.loadParamsInstance(f"{path}/model/{i}", spark) for i in range(about["trees"])]
        return BoostedTrees(about["task"], trees, about["weights"], about["classes"])
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row: SHA-256 over the sorted file hashes of a folder, and its size. Checksum side files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashes = files.select(F.sha2("content", 256).alias("h"), "length")
    return hashes.agg(
        F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("digest"), F.sum("length").alias("bytes")
    )


def is_intact(spark: SparkSession, path: str, digest: str) -> bool:
    return folder_digest(spark, path).first()["digest"] == digest


def prediction_log(rows: DataFrame, model_id: str, inputs: Sequence[str]) -> DataFrame:
    """Scored rows in the shape of the `predictions` table."""
    from modelyard.functions.values import row_json

    return rows.select(
        F.lit(model_id).alias("model_id"),
        row_json(list(inputs)).alias("input_data"),
        F.col("prediction").cast("string").alias("prediction"),
        "prediction_time",
        (F.col("confidence") if "confidence" in rows.columns else F.lit(None)).cast("double").alias("confidence"),
    )
