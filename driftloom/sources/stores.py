"""The model registry and the dataset catalogue as append-only Parquet tables.

Changes of status are events; the newest event of a row is its state.  One
writer at a time is assumed for the numbering of ids.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from driftloom import schemas
from driftloom.operators import registry as R
from driftloom.operators.clean import drop_unnamed, impute_median
from driftloom.operators.ordered import clean
from driftloom.operators.profile import class_balance, column_profile, null_rates
from driftloom.operators.splits import augment
from driftloom.sources.sinks import write_json


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


class _Store:
    tables: dict[str, str] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(self.tables[name])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        schema = StructType.fromDDL(self.tables[name])
        shaped = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ]
        )
        shaped.write.mode("append").parquet(f"{self.root}/{name}")

    def _next_seq(self, name: str) -> int:
        return (self.table(name).agg(F.max("seq")).first()[0] or 0) + 1

    def _one(self, table: str, **values) -> None:
        schema = StructType.fromDDL(self.tables[table])
        row = tuple(values.get(f.name) for f in schema.fields)
        self.append(table, self.spark.createDataFrame([row], schema))


class ModelRegistry(_Store):
    """Registered models, batch metrics, drift details and retrain events."""

    tables = {
        "models": schemas.MODELS,
        "model_status": schemas.MODEL_STATUS,
        "batch_metrics": schemas.BATCH_METRICS,
        "drift_details": schemas.DRIFT_DETAILS,
        "retrain_log": schemas.RETRAIN_LOG,
    }

    def register_models(self, incoming: DataFrame, at: dt.datetime | None = None) -> None:
        """Register all new (name, version) pairs; known ones stay as they are."""
        at = at or _now()
        rows = R.new_registrations(self.table("models"), incoming)
        custom = F.col("thresholds") if "thresholds" in incoming.columns else F.lit(None).cast("map<string,double>")
        rows = rows.withColumns({"thresholds": R.merged_thresholds(custom), "registered_at": F.lit(at)})
        self.append("models", rows)

    def register_model(
        self, name: str, version: str = "1.0.0", *, description: str = "", pipeline_path: str = "",
        thresholds: dict[str, float] | None = None, tags: dict[str, str] | None = None, at: dt.datetime | None = None,
    ) -> int:
        """Register one model, or return the id it already has."""
        known = self._id_of(name, version)
        if known is None:
            row = self.spark.createDataFrame(
                [(name, version, description, pipeline_path, thresholds or {}, tags or {})],
                "name string, version string, description string, pipeline_path string, "
                "thresholds map<string,double>, tags map<string,string>",
            )
            self.register_models(row, at)
            known = self._id_of(name, version)
        return known

    def _id_of(self, name: str, version: str) -> int | None:
        row = self.table("models").filter((F.col("name") == name) & (F.col("version") == version)).first()
        return row["model_id"] if row else None

    def update_status(self, model_id: int, status: str, at: dt.datetime | None = None) -> None:
        self._one("model_status", model_id=model_id, status=status, at=at or _now(), seq=self._next_seq("model_status"))

    def models(self) -> DataFrame:
        """All models with their current status, by id."""
        newest = F.max_by("status", F.struct("at", "seq"))
        status = self.table("model_status").groupBy("model_id").agg(newest.alias("status"))
        return (
            self.table("models").join(status, "model_id", "left")
            .withColumn("status", F.coalesce("status", F.lit("inactive"))).orderBy("model_id")
        )

    def log_batch_metrics(self, rows: DataFrame, at: dt.datetime | None = None) -> None:
        """Append metric rows of any number of models and update each model's status."""
        at = at or _now()
        rows = R.with_new_ids(rows, self.table("batch_metrics"), id_column="id", key=["model_id", "batch_id"])
        if "recorded_at" not in rows.columns:
            rows = rows.withColumn("recorded_at", F.lit(at))
        self.append("batch_metrics", rows)
        latest = R.latest_batch(rows.select("model_id", "batch_id", "id", "auc_roc", "drift_severity"))
        thresholds = self.table("models").select("model_id", "thresholds")
        status = R.model_status(F.col("auc_roc"), F.col("drift_severity"), F.col("thresholds"))
        events = latest.join(thresholds, "model_id").select(
            "model_id", status.alias("status"), F.lit(at).alias("at"), F.lit(self._next_seq("model_status")).alias("seq")
        )
        self.append("model_status", events)

    def log_drift_details(self, rows: DataFrame) -> None:
        self.append("drift_details", rows)

    def log_retrain_events(self, rows: DataFrame, at: dt.datetime | None = None) -> None:
        rows = R.with_new_ids(rows, self.table("retrain_log"), id_column="id", key=["model_id", "trigger_batch"])
        if "triggered_at" not in rows.columns:
            rows = rows.withColumn("triggered_at", F.lit(at or _now()))
        self.append("retrain_log", rows)

    def fleet_health(self) -> DataFrame:
        return R.fleet_health(self.models(), self.table("batch_metrics"), self.table("retrain_log"))

    def model_history(self, model_id: int | None = None, last_n: int | None = None) -> DataFrame:
        return R.model_history(self.table("batch_metrics"), last_n, model_id)

    def drift_history(self, model_id: int | None = None, batch_id: int | None = None) -> DataFrame:
        return R.drift_history(self.table("drift_details"), model_id, batch_id)

    def retrain_history(self, model_id: int | None = None) -> DataFrame:
        return R.retrain_history(self.table("retrain_log"), model_id)

    def export_fleet(self, path: str) -> None:
        write_json(self.fleet_health(), path)


class DatasetCatalogue(_Store):
    """Immutable versioned snapshots with their column statistics."""

    tables = {
        "datasets": schemas.DATASETS,
        "dataset_status": schemas.DATASET_STATUS,
        "dataset_stats": schemas.DATASET_STATS,
        "class_balance": schemas.CLASS_BALANCE,
    }

    def datasets(self) -> DataFrame:
        """Every dataset that was not deleted, with its status."""
        state = R.current_state(self.table("dataset_status"), keys=["dataset_id"], at="at", tie="seq")
        return self.table("datasets").join(state.select("dataset_id", "status"), "dataset_id")

    def _row(self, name: str, version: str):
        return self.datasets().filter((F.col("name") == name) & (F.col("version") == version)).first()

    def _known(self, name: str, version: str):
        row = self._row(name, version)
        if row is None:
            raise KeyError(f"no dataset {name} {version}")
        return row

    def _set_status(self, dataset_id: int, status: str, at: dt.datetime | None) -> None:
        self._one(
            "dataset_status", dataset_id=dataset_id, status=status, at=at or _now(), seq=self._next_seq("dataset_status")
        )

    def register(
        self, df: DataFrame, name: str, version: str = "1.0.0", *, domain: str = "custom", description: str = "",
        tags: dict[str, str] | None = None, target: str | None = None, overwrite: bool = False, at: dt.datetime | None = None,
    ) -> int:
        """Clean, snapshot and profile a table; a known (name, version) keeps its id unless overwritten."""
        old = self._row(name, version)
        if old is not None and not overwrite:
            return old["dataset_id"]
        at = at or _now()
        dataset_id = (self.table("datasets").agg(F.max("dataset_id")).first()[0] or 0) + 1
        df = drop_unnamed(df)
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
        text = [c for c in df.columns if c not in numeric]
        features = [c for c in numeric if c != target]
        safe = re.sub(r"[ /]", "_", name)
        path = f"{self.root}/data/name={safe}/version={version}/id={dataset_id}"
        holes = df.agg(F.lit(0).alias("_none"), *[F.count_if(clean(c).isNull()).alias(c) for c in features]).first()
        gaps = [c for c in features if holes[c]]
        (impute_median(df, gaps, keep_types=True) if gaps else df).write.mode("errorifexists").parquet(path)

        snapshot = self.spark.read.parquet(path)
        profile = column_profile(snapshot, numeric, text).withColumn("dataset_id", F.lit(dataset_id))
        self.append("dataset_stats", profile)
        if target and target in snapshot.columns:
            balance = class_balance(snapshot, target).withColumnRenamed(target, "class")
            self.append("class_balance", balance.withColumn("dataset_id", F.lit(dataset_id)))
        if old is not None:
            self._set_status(old["dataset_id"], "deleted", at)
        self._one(
            "datasets", dataset_id=dataset_id, name=name, version=version, domain=domain, description=description,
            file_path=path, n_rows=snapshot.count(), n_cols=len(snapshot.columns), columns=snapshot.columns,
            column_types=dict(snapshot.dtypes), tags=tags or {}, registered_at=at, target_column=target,
        )
        self._set_status(dataset_id, "active", at)
        return dataset_id

    def null_report(self, df: DataFrame, limit: float = 0.30) -> DataFrame:
        """Columns whose share of missing values exceeds the limit."""
        return null_rates(df, df.columns).filter(F.col("null_rate") > limit)

    def load(self, name: str, version: str = "1.0.0") -> DataFrame:
        return self.spark.read.parquet(self._known(name, version)["file_path"])

    def load_latest(self, name: str) -> DataFrame:
        row = R.latest_version(self.datasets().filter(F.col("name") == name)).first()
        if row is None:
            raise KeyError(f"no dataset {name}")
        return self.spark.read.parquet(row["file_path"])

    def list(self, domain: str | None = None, status: str | None = "active", tags: dict[str, str] | None = None) -> DataFrame:
        return R.list_datasets(self.datasets(), domain=domain, status=status, tags=tags)

    def info(self) -> DataFrame:
        """Catalogue rows with nested column statistics."""
        return R.with_column_stats(self.datasets(), self.table("dataset_stats"))

    def column_stats(self, name: str, version: str = "1.0.0") -> DataFrame:
        dataset_id = self._known(name, version)["dataset_id"]
        return self.table("dataset_stats").filter(F.col("dataset_id") == dataset_id)

    def find_compatible(self, required: Sequence[str], domain: str | None = None) -> DataFrame:
        return R.compatible_datasets(self.list(domain), required)

    def archive(self, name: str, version: str = "1.0.0", at: dt.datetime | None = None) -> None:
        self._set_status(self._known(name, version)["dataset_id"], "archived", at)

    def delete(self, name: str, version: str = "1.0.0", at: dt.datetime | None = None) -> None:
        """Hide a dataset from the catalogue; its files stay."""
        self._set_status(self._known(name, version)["dataset_id"], "deleted", at)

    def augment(
        self, name: str, version: str = "1.0.0", *, n: int = 500, noise: float = 0.02, new_version: str = "1.0.0-aug",
        key: Sequence[str], keep: Sequence[str] = (), at: dt.datetime | None = None,
    ) -> int:
        """Register a copy with ``n`` noisy rows added; keys and the target keep their values."""
        row = self._known(name, version)
        df = self.load(name, version)
        fixed = [*key, *keep, *([row["target_column"]] if row["target_column"] else [])]
        types = dict(df.dtypes)
        numeric = [c for c in df.columns if types[c] in ("double", "float") and c not in fixed]
        more = augment(df, numeric=numeric, keep=fixed, n=n, key=key, noise=noise).drop("is_augmented")
        return self.register(
            more, name, new_version, domain=row["domain"], description=f"{row['description']} [augmented +{n} rows]",
            tags=row["tags"], target=row["target_column"], at=at,
        )
