"""Registry of trained models: one JSON row per model next to its files."""

from __future__ import annotations

import json
import logging
from hashlib import blake2b

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.operators.subwords import SubwordModel
from nbgauge.operators.trees import TreeModel

logger = logging.getLogger(__name__)

NOT_IN_ID = ("metrics",)
ROW = "model_id string, file_name string, classifier string, info string"


def model_id(info: dict) -> str:
    """Digest of what a model was made from; its metrics do not count."""
    known = {k: v for k, v in info.items() if k not in NOT_IN_ID}
    return blake2b(json.dumps(known, sort_keys=True, default=str).encode(), digest_size=8).hexdigest()


class ModelRegistry:
    """Models of one folder (any file system Spark can reach)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def save(self, model: PipelineModel | TreeModel | SubwordModel, file_name: str, classifier: str, **info) -> str:
        """Write the model and its registry row; the id of the model."""
        entry = {"file_name": file_name, "classifier": classifier, **info}
        key = model_id(entry)
        # By id: another model of the same file name does not replace it.
        path = f"{self.folder}/models/{key}/{file_name}"
        if isinstance(model, TreeModel):
            model.save(path)
        elif isinstance(model, SubwordModel):
            model.save(self.spark, path)
        else:
            model.write().overwrite().save(path)
        row = [(key, file_name, classifier, json.dumps(entry, sort_keys=True, default=str))]
        self.spark.createDataFrame(row, ROW).coalesce(1).write.mode("overwrite").json(f"{self.folder}/rows/{key}")
        return key

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def models(self, classifier: str | None = None) -> DataFrame:
        """All registry rows, or those of one classifier."""
        if not self._exists(f"{self.folder}/rows"):
            return self.spark.createDataFrame([], ROW)
        rows = self.spark.read.schema(ROW).option("recursiveFileLookup", True).json(f"{self.folder}/rows")
        return rows if classifier is None else rows.where(F.col("classifier") == classifier)

    def info(self, key: str) -> dict:
        row = self.models().where(F.col("model_id") == key).first()
        return json.loads(row["info"]) if row else {}

    def load(self, key: str) -> PipelineModel | TreeModel | SubwordModel | None:
        """The model, unless its row does not match its id or its files are gone."""
        info = self.info(key)
        if not info:
            return None
        if model_id(info) != key:
            logger.error("registry row of model %s does not match its id", key)
            return None
        path = f"{self.folder}/models/{key}/{info['file_name']}"
        if not self._exists(path):
            logger.error("files of model %s are missing: %s", key, path)
            return None
        if self._exists(f"{path}/subwords"):
            return SubwordModel.load(self.spark, path)
        return TreeModel.load(self.spark, path) if self._exists(f"{path}/nodes") else PipelineModel.load(path)
