"""A fitted plan as one folder: a document of what was learned and a Parquet table for each stored one.

The document is written last, so a folder without it was never finished. It names its version; another
one is refused. Nothing in the folder points to scratch tables, so they can be released.
"""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from scrubline.operators.currency import CurrencyFit
from scrubline.operators.detect import TypeRoles
from scrubline.operators.forest import ForestFit
from scrubline.operators.impute import NumericFit
from scrubline.operators.neighbours import Boxes, Deal, Donors, Tree, View
from scrubline.operators.rules import RuleFit
from scrubline.operators.typed import TypeFit
from scrubline.plans.pipeline import CleaningPlan, LearnedFit

VERSION = 1
KINDS = {k.__name__: k for k in (
    CleaningPlan, RuleFit, TypeFit, TypeRoles, CurrencyFit, LearnedFit, NumericFit, ForestFit, Donors, Tree, Boxes, Deal, View,
)}
#: What builds a kind from its fields.
MAKERS = {**KINDS, "Tree": Tree.of}


def save_plan(plan: CleaningPlan, spark: SparkSession, path: str) -> None:
    """Write the plan to a new folder; one that exists is refused."""
    root = path.rstrip("/")
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(f"{path} exists already")
    tables = 0

    def plain(value):
        nonlocal tables
        if value is None or isinstance(value, (bool, int, float, str)):
            return value
        if isinstance(value, np.generic):
            return value.item()
        if isinstance(value, DataFrame):
            name, tables = f"table-{tables}", tables + 1
            value.write.parquet(f"{root}/{name}")
            return {"table": name, "schema": value.schema.json()}
        if isinstance(value, np.ndarray):
            return {"array": value.ravel().tolist(), "type": str(value.dtype), "shape": list(value.shape)}
        if isinstance(value, list):
            return [plain(v) for v in value]
        if isinstance(value, tuple):
            return {"tuple": [plain(v) for v in value]}
        if isinstance(value, dict):
            return {"pairs": [[plain(k), plain(v)] for k, v in value.items()]}
        if is_dataclass(value) and type(value).__name__ in KINDS:
            return {"kind": type(value).__name__, "fields": {f.name: plain(getattr(value, f.name)) for f in fields(value)}}
        raise TypeError(f"a plan holds no {type(value).__name__}")

    document = json.dumps({"version": VERSION, "plan": plain(plan)})
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(f"{root}/plan")


def load_plan(spark: SparkSession, path: str) -> CleaningPlan:
    """The plan of a folder that ``save_plan`` wrote, in any session."""
    from pyspark.sql.types import StructType

    root = path.rstrip("/")
    document = json.loads(spark.read.text(f"{root}/plan", wholetext=True).first()["value"])
    if document["version"] != VERSION:
        raise ValueError(f"{path} has version {document['version']}, this library reads {VERSION}")

    def built(value):
        if isinstance(value, list):
            return [built(v) for v in value]
        if not isinstance(value, dict):
            return value
        if "table" in value:
            schema = StructType.fromJson(json.loads(value["schema"]))
            return spark.read.schema(schema).parquet(f"{root}/{value['table']}")
        if "array" in value:
            return np.array(value["array"], dtype=value["type"]).reshape(value["shape"])
        if "tuple" in value:
            return tuple(built(v) for v in value["tuple"])
        if "pairs" in value:
            return {built(k): built(v) for k, v in value["pairs"]}
        return MAKERS[value["kind"]](**{k: built(v) for k, v in value["fields"].items()})

    return built(document["plan"])
