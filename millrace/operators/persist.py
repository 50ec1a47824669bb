"""Models in files: one JSON row, written and read by Spark."""

from __future__ import annotations

import dataclasses
import importlib
import json

import numpy as np
from pyspark.sql import SparkSession


def _encode(x):
    if dataclasses.is_dataclass(x):
        return {"type": f"{type(x).__module__}:{type(x).__name__}", "fields": {f.name: _encode(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "shape": list(x.shape)}
    if isinstance(x, dict):
        return {"items": [[_encode(k), _encode(v)] for k, v in x.items()]}
    if isinstance(x, (list, tuple)):
        return {"tuple" if isinstance(x, tuple) else "list": [_encode(v) for v in x]}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise TypeError(f"a {type(x).__name__} cannot be saved")


def _decode(x):
    if not isinstance(x, dict):
        return x
    if "type" in x:
        module, name = x["type"].split(":")
        if not module.startswith("millrace.operators."):
            raise ValueError(f"{module} holds no models")
        return getattr(importlib.import_module(module), name)(**{k: _decode(v) for k, v in x["fields"].items()})
    if "array" in x:
        return np.array(x["array"], float).reshape(x["shape"])
    if "items" in x:
        return {_decode(k): _decode(v) for k, v in x["items"]}
    return tuple(map(_decode, x["tuple"])) if "tuple" in x else [_decode(v) for v in x["list"]]


def save(spark: SparkSession, model, path: str) -> None:
    """Writes a fitted model (not one that holds a table or a Python function) to a new folder."""
    spark.createDataFrame([(json.dumps(_encode(model)),)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str):
    return _decode(json.loads(spark.read.text(path, wholetext=True).first()["value"]))
