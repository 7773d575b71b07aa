"""Writing results: JSON files, GeoJSON, Parquet and Markdown."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.functions.scalar import markdown


def json_value(value: object) -> object:
    """Rows, mappings, sequences and plain values as what JSON can hold; keys become text, other types raise."""
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    if dataclasses.is_dataclass(value):
        return json_value(dataclasses.asdict(value))
    if hasattr(value, "asDict"):
        return json_value(value.asDict(recursive=True))
    if isinstance(value, Mapping):
        return {str(k): json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_value(v) for v in value]
    raise TypeError(f"{type(value).__name__} can't be written as JSON")


def save_result_json(result: object, path: str | Path) -> Path:
    """One result as an indented UTF-8 file; folders are made as needed."""
    if not isinstance(result, Mapping) and not hasattr(result, "asDict"):
        raise TypeError("a result is a mapping or a row")
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(json_value(result), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return path


def as_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")
    )


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    as_json_lines(df).write.mode(mode).text(path)


def write_feature_collection(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Feature a line (newline-delimited GeoJSON): no task has to hold the whole collection."""
    features.select(F.col("feature").alias("value")).write.mode(mode).text(path)


def feature_collection(features: DataFrame, most: int = 100_000) -> dict:
    """The features, at most `most`, as one collection on the driver."""
    rows = features.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features; write them with write_feature_collection")
    return {"type": "FeatureCollection", "features": [json.loads(r["feature"]) for r in rows]}


def to_markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a result of at most `most` rows; more raise."""
    rows = df.select(*[markdown(F.col(f"`{c}`")).alias(c) for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with write_json_lines")
    return "\n".join(
        [
            "| " + " | ".join(df.columns) + " |",
            "|" + "---|" * len(df.columns),
            *("| " + " | ".join(r) + " |" for r in rows),
        ]
    )
