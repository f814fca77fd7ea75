"""Results of several pieces of a document made one, and the schema of results."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_results(results: list[dict[str, Any]]) -> dict[str, Any]:
    """Lists are joined without repeats, objects filled where they lack a value, of other values the first not null stays."""
    if len(results) == 1:
        return results[0]
    out: dict[str, Any] = {}
    for name in dict.fromkeys(k for r in results for k in r):
        value: Any = None
        for i, new in enumerate(r[name] for r in results if name in r):
            if i == 0 or value is None:
                value = new
            elif isinstance(value, list) and isinstance(new, list):
                value = list({str(x): x for x in reversed([*value, *new])}.values())[::-1]
            elif isinstance(value, dict) and isinstance(new, dict):
                value = {**value, **{k: v for k, v in new.items() if value.get(k) is None}}
        out[name] = value
    return out


def infer_schema(data: Any) -> dict[str, Any]:
    """JSON schema of a record, or of the first of a list of records."""
    if isinstance(data, list):
        return {"type": "array", "items": _of(data[0]) if data else {"type": "object"}}
    return _of(data)


def _of(value: Any) -> dict[str, Any]:
    match value:
        case None:
            return {"type": ["string", "null"]}
        case bool():
            return {"type": "boolean"}
        case int():
            return {"type": "integer"}
        case float():
            return {"type": "number"}
        case list():
            return {"type": "array", "items": _of(value[0]) if value else {"type": "string"}}
        case dict():
            return {"type": "object", "properties": {k: _of(v) for k, v in value.items()}, "required": list(value), "additionalProperties": False}
    return {"type": "string"}


def merged_json(results: Column) -> Column:
    """Merge of an array of JSON objects; pieces that are no objects are passed over, none gives {}."""

    def one(items: Any) -> str | None:
        if items is None:
            return None
        found = []
        for x in items:
            try:
                value = json.loads(x) if x is not None else None
            except ValueError:
                continue
            if isinstance(value, dict):
                found.append(value)
        return json.dumps(merge_results(found) if found else {}, ensure_ascii=False, sort_keys=True)

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in series], dtype=object)

    return F.pandas_udf(run, T.StringType())(results)


def schema_json(record: Column) -> Column:
    """Schema of a JSON record or list; null for invalid JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(infer_schema(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return None

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in series], dtype=object)

    return F.pandas_udf(run, T.StringType())(record)
