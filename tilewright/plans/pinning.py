"""Pins every load in a serialized expression to one point in time."""

from __future__ import annotations

import json
import warnings
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions that take a version, those without a point in time, and the query function (fixed values).
LOADS = frozenset({"Image.load", "ImageCollection.load", "Feature.load", "Collection.loadTable"})
UNPINNABLE = frozenset({"FeatureCollection.loadBigQuery"})
QUERY = "FeatureCollection.runBigQuery"
CLAUSE = "FOR SYSTEM_TIME AS OF"
MOST = 10**17


class PinningError(ValueError):
    """The expression, or the time, can't be pinned."""


def invocations(node):
    """Every function invocation in a tree, without recursion, so depth is no limit."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            call = x.get("functionInvocationValue")
            if isinstance(call, dict):
                yield call
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)


def pin(expression: str, micros: int) -> str:
    """The expression with a version for each load that has none; idempotent."""
    if not 0 < micros <= MOST:
        raise PinningError(f"snapshot time {micros} is outside of 1..{MOST} microseconds")
    tree = json.loads(expression)
    for call in list(invocations(tree)):
        name = call.get("functionName")
        if name in LOADS:
            call["arguments"] = {**(call.get("arguments") or {})}
            call["arguments"].setdefault("version", {"constantValue": micros})
        elif name in UNPINNABLE:
            raise PinningError(f"{name} reads no point in time")
        elif name == QUERY:
            query = (call.get("arguments") or {}).get("query")
            text = query.get("constantValue") if isinstance(query, dict) else None
            if not (isinstance(text, str) and CLAUSE in text.upper()):
                at = datetime.fromtimestamp(micros / 1e6, tz=UTC).isoformat()
                raise PinningError(f"{name} needs {CLAUSE} TIMESTAMP('{at}') after each table")
        elif isinstance(name, str) and "loadGeoTIFF" in name:
            warnings.warn(f"{name} can't be pinned; its object must not change during the export", stacklevel=2)
    return json.dumps(tree, separators=(",", ":"))


def pin_column(expression: Column, micros: int) -> Column:
    """Pins a column of expressions; null for what can't be pinned or isn't JSON."""

    def one(x):
        try:
            return pin(x, micros) if x is not None else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(expression)
