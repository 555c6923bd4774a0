"""Search of a key at any depth of a JSON document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

FOUND = StructType([StructField("found", BooleanType()), StructField("value", StringType())])


def _first(document, key: str) -> tuple[bool, object]:
    """The key's value in the object itself, else in the first part, in order, that holds it; a stack replaces recursion."""
    stack = [document]
    while stack:
        part = stack.pop()
        if isinstance(part, dict):
            if key in part:
                return True, part[key]
            stack += reversed(part.values())
        elif isinstance(part, list):
            stack += reversed(part)
    return False, None


def find_key(document: Column, key: str) -> Column:
    """found and value (as JSON, null for an explicit null) of ``key`` in a JSON string; text that is no JSON holds nothing."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                held, value = _first(json.loads(text), key) if text else (False, None)
            except ValueError:
                held, value = False, None
            out.append((held, None if value is None else json.dumps(value, ensure_ascii=False)))
        return pd.DataFrame(out, columns=["found", "value"])

    return found(document)
