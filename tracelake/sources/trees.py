"""YAML texts as leaves: one (path, JSON text) for each scalar and each empty list or mapping, in a pass over the text.

A path is made of /key and /[place] parts; `~` and `/` inside a key are written ~0 and ~1, so a key that has a slash is no
nested name.  Keys of other types become text; of equal keys the last value stays.  Dates, times, bytes and sets become
their text, and `text` tells real strings from them.  JSON texts have sorted keys.  A text that isn't YAML, or that nests
deeper than the interpreter follows, has no leaves and is not `ok`; one that holds something else than a mapping is `ok`, without leaves.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("text", T.BooleanType())])
TREE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("is_mapping", T.BooleanType()), T.StructField("json", T.StringType()), T.StructField("leaves", T.ArrayType(LEAF))])


def plain(value):
    """value with text as keys, sorted, and text for whatever JSON has no form for."""
    if isinstance(value, dict):
        named = {str(k): v for k, v in value.items()}
        return {k: plain(named[k]) for k in sorted(named)}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def leaves(value, path: str = "") -> list[tuple[str, str, bool]]:
    """(path, JSON text, whether it is a string in the source) of each leaf, in order."""
    parts: list[tuple[str, object]] = []
    if isinstance(value, dict):
        named = {str(k): v for k, v in value.items()}
        parts = [(k.replace("~", "~0").replace("/", "~1"), named[k]) for k in sorted(named)]
    elif isinstance(value, list):
        parts = [(f"[{i}]", v) for i, v in enumerate(value)]
    if parts:
        return [leaf for name, v in parts for leaf in leaves(v, f"{path}/{name}")]
    return [(path, json.dumps(plain(value), ensure_ascii=False), isinstance(value, str))]


@F.pandas_udf(TREE)
def _trees(texts: pd.Series) -> pd.DataFrame:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(text: str | None) -> tuple:
        try:
            value = yaml.load(text, Loader=loader) if text else None  # a safe loader
            if not isinstance(value, dict):
                return True, False, "{}", []
            told = [{"path": p, "value": v, "text": t} for p, v, t in leaves(value)] if value else []
            return True, True, json.dumps(plain(value), ensure_ascii=False), told
        except (yaml.YAMLError, RecursionError, ValueError, TypeError):  # broken, endless, or a date or key that can't be
            return False, False, "{}", []

    return pd.DataFrame([one(t) for t in texts], columns=["ok", "is_mapping", "json", "leaves"])


def tree(text: Column) -> Column:
    """struct(ok, is_mapping, json, leaves) of a YAML text."""
    return _trees(text)
