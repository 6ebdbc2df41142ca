"""Canonical JSON (RFC 8785) and its SHA-256, batched over rows."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number(x: float) -> str:
    """A float as ECMAScript prints it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa
    power = int(exponent)
    if -7 <= power < 0:
        return f"{x:.{len(mantissa.replace('-', '').replace('.', '')) - 1 - power}f}"
    return f"{mantissa}e{power:+d}"


def canonical(value) -> str:
    """Keys sorted by UTF-16 code units, no spaces, shortest numbers."""
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(v) for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_sha256(text: pd.Series) -> pd.Series:
    """Hash of the canonical form of JSON text, null when it is not JSON."""

    def digest(t):
        try:
            return hashlib.sha256(canonical(json.loads(t)).encode("utf-8")).hexdigest()
        except (TypeError, ValueError):
            return None

    return text.map(digest)
