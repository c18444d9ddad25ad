"""One spelling per JSON value: sorted keys, no white space, no trailing zeros."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str) -> str:
    try:
        d = Decimal(text)
    except InvalidOperation:
        return text
    if not d.is_finite():
        return text
    if d == 0:
        return "0"
    if abs(d.adjusted()) > 400:
        return str(d.normalize())
    s = format(d, "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


class _Num(str):
    pass


def _write(v) -> str:
    if isinstance(v, _Num):
        return _number(v)
    if isinstance(v, _Obj):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{w}" for k, w in sorted((k, _write(x)) for k, x in v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_write, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


class _Obj(list):
    pass


def canonical_text(text: str) -> str:
    """Reference form; text that is no JSON is kept, stripped of outer white space."""
    try:
        return _write(json.loads(text, parse_float=_Num, parse_int=_Num, parse_constant=_Num, object_pairs_hook=_Obj))
    except (ValueError, RecursionError):
        return text.strip()


def _slow(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else canonical_text(t))


def canonical(payload: Column) -> Column:
    """Canonical JSON of a string column; null stays null.

    Nearly all rows take the JVM path (the variant type sorts keys and strips
    trailing zeros).  Texts with an exponent or an escape, with repeated keys,
    or that are no JSON, take the Python path, which writes the same form.
    """
    plain = F.to_json(F.try_parse_json(payload))
    odd = payload.rlike(r"[0-9][eE][-+]?[0-9]") | payload.contains("\\") | plain.isNull() | payload.rlike(r"[0-9]{16}")
    return F.coalesce(F.pandas_udf(_slow, T.StringType())(F.when(odd, payload)), plain)
