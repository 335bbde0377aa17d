"""Calls of Java methods and Python functions by name."""

from __future__ import annotations

import importlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship

TYPES = {"string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double"}


def invoke_static(method: str, *args: Column, returns: str = "string", safe: bool = False) -> Column:
    """package.Class.method of the JVM on args; returns: string, int, long, float or double. safe: null for exceptions."""
    if returns not in TYPES:
        raise ValueError(f"can't return {returns}")
    cls, _, name = method.rpartition(".")
    if not cls:
        raise ValueError(f"{method} names no class")
    call = F.try_reflect if safe else F.reflect
    return call(F.lit(cls), F.lit(name), *args).cast(TYPES[returns])


def invoke_instance(method: str, target: Column, *args: Column, returns: str = "string") -> Column:
    """A method of each value of target, in Python: `str.upper`, `str.replace`; arguments follow it, all of them."""
    return invoke_python(f"builtins.{method}" if method.count(".") == 1 else method, target, *args, returns=returns)


def invoke_python(name: str, *args: Column, returns: str = "string", spark=None) -> Column:
    """module.function (or module.Class.method) on args, in batches; a null argument gives null. Arrays come as lists."""
    if returns not in TYPES:
        raise ValueError(f"can't return {returns}")
    parts = name.split(".")
    if len(parts) < 2:
        raise ValueError(f"{name} names no module")
    if spark is not None:
        ship(spark)

    def call(*columns: pd.Series) -> pd.Series:
        for n in range(len(parts) - 1, 0, -1):
            try:
                f = importlib.import_module(".".join(parts[:n]))
                break
            except ImportError:
                continue
        for p in parts[n:]:
            f = getattr(f, p)
        plain = [[v.tolist() if hasattr(v, "tolist") else v for v in c] for c in columns]
        return pd.Series([None if any(v is None or v is pd.NA for v in row) else f(*row) for row in zip(*plain)])

    return F.pandas_udf(call, TYPES[returns])(*args)
