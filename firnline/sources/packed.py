"""Packed binary records: layouts as text, decoded by structured dtypes inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few

SPARK = {"i1": "smallint", "u1": "smallint", "i2": "int", "u2": "int", "i4": "bigint", "u4": "bigint", "i8": "bigint", "u8": "decimal(20,0)"}


@dataclass(frozen=True)
class Field:
    name: str
    code: str
    count: int = 1
    scale: float = 1.0


def layout(text: str) -> list[Field]:
    """Lines or comma-separated items ``name type[*count] [scale]``."""
    out = []
    for item in text.replace("\n", ",").split(","):
        p = item.split()
        if p:
            code, _, n = p[1].partition("*")
            out.append(Field(p[0], code, int(n or 1), float(p[2]) if len(p) > 2 else 1.0))
    return out


def dtype(fields: list[Field], order: str = ">") -> np.dtype:
    return np.dtype([(f.name, order + f.code, (f.count,)) if f.count > 1 else (f.name, order + f.code) for f in fields])


def schema(fields: list[Field], unpack: bool, prefix: str = "") -> str:
    def kind(f: Field) -> str:
        k = "double" if unpack and f.scale != 1 else SPARK[f.code]
        return f"array<{k}>" if f.count > 1 else k

    return ", ".join(f"`{prefix}{f.name}` {kind(f)}" for f in fields)


def columns(rec: np.ndarray, fields: list[Field], unpack: bool, prefix: str = "") -> dict[str, list]:
    """Python columns of decoded records; scaled where a field has a scale."""
    out = {}
    for f in fields:
        v = rec[f.name]
        if unpack and f.scale != 1:
            v = v * f.scale
        elif f.code == "u8":
            from decimal import Decimal

            v = np.array([Decimal(int(x)) for x in v.ravel()], dtype=object).reshape(v.shape)
        elif v.dtype.byteorder == ">":
            v = v.astype(v.dtype.newbyteorder("="))
        out[prefix + f.name] = list(v) if f.count > 1 else v.tolist()
    return out


def decode_binary(files: DataFrame, decode: Callable[[str, bytes], pd.DataFrame], fields: str) -> DataFrame:
    """Rows of files given as ``path, content``; a file is decoded in the task that holds it.

    ``decode(path, content)`` must return the columns of ``fields``; ``source_file`` is added.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for p, content in zip(d.path, d.content):
                out = decode(p, bytes(content))
                out["source_file"] = p
                yield out

    return files.select("path", "content").mapInPandas(run, f"{fields}, source_file string")


def read_binary(spark: SparkSession, path: str, decode: Callable[[str, bytes], pd.DataFrame], fields: str) -> DataFrame:
    """The same for every file below ``path``."""
    return decode_binary(spark.read.format("binaryFile").load(path), decode, fields)


def parted(rows: DataFrame, file: list[str], order: list[str], most: int = 50_000, name: str = "part") -> DataFrame:
    """``name``: number of the part of about ``most`` rows that a row's file is cut into, so that each part fits a task.

    Rows are spread by a hash of ``order``; a file of few rows has part 0 only.
    """
    size = rows.groupBy(*file).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))  # one row per file
    same = [F.col(f).eqNullSafe(F.col(f"_of_{f}")) for f in file]
    size = size.select(*[F.col(f).alias(f"_of_{f}") for f in file], "_parts")
    cut = rows.join(broadcast_if_few(size), reduce(lambda a, b: a & b, same)).withColumn(name, F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int"))
    return cut.drop("_parts", *[f"_of_{f}" for f in file])


def encode_binary(rows: DataFrame, file: list[str], order: list[str], encode: Callable[[pd.DataFrame], bytes], path: Callable[[tuple], str]) -> DataFrame:
    """``path, content``: the rows of each file packed by ``encode`` (a file must fit a task, see ``parted``)."""

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [path(key)], "content": [encode(d.sort_values(order))]})

    return rows.groupBy(*file).applyInPandas(run, "path string, content binary")
