"""Embedding providers by name; the offline default hashes character 3-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

DIMS = 128
PROVIDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def provider(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        PROVIDERS[name] = f
        return f

    return add


@provider("hashed")
def hashed(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed 3-gram counts; similar spellings are near. Blank text is the zero vector."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(f"  {t.lower().strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64) if t.strip() else np.empty(0, np.uint64)
        if len(raw) >= 3:
            h = ((raw[:-2] * np.uint64(1000003) + raw[1:-1]) * np.uint64(1000003) + raw[2:]) * np.uint64(0x9E3779B97F4A7C15)
            np.add.at(out[i], (h >> np.uint64(57)).astype(np.int64), np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(df: DataFrame, text_col: str, name: str = "hashed") -> DataFrame:
    """(text, embedding) of the distinct texts of a column; each is embedded once."""
    ship(df.sparkSession)
    f = PROVIDERS[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(f(s.tolist())))

    return df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct().withColumn("embedding", run("text"))
