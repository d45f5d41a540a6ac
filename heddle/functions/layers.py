"""Named expressions, layer by layer, that Spark and any SQL engine read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame

Layers = list[dict[str, str]]


def add(df: DataFrame, layers: Layers) -> DataFrame:
    """``df`` with each layer's columns; a layer may use those before it."""
    for layer in layers:
        df = df.selectExpr("*", *[f"{e} as {n}" for n, e in layer.items()])
    return df


def sql(source: str, layers: Layers) -> str:
    """The same as a nested query over ``source`` (a table name or a query in brackets)."""
    for i, layer in enumerate(layers):
        source = f"(select *, {', '.join(f'{e} as {n}' for n, e in layer.items())} from {source} t{i})"
    return source
