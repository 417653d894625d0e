"""Table schemas and the missing-value contract (undefined is NULL, never NaN or a sentinel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

PIXELS = T.StructType([
    T.StructField("field_id", T.LongType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("value", T.DoubleType()),
])
LABELS = T.StructType([
    T.StructField("field_id", T.LongType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("cell_id", T.IntegerType(), False),
    T.StructField("nucleus_id", T.IntegerType()),
])
FIELDS = T.StructType([
    T.StructField("field_id", T.LongType(), False),
    T.StructField("height", T.IntegerType(), False),
    T.StructField("width", T.IntegerType(), False),
    T.StructField("pixel_size_um", T.DoubleType()),
])
EDGES = T.StructType([
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("pubmed_doi", T.StringType()),
    T.StructField("reason", T.StringType()),
])
PRIOR = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("gene", T.StringType(), False),
    T.StructField("rank", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("target", T.StringType()),
    T.StructField("inverse", T.DoubleType()),
])

# Canonical channel names, and the ones that carry an intensity signal.
CHANNELS = ["dapi", "glycocalyx", "yap", "paxillin", "actin", "heparan_sulfate"]
INTENSITY_CHANNELS = ["glycocalyx", "yap", "paxillin", "actin", "heparan_sulfate"]
NUCLEAR_CHANNEL = "dapi"
DEFAULT_PIXEL_SIZE_UM = 0.325


def present(df: DataFrame, cols: list[str]) -> list[str]:
    """The subset of ``cols`` that exists in ``df``, in the given order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Apply the missing-value contract on ingest: NaN and infinities become NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    todo = floats if cols is None else present(df, cols)
    inf = F.lit(float("inf"))
    return df.withColumns({
        c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < inf), F.col(c)) for c in todo
    })


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("field_id", "cell_id", "batch")) -> list[str]:
    """Numeric feature columns: no keys, no batch label, no ``deep_`` embedding columns."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not f.name.startswith("deep_")
    ]
