"""Sends this package to the Python workers, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="vellum-ship-")) / "vellumspark_src.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(where))
    _sent.add(app)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def entity_decoder():
    """HTML entities by Python's table, in Arrow batches."""
    import pandas as pd
    from pyspark.sql import functions as F

    def decode(s: pd.Series) -> pd.Series:
        import html

        return s.map(html.unescape, na_action="ignore")

    decode.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, "string")
