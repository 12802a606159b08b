"""Model inference on row/column energies with a user-supplied predict function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION = T.StructType(
    [T.StructField("local_y", T.DoubleType()), T.StructField("depth", T.DoubleType())]
)


def predict_positions(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]],
    signals: str = "signals",
    category_y: str | None = None,
    category_depth: str | None = None,
) -> DataFrame:
    """Add ``local_y`` and ``depth`` predicted from an array column of energies and two category columns.

    ``load`` runs once per task and returns ``predict(category_y, signals, category_depth)`` on batches; a model
    without depth output returns None for it. Categories default to 0. Batches are as large as
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for cat_y, cat_depth, values in batches:
            matrix = np.stack(values.to_numpy()) if len(values) else np.zeros((0, 0))
            y, depth = model(cat_y.to_numpy(), matrix, cat_depth.to_numpy())
            empty = np.full(len(values), np.nan)
            yield pd.DataFrame(
                {
                    "local_y": np.asarray(y, dtype=float).reshape(-1),
                    "depth": empty if depth is None else np.asarray(depth, dtype=float).reshape(-1),
                }
            )

    def category(name: str | None):
        return F.lit(0) if name is None else F.col(name)

    called = predict(category(category_y), category(category_depth), F.col(signals))
    out = df.withColumn("_p", called)
    return out.withColumns({"local_y": F.col("_p.local_y"), "depth": F.col("_p.depth")}).drop("_p")
