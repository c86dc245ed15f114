"""Small frames from plain rows."""

import pandas as pd


def make(spark, rows, schema):
    """Spark takes datetimes, not pandas' timestamps."""
    plain = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row) for row in rows]
    return spark.createDataFrame(plain, schema)
