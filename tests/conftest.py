import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from mixlens.session import get_spark, checkpoint_dir
    s = get_spark(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def series_df(spark, values, key="a", col="x"):
    """One key, consecutive dates, given values (None allowed)."""
    import datetime as dt
    start = dt.date(2020, 1, 1)
    rows = [(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, date date, {col} double")


def column(df, col, order="date"):
    return [r[0] for r in df.orderBy(order).select(col).collect()]
