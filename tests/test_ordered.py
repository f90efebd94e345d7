"""The bucketed scans against the plain ones, with buckets made tiny."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirador.operators.ordered import Running, ordered_rank, quantiles, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    return spark.createDataFrame(pd.DataFrame({
        "g": np.where(rng.random(n) < 0.5, 0, rng.integers(0, 9, n)),  # half the rows in one group
        "v": np.where(rng.random(n) < 0.3, 1.5, np.round(rng.normal(size=n), 1)),  # a long tie, −0.0
        "id": np.arange(n),
    })).withColumn("half", F.when(F.col("id") % 3 == 0, F.col("id")))


COLUMNS = [
    Running("total", "sum", "id"), Running("ahead", "sum", "id", before=True),
    Running("seen", "max", "half"), Running("next", "min", "half", back=True),
    Running("low", "min", "id", back=True), Running("high", "max", "id", before=True),
]


@pytest.mark.parametrize("by", [["g"], []])
def test_running_is_the_same_in_buckets(rows, by):
    plain = running(rows, by, "v", COLUMNS, tie="id").toPandas().sort_values("id", ignore_index=True)
    cut = running(rows, by, "v", COLUMNS, tie="id", rows_per_bucket=90)
    pd.testing.assert_frame_equal(plain, cut.toPandas().sort_values("id", ignore_index=True))


def test_running_against_pandas(rows):
    got = running(rows, ["g"], "v", COLUMNS[:1], tie="id", rows_per_bucket=100).toPandas()
    pdf = got.sort_values(["g", "v", "id"])
    assert (pdf.groupby("g")["id"].cumsum() == pdf["total"]).all()


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_in_buckets(rows, by):
    probs = {"q": 0.25, "m": 0.5, "t": 0.9, "lo": 0.0, "hi": 1.0}
    plain = quantiles(rows, by, "v", probs).toPandas()
    cut = quantiles(rows, by, "v", probs, rows_per_bucket=20).toPandas()
    if by:
        plain, cut = (f.sort_values(by, ignore_index=True) for f in (plain, cut))
    pd.testing.assert_frame_equal(plain, cut)


def test_rank_is_a_permutation(rows):
    got = ordered_rank(rows.select("id", "v"), "v", "id", rows_per_bucket=70).toPandas()
    want = got.sort_values(["v", "id"])["rank"].tolist()
    assert want == list(range(1, len(got) + 1))
