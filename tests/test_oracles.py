"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import numpy as np
import pandas as pd
import pytest

from docsheaf import catalog
from tests.conftest import SF
from tests.test_plain import PLAIN


def plain(x):
    if isinstance(x, list | tuple | np.ndarray):
        return str([plain(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, float | np.floating):
        return str(int(x)) if float(x).is_integer() else repr(float(x))
    return str(x)


def rows(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_compared():
    """Queries without SQL are compared with plain versions in test_plain.py."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == PLAIN
