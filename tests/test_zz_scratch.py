"""Runs last: it deletes what the other tests stored."""

import pytest

from presswork import session
from presswork.plans import fixtures


def test_drop_scratch(spark):
    df = session.stored(spark.range(3), "numbers")
    assert df.count() == 3
    session.drop_scratch(spark)
    fixtures._DIMENSIONS.clear()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        df.count()
