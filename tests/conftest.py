import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from pooltide.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "pooltide-tests", partitions=4)


LEG_COLUMNS = ("coupon_id bigint, position int, odds_1 double, odds_n double, odds_2 double, "
               "share_1 double, share_n double, share_2 double, tip string, result string")


@pytest.fixture(scope="session")
def make_legs(spark):
    def build(rows):
        """rows: (coupon_id, position, odds, shares, tip, result)"""
        flat = [(c, p, *map(float, o), *map(float, s), t, r) for c, p, o, s, t, r in rows]
        return spark.createDataFrame(flat, LEG_COLUMNS)
    return build
