import pytest
from oracle import compare

from siltmark.functions import codecs
from siltmark.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01")


def test_crc32c_golden():
    assert codecs.crc32c_bytes(b"123456789") == 0xE3069283
