import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="sitelens-test-")


def one_page(spark, html, url="https://example.com/", page_id=1):
    return spark.createDataFrame([(page_id, url, html)], "page_id bigint, url string, html string")


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")
