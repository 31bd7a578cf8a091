"""Every query next to its SQL, on the smallest tables."""

import os
import sys

import pytest

from quillstream.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import verify
    return verify.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    import verify
    text, _, good = verify.compare(spark, con, name, registry.QUERIES[name], registry.ORACLE.get(name), FOLDER)
    assert good, text
