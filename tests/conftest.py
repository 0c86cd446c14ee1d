import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from check import session
    made = session()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def tight(spark):
    """Bounds so low that operators take their large-data way."""
    names = {"plumbline.groupRows": "60", "plumbline.broadcastRows": "20", "plumbline.chunkRows": "16"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)
