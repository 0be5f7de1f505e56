from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="valora-test-")


@pytest.fixture(scope="session")
def spark(scratch):
    from valora.session import local_session
    s = local_session(4, shuffle_partitions=8, checkpoint_dir=os.path.join(scratch, "ckpt"),
                      driver_memory="4g")
    yield s


@pytest.fixture(scope="session")
def house(spark):
    from fixtures import house_table
    return house_table(spark, 300, 7).cache()


@pytest.fixture(scope="session")
def house_signal(spark):
    from fixtures import house_table
    return house_table(spark, 400, 11, signal=True).cache()
