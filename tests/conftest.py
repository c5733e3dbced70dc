import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmap.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def small_cells(monkeypatch):
    """Tiny blocks and cells, so that small fixtures cross many of them."""
    from corpusmap.operators import cells, copies, hierarchy, lsh, simjoin

    for module in (cells, copies, hierarchy):
        monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(cells, "CELL_ROWS", 12)
    monkeypatch.setattr(simjoin, "POSTING_BLOCK", 8)
    return lsh
