import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from reelsight.session import get_session
    s = get_session("local[4]", 8)
    yield s


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)
