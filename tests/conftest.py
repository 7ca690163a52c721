import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from plotline.session import importable, local_session

    s = local_session(cores="4", shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield importable(s)
    s.stop()
