import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def spark():
    from loomline.session import local_session

    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
