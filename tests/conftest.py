import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from switchyard.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[4]", 4, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
