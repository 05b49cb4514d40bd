import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    folder = tmp_path_factory.mktemp("shared")
    s = build_session("tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
                      spark__checkpoint__dir=str(folder))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
