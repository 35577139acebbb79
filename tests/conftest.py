import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlstone.session import session

    s = session("tests", 4, spark_sql_shuffle_partitions=4, spark_driver_memory="4g", spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
