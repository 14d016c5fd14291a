import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = local_session("tests", "8", **{"spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": str(home / "shared"), "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
