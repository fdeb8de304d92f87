import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerloom.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("shared")
    session = local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{base}", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{base}/warehouse"})
    yield session
    session.stop()
