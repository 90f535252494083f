from __future__ import annotations

import pytest

from tributary.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
