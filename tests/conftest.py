import tempfile

import pytest

from spanloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="spark-")
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.local.dir": own, "spark.checkpoint.dir": f"{own}/shared", "spark.sql.warehouse.dir": f"{own}/warehouse", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
