import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import session

    work = tempfile.mkdtemp(prefix="spark-")
    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.local.dir": work,
            "spark.sql.warehouse.dir": f"{work}/warehouse",
            "spark.checkpoint.dir": f"file://{work}/shared",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
