import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lanternfish.session import local_session

    base = tmp_path_factory.mktemp("spark")
    session = local_session(8, **{"spark.sql.warehouse.dir": f"file://{base}/warehouse", "spark.checkpoint.dir": f"file://{base}/shared", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
