import os

import pytest

os.environ.setdefault("TZ", "UTC")
root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from wxlake.session import local

    session = local("8", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
