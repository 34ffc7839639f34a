import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from quotemill.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    session = local_session(4, "tests", **{"spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(where / "warehouse"), "spark.checkpoint.dir": f"file://{where}/checkpoints", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(DATA).iterdir():
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from read_parquet('{where}')")
    return con
