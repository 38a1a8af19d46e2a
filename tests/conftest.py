import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugebook import build_session  # noqa: E402
from gaugebook.plans.ingest import register_sites  # noqa: E402
from gaugebook.sources.store import Store  # noqa: E402
from gaugebook.schemas import SITE_FEED  # noqa: E402
from support import AS_OF, site_uuid  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "gaugebook-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def add_sites(spark):
    def add(store, *sites):
        """sites: (number, limit text) pairs."""
        rows = [(site_uuid(n), f"Site {n}", limit, None) for n, limit in sites]
        return register_sites(store, spark.createDataFrame(rows, SITE_FEED), as_of=AS_OF)

    return add
