import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from helpers import SMALL  # noqa: E402
from sellerscope.schema import SCHEMAS  # noqa: E402
from sellerscope.session import build_session  # noqa: E402
from sellerscope.sources.testdata import from_testdata  # noqa: E402
from sellerscope.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "sellerscope-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("staging")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def generated(spark):
    return from_testdata(spark, SMALL)


@pytest.fixture
def make(spark):
    """Build Tables from short row lists, padding what a row leaves out with missing values."""

    def table(name, rows):
        schema = SCHEMAS[name]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    def build(**rows):
        names = [n for n in SCHEMAS if n != "geolocation"]
        return Tables(**{n: table(n, rows.get(n, [])) for n in names})

    return build
