import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        # Two attempts per task, so that tests can lose one.
        SparkSession.builder.master("local[4,2]")
        .appName("millrace-tests")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def csv_file(tmp_path):
    """Write a small CSV file and return its path."""

    def write(name, *lines, end="\n"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(line + end for line in lines))
        return str(path)

    return write


@pytest.fixture
def plan_of():
    """The physical plan Spark would start with, as text."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
