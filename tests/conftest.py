import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    shared = tmp_path_factory.mktemp("shared")
    session = (SparkSession.builder.master("local[8]").appName("doclake-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
               .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def job_rows(spark):
    """Make a job table from partial rows."""
    from pyspark.sql import Row
    schema = ("id string, session_id string, filename string, sha256 string, opts_hash string, status string, "
              "page_total int, started_at double, finished_at double, error string, result_dir string, "
              "n_tables int, n_images int, attempts int, created_at double")
    base = dict(session_id="s1", filename="report.pdf", sha256="aa", opts_hash="oo", status="queued", page_total=3,
                started_at=None, finished_at=None, error=None, result_dir=None, n_tables=None, n_images=None,
                attempts=0, created_at=100.0)
    names = [f.split()[0] for f in schema.split(", ")]

    def make(*rows):
        return spark.createDataFrame([Row(**{n: {**base, **r}[n] for n in names}) for r in rows], schema)
    return make
