import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("FINFACTS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from finfacts.session import build_session

    session = build_session(
        "finfacts-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def oracle(sf_dir):
    from finfacts.checks.compare import oracle_connection

    return oracle_connection(sf_dir)


@pytest.fixture
def facts_of(spark):
    """Facts from ``(rssd_id, quarter_date, code, value_raw)`` tuples."""
    from finfacts.functions.numeric import strict_number

    def build(rows):
        frame = spark.createDataFrame(rows, "rssd_id string, quarter_date string, code string, value_raw string")
        return frame.withColumn("value_num", strict_number("value_raw"))

    return build
