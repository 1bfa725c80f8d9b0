import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark import cloudpickle

    import cuespark
    from cuespark.session import local_session

    cloudpickle.register_pickle_by_value(cuespark)
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
    }
    return local_session("8", "tests", settings)


@pytest.fixture
def texts(spark):
    """A function from strings to a (post_id, raw_text) table."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "post_id bigint, raw_text string")

    return make


def column(df, name):
    """Values of a column by post_id."""
    return [r[name] for r in sorted(df.select("post_id", name).collect())]
