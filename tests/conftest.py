import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wordspace.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    # tests run locally: a scratch checkpoint folder only because none is set
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wordspace-test-ckpt-"))
    yield s
    s.stop()


def lines_df(spark, texts):
    """Lines from literal texts: doc i = texts[i]."""
    from wordspace.sources.corpus import lines_from_table
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return lines_from_table(df)
