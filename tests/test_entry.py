"""The driver contract: entry() runs on sf0.001 with a stable schema, and
every registered query builds a DataFrame."""

import os
import subprocess
import sys

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from wordspace.plans import catalog

TRAINING = {"train_skip_gram", "train_cbow", "fit_and_query"}  # run by test_training and by entry()
SYNCHRONOUS = {"train_skip_gram_sync", "train_cbow_sync"}  # run by test_oracles


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.schema.simpleString() == "struct<query:string,rank:int,word:string,score:double>"
    rows = df.collect()
    assert len(rows) > 0
    assert all(1 <= r["rank"] <= 10 for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - TRAINING - SYNCHRONOUS))
def test_every_query_builds_a_dataframe(spark, name):
    from pyspark.sql import DataFrame
    df = E.queries()[name](spark, SF_SMALL)
    assert isinstance(df, DataFrame) and df.columns


def test_all_queries_are_registered():
    assert len(catalog.QUERIES) == 52 and set(catalog.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == TRAINING


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """The rest of the repository works where they are not installed."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    import shutil
    for f in ("__spark_entry__.py",):
        shutil.copy(f"{root}/{f}", tmp_path)
    shutil.copytree(f"{root}/wordspace", tmp_path / "wordspace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "wordspace" / "llm" / "__pycache__").mkdir(parents=True)  # an emptied folder may stay
    code = "import __spark_entry__ as e; assert len(e.queries()) == 52 and e.oracle_sql(); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.strip().endswith("fine"), out.stderr
