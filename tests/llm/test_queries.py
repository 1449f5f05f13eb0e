"""The registered queries against their SQL, and their contracts' columns and laws."""

import os
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest, type_mismatches
from wordspace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    assert type_mismatches(df.dtypes, rel.columns, rel.types) == []
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, rows) == digest(rel.columns, rel.fetchall())


COLUMNS = {
    "op1_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op3_mix_sources": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint "
                       "pieces:array<struct<shard:int,place:int,words:bigint>>",
    "op4_top_k": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op5_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op6_vector_dedup": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op7_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_hilbert_shards": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op10_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op11_decontaminate": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op12_collocations": "lang:string rank:bigint phrase:string a:bigint l:bigint r:bigint n:bigint score:bigint",
    "op13_vector_codes": "vec_id:bigint code:string error:bigint label_error:bigint codebooks_sha256:string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = E.queries()[name](spark, SF)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == COLUMNS[name]
    rows, n = df.collect(), spark.read.parquet(f"{SF}/documents.parquet").count()
    if "doc_id" in df.columns:
        assert len(rows) == n
    if "held_out" in df.columns:
        folds, fold = (5, 0) if name == "op1_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in rows)
    if name == "op9_hilbert_shards":
        count = Counter(r.shard for r in rows)
        assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    if name == "op10_simhash":
        assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)


def test_all_operators_and_the_pipeline():
    names = set(E.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
