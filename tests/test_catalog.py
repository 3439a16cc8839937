"""The registered queries as a set, and some of them against their SQL on the small tables."""

from __future__ import annotations

import inspect
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from corpusmill.plans.catalog import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark labels conversations".split()
SAMPLE = (
    "chunk_fixed", "page_chunks", "legal_chunks", "cross_references", "bm25_topk", "metadata_filter_topk",
    "filter_only_listing", "rrf_hybrid", "prompt_assembly", "answer_scores", "bench_sample", "run_rows_log", "kpi_all_groups",
    "fts_topk_stemmed", "responses", "agent_trace", "log_tables_round_trip", "dataset_round_trip", "report_files", "config_outcomes",
)


def test_registry_is_consistent():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 70
    assert set(registry.queries()) == set(registry.oracle_sql())
    for run in queries.values():
        assert list(inspect.signature(run).parameters)[0] == "spark" and len(inspect.signature(run).parameters) == 2


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    wanted = database.sql(f"SELECT {listed} FROM ({entry_module.oracle_sql()[name]}) AS t").fetchall()

    def plain(row):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

    got = [plain(row) for row in frame.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(map(plain, wanted), key=repr)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")
def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["query_id", "rank", "chunk_id", "score"] and frame.count() > 0


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.entry(spark).count() > 0)
"""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")
def test_workers_get_the_package(tmp_path):
    """Python workers import the package although neither it nor the repository is on their path."""
    script = ELSEWHERE.format(repo=str(Path(entry_module.__file__).parent))
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={name: value for name, value in os.environ.items() if name != "PYTHONPATH"},
    )
    assert "rows True" in done.stdout, done.stderr[-2000:]
