"""The entry points, and the queries whose oracles run quickly, against DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["cutoff_year", "n_nodes", "n_edges"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["merge_dedupe_papers", "clean_papers", "quad_verdicts", "graph_edges", "snapshot_summary", "link_positives", "roc_auc", "merge_candidates", "gap_report", "evaluation_metrics", "graph_file", "merge_map_file", "prompt_texts", "extracted_quads", "json_tolerant_scan"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "nation part supplier lineitem events documents embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry_points.queries()[name](spark, SF)
    rel = con.sql(entry_points.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(rel.columns)
    pick = [rel.columns.index(c) for c in order]
    key = lambda r: tuple(repr(round(x, 5)) if isinstance(x, float) else repr(x) for x in r)
    assert sorted(key(r) for r in got.select(*order).collect()) == sorted(key([r[i] for i in pick]) for r in rel.fetchall())


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_lives_without_the_text_operators(tmp_path, pipeline):
    root = Path(entry_points.__file__).parent
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (root / "corpus_pipeline.py").exists()):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clean_papers' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
