"""Every query against DuckDB, and the contract of the entry module."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from resona.plans import catalogue, checked, files, signals  # noqa: F401

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(float(v) + 0.0) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, small, name):
    df = catalogue.QUERIES[name](spark, small)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", ["splice_candidates_synth", "cpps_synth", "residual_synth", "context_json", "residual_score", "enf_synth", "pca_project"])
def test_other_queries_run(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_entry_without_the_training_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "resona"):
        os.symlink(ROOT / p, tmp_path / p) if p.endswith(".py") else None
    package = tmp_path / "resona"
    package.mkdir()
    for p in (ROOT / "resona").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, package / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'min_dcf_overall' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    (tmp_path / "entry.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
