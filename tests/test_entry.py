"""The driver's entry points, with and without the training-data operators, and queries against their SQL."""

from __future__ import annotations

import importlib.util
import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from parlance.plans import queries as plans

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_imports_without_the_training_operators(tmp_path):
    shutil.copytree(ROOT / "parlance", tmp_path / "parlance", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_registered_names():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and set(plans.QUERIES) <= set(found)
    if importlib.util.find_spec("parlance.llm"):
        assert {k.split("_")[0] for k in found if k.startswith("op")} >= {f"op{n}" for n in range(1, 14)} and "pipeline" in found


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = base.execute(plans.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in found.fetchall())
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
