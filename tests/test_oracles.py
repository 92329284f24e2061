"""Every query of the library against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import oracle
from sparkome.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert (diff := oracle.difference(con, SQL[name], QUERIES[name](spark, SF))) is None, diff


def test_sql_source_with_executors_of_their_own(con, tmp_path):
    """In a cluster, the driver's memory isn't the executors'."""
    import pyspark

    home = tmp_path / "home"  # executors work below it
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
from sparkome.plans import catalog
conf = {{"spark.master": "local-cluster[2,1,512]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
catalog.queries()["s9_sql_source"](spark, "{SF}").write.parquet("{tmp_path}/out")
"""
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parent.parent), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env, timeout=300)
    assert out.returncode == 0, out.stderr[-4000:]
    got = con.execute(f"SELECT key, name FROM '{tmp_path}/out/*.parquet' ORDER BY ALL").fetchall()
    assert got == con.execute(f"SELECT * FROM ({SQL['s9_sql_source']}) ORDER BY ALL").fetchall() != []


@pytest.mark.parametrize("gone", [("sparkome/llm",), ("sparkome/llm", "corpus_pipeline.py")])
def test_entry_points_without_the_optional_parts(gone, tmp_path):
    """A copy of the repository without them still loads, with the library's own queries."""
    root = Path(__file__).resolve().parent.parent
    for part in ("sparkome", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / part).is_dir():
            shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / part).exists():
            shutil.copy(root / part, tmp_path / part)
    for part in gone:
        path = tmp_path / part
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(QUERIES)


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
