"""The driver's entry points, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_sql_or_a_reason():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys()
    assert not [q for q in queries.keys() - sql.keys() if not q.startswith("op") and q != "pipeline"]


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "gridweave"), tmp_path / "gridweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spmv_csr' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_without_a_library_that_the_training_data_part_needs():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'spmv_csr' in q and 'op5_warc' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True, timeout=120)


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).columns == ["i0", "val"]
