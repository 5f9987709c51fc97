"""The shared folder and its tables; the entry point without what the corpus operators need."""

import os
import subprocess
import sys

import pytest

from colonnade import store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())


def test_scratch_deletes_all_but_what_is_kept(spark):
    there = lambda df: [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    with store.scratch(spark) as outer:
        first = store.materialize(spark.range(5), "first")
        with store.scratch(spark) as inner:
            second = store.materialize(first.selectExpr("id + 1 as id"), "second")
            third = inner(second.selectExpr("id * 2 as id"), "third")
        assert there(first) and there(third) and not there(second)
        last = outer(third, "last")
    assert not there(first) and not there(third)
    assert sorted(r[0] for r in last.collect()) == [2, 4, 6, 8, 10]


def test_entry_without_a_module_of_the_corpus_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), len(e.oracle_sql()) > 90)"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, corpus, sql = said.stdout.split()
    assert int(n) > 100 and corpus == "0" and sql == "True"
