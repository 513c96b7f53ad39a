"""Every registered query against its SQL, at the smallest scale."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_point
from compare import connect, difference
from entrylake.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_equals_sql(spark, duck, small, name):
    assert difference(spark, duck, small, name) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_kernels_reach_workers_from_any_folder(tmp_path):
    """The package is not on the path of the Python workers here."""
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('rows', e.entry(s).count())")
    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
