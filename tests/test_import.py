"""The registry loads without a session and without anything beside the pyspark modules."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import pyspark, sys
pyspark.__file__ = "/nowhere/pyspark/__init__.py"
import __spark_entry__ as entry
from pyspark.sql import SparkSession
assert SparkSession.getActiveSession() is None
print(len(entry.queries()), len(entry.oracle_sql()))
"""


def test_registry_loads_without_jars_or_session():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    queries, twins = map(int, done.stdout.split())
    assert queries >= 112 and twins >= 108
