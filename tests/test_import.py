"""The driver contract imports anywhere: no JVM, no file, no optional subpackage is needed."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

from checks.tables import ENGLISH_STOP_WORDS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import pyspark, sys
pyspark.__file__ = sys.argv[1] + "/pyspark/__init__.py"
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 90 and set(e.oracle_sql()) <= names
from pyspark import SparkContext
assert SparkContext._gateway is None
"""


def test_import_needs_no_jars_and_no_jvm(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_stop_words_are_those_of_spark(spark):
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")
