import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").getOrCreate()
print("rows", entry.queries()["html_text"](spark, "/root/testdata/sf0.001").count())
print("rows", entry.queries()["viewer_refs"](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0 and "rows 50" in done.stdout and "rows True" in done.stdout, done.stderr[-2000:]
