"""Functions for Python workers must not need this package there."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from tidemark.functions.text import ascii_fold_any
from tidemark.operators.concordance import kendall_tau
from tidemark.learning.neighbours import nearest_neighbours
from tidemark.session import build_session
spark = build_session("far", "local[2]", spark_ui_enabled="false", spark_sql_shuffle_partitions="2")
assert spark.range(1).select(ascii_fold_any(F.lit("Ñ"))).head()[0] == "N"
assert kendall_tau(spark.range(50).selectExpr("id AS x", "id * 2 AS y"), "x", "y").head()["tau"] == 1.0
v = spark.range(20).selectExpr("id", "array(CAST(id AS DOUBLE), 0D) AS v", "CAST(id % 2 AS INT) AS y")
assert nearest_neighbours(v.where("id > 5"), v.where("id <= 5"), "id", "v", 2, "y").count() == 12
print("fine")
"""


def test_package_is_not_needed_on_workers(tmp_path):
    code = CODE.format(root=str(Path(__file__).resolve().parent.parent))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env={**__import__("os").environ, "PYTHONPATH": ""})
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
