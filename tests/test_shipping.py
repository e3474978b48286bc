"""Python workers find the package wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
print("rows", entry.queries()["cosine_topk"](spark, "/root/testdata/sf0.001").count())
"""


def test_a_query_with_python_workers_runs_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True,
                          text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
