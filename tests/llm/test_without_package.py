"""Workers need the third-party libraries only: the operators run where the package cannot be imported."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
JOB = """
import sys
sys.path.insert(0, {repo!r})  # of the driver only
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).config("spark.executorEnv.PYTHONPATH", "").getOrCreate())
def missing(rows):
    try:
        import meterstone
        yield "found"
    except ImportError:
        yield "missing"
assert spark.sparkContext.parallelize([1], 1).mapPartitions(missing).collect() == ["missing"]
from meterstone.llm.queries import QUERIES
for name in ("op3_neighbours", "op6_decontamination", "op7_language", "op11_hard_negatives", "op12_sentencepiece", "op13_alignment"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_operators_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # The other folder on the path of driver and workers holds nothing of the package.
    done = subprocess.run([sys.executable, "-c", JOB.format(repo=str(REPO), shared=str(tmp_path / "shared"))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert len(counts) == 6 and all(int(n) for n in counts.values())
