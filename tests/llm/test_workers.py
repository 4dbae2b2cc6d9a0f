"""Workers need no copy of the repository: everything runs in a process that
was started in an empty folder, where only the driver can import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.sparkContext.setCheckpointDir(sys.argv[2])

def found(_):
    import importlib.util
    yield importlib.util.find_spec("quarry") is not None

assert not any(spark.sparkContext.parallelize(range(4), 4).mapPartitions(found).collect())
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name.startswith("op") or name in ("pipeline", "bm25_batch", "match_phrase", "vector_topk", "hash_embed"):
        print(name, query(spark, "/root/testdata/sf0.001").count() > 0, flush=True)
"""


def test_all_operators_run_where_workers_cannot_import_them(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "empty").mkdir()
    out = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path / "ckpt")], cwd=tmp_path / "empty", env=env,
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    lines = out.stdout.split("\n")[:-1]
    assert len(lines) == 18 and all(x.endswith(" True") for x in lines), out.stdout
