"""Queries with Python workers, started in a folder that knows nothing of the package."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", sys.argv[3]).getOrCreate()
for name in sys.argv[4:]:
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_queries_start_from_any_folder(tmp_path):
    work = tmp_path / "elsewhere"
    work.mkdir()
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    names = ["text_error_rates_by_role", "extractor_failures", "extracted_blocks", "near_duplicate_groups", "label_similarities"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, entry, SF, str(tmp_path / "shared"), *names], cwd=work, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.split()[:1] and line.split()[0] in names)
    assert set(counts) == set(names) and all(int(n) > 0 for n in counts.values())


def test_batches_follow_bytes(spark):
    """Long texts make small batches, so a worker's memory does not follow the row limit."""
    import pyarrow as pa

    from witnessgrid.session import small_batches

    small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) AS t")
    assert max(r["n"] for r in texts.mapInArrow(sizes, "n bigint").collect()) < 8 << 20
