"""Fitted models do not depend on the number of cores."""

import json
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

RUN = """
import json, sys
from pyspark.sql import SparkSession
cores = sys.argv[1]
spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", cores).getOrCreate())
from tabloom import catalog
out = {}
for name in ("pipe_tree", "pipe_house"):
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
    out[name] = sorted([round(v, 6) if isinstance(v, float) else v for v in r] for r in rows)
print("RESULT" + json.dumps(out))
"""


def fitted(cores: int):
    run = subprocess.run([sys.executable, "-c", RUN, str(cores)], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    line = next(x for x in run.stdout.splitlines() if x.startswith("RESULT"))
    return json.loads(line.removeprefix("RESULT"))


def test_forests_are_equal_on_two_and_on_four_cores():
    assert fitted(2) == fitted(4)
