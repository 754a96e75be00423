"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

from tests.conftest import REPO, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_REPEAT="1", BENCH_CPUS="4")
    out = subprocess.run([sys.executable, os.path.join(REPO, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and len(d["queries"]) == 113 and not d["errors"]
    assert all(isinstance(v, float) and v > 0 for v in d["queries"].values())
