"""Benchmark: every registered route at one scale, on local[$BENCH_CPUS].

Three phases, timed apart:

1. ``queries``: each route end to end from the raw tables (cube derived in
   the same plan). This is the headline ``value`` (sum of route seconds).
2. ``cube_build_sec``: the batch feed jobs writing all 46 cube collections.
3. ``served``: each route answered from the stored cubes, which is what the
   original service does per request.
4. ``concurrent``: all routes end to end from ``$BENCH_CLIENTS`` (default 4)
   threads at once, as a service answering simultaneous requests: wall
   seconds and routes per second.

Each route is run ``$BENCH_REPEAT`` times (default 3) after a warm-up run
of one route per family; the median is reported. Results are executed with the
``noop`` sink, so nothing is collected to the driver.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cubewise.plans.bindings import StoredCubes, TableCubes, build_all  # noqa: E402
from cubewise.plans.registry import route_specs  # noqa: E402
from cubewise.session import build_session, checkpoint_dir  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(f"local[{cpus}]", app_name="cubewise-bench", shuffle_partitions=cpus,
                          conf={"spark.driver.memory": "16g"})
    specs = route_specs()
    raw = TableCubes(spark, sf_dir)

    warm, seen = [], set()
    for spec in specs:  # warm-up, one route per family: JIT, file metadata, code paths
        if spec.family.name not in seen:
            seen.add(spec.family.name)
            warm.append(spec)
    for spec in warm:
        run(spec.run(raw))

    errors: dict[str, str] = {}

    def median_time(key: str, make) -> float | None:
        try:
            return round(statistics.median(timed(lambda: run(make())) for _ in range(repeat)), 4)
        except Exception as exc:  # keep measuring the other routes; report the failure
            errors[key] = f"{type(exc).__name__}: {str(exc)[:200]}"
            return None

    queries = {spec.key: median_time(spec.key, lambda spec=spec: spec.run(raw)) for spec in specs}

    scratch = os.path.join(checkpoint_dir(spark, tempfile.mkdtemp(prefix="cubewise-bench-")), "cubes")
    build_sec = timed(lambda: build_all(raw, scratch))
    stored = StoredCubes(spark, scratch)
    served = {spec.key: median_time("served:" + spec.key, lambda spec=spec: spec.run(stored)) for spec in specs}

    clients = int(os.environ.get("BENCH_CLIENTS", "4"))
    with ThreadPoolExecutor(max_workers=clients) as pool:
        concurrent_sec = timed(lambda: list(pool.map(lambda spec: run(spec.run(raw)), specs)))

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "sum of median route seconds, end to end from raw tables",
        "value": round(sum(v for v in queries.values() if v is not None), 3),
        "unit": "sec",
        "queries": queries,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "routes": len(queries),
        "cube_build_sec": round(build_sec, 3),
        "served_total_sec": round(sum(v for v in served.values() if v is not None), 3),
        "served": served,
        "concurrent_clients": clients,
        "concurrent_wall_sec": round(concurrent_sec, 3),
        "concurrent_routes_per_sec": round(len(specs) / concurrent_sec, 2),
        "spark": spark.version,
        "errors": errors,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
