"""Benchmark: every registered query at one scale factor.

Environment: ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``),
``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (timed runs, default 3),
``BENCH_QUERIES`` (comma-separated subset), ``BENCH_DUCKDB`` (``0`` to skip
the DuckDB timing of the same SQL), ``BENCH_SMALL_SF_DIR`` (default: the
sibling ``sf0.01`` folder; ``-`` to skip the growth measurement).

DuckDB time of the same SQL (for scale only), the growth of time from the
small to the bench scale for the RFM queries, and the shape of each query's
final adaptive plan at the small scale (Parquet scans, shuffles, reused
shuffles, broadcasts, join kinds; ``narrow_scans`` counts one-column reads
such as the date column behind a last-date scalar or a key-only dimension;
the RFM table target: one scan of the orders for the per-user aggregate,
plus one narrow date scan).

Each query runs fully (``noop`` sink: every row is produced, nothing is
collected).  The whole suite runs once to warm up, then ``BENCH_RUNS``
interleaved rounds; the per-query value is the median of its rounds.  Prints one JSON line:
``{"metric": "total_median_sec", "value": ..., "unit": "sec", "queries": {...}, "sf": ...}``.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _sf(base_dir: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", base_dir)
    return float(m.group(1)) if m else base_dir


def _median_time(fn, runs: int) -> float:
    fn()  # warm-up
    times = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def main() -> None:
    base_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    subset = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    with_duckdb = os.environ.get("BENCH_DUCKDB", "1") != "0"

    from basketlens.plans import oracle_sql, queries
    from basketlens.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="basketlens-bench")
    catalog = queries()
    names = subset or list(catalog)

    results: dict[str, float] = {}
    failed: dict[str, str] = {}

    def run(name: str, base: str = base_dir) -> None:
        catalog[name](spark, base).write.format("noop").mode("overwrite").save()

    # One warm-up round over the whole suite (JIT, class loading, schema
    # cache), then BENCH_RUNS interleaved rounds; each query's value is the
    # median of its rounds.
    live = []
    for name in names:
        try:
            run(name)
            live.append(name)
        except Exception as e:  # keep going; report the failure
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    times: dict[str, list[float]] = {name: [] for name in live}
    for _ in range(runs):
        for name in live:
            t0 = time.perf_counter()
            run(name)
            times[name].append(time.perf_counter() - t0)
    results = {name: round(statistics.median(ts), 4) for name, ts in times.items()}

    growth: dict[str, dict[str, float]] = {}
    small_dir = os.environ.get("BENCH_SMALL_SF_DIR") or re.sub(r"sf[0-9.]+", "sf0.01", base_dir)
    if small_dir != "-" and small_dir != base_dir and os.path.isdir(small_dir):
        for name in ("rfm_journey", "rfm_snapshots", "rf_segment_month"):
            if name not in results:
                continue
            try:
                small = _median_time(lambda n=name: run(n, small_dir), runs)
                growth[name] = {"small_sec": round(small, 4), "bench_sec": results[name],
                                "ratio": round(results[name] / small, 3) if small else None}
            except Exception as e:
                failed[f"growth:{name}"] = f"{type(e).__name__}: {str(e)[:200]}"

    scans: dict[str, int] = {}
    plans: dict[str, dict[str, int]] = {}
    try:
        from tools.plan_stats import PATTERNS, plan_text, scan_widths

        plan_dir = small_dir if small_dir != "-" and os.path.isdir(small_dir) else base_dir
        for name in live:
            text = plan_text(catalog[name](spark, plan_dir))
            stats = {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}
            widths = scan_widths(catalog[name](spark, plan_dir))
            stats["narrow_scans"] = sum(1 for w in widths if w == 1)
            plans[name] = {k: v for k, v in stats.items() if v}
            scans[name] = {"scans": stats["scans"], "narrow_scans": stats["narrow_scans"]}
    except Exception as e:
        failed["plans"] = f"{type(e).__name__}: {str(e)[:200]}"

    duck: dict[str, float] = {}
    if with_duckdb:
        try:
            sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
            from compare import duck_connect

            con = duck_connect(base_dir)
            sql = oracle_sql()
            for name in names:
                if name in sql:
                    duck[name] = round(_median_time(lambda q=sql[name]: con.execute(q).fetchall(), runs), 4)
        except Exception as e:
            failed["duckdb"] = f"{type(e).__name__}: {str(e)[:200]}"

    out = {
        "metric": "total_median_sec",
        "value": round(sum(results.values()), 4),
        "unit": "sec",
        "queries": results,
        "sf": _sf(base_dir),
        "cpus": cpus,
        "runs": runs,
        "duckdb_same_sql_sec": duck,
        "growth_small_to_bench": growth,
        "parquet_scans_in_final_plan": scans,
        "final_plan_stats": plans,
        "failed": failed,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
