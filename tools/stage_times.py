"""Per-stage timings of one registered query, from Spark's event log.

Usage: ``python tools/stage_times.py <query> [base_dir] [runs]``.
The event log goes to a fresh scratch folder (the web UI stays off); the
stages of the last run are printed in submission order.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(log_dir: str):
    for path in sorted(glob.glob(f"{log_dir}/**/events_*", recursive=True) + glob.glob(f"{log_dir}/*")):
        if os.path.isdir(path):
            continue
        with open(path, "rb") as fh:
            if path.endswith(".zstd"):
                import zstandard

                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                stream = io.TextIOWrapper(fh, encoding="utf-8")
            for line in stream:
                if line.strip():
                    yield json.loads(line)


def main(argv: list[str]) -> None:
    from basketlens.plans import queries
    from basketlens.session import build_session

    name = argv[0]
    base = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    runs = int(argv[2]) if len(argv) > 2 else 3
    log_dir = tempfile.mkdtemp(prefix="basketlens-events-")
    spark = build_session(extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    for _ in range(runs):
        t0 = time.perf_counter()
        queries()[name](spark, base).write.format("noop").mode("overwrite").save()
        print(f"run {time.perf_counter() - t0:.3f}s")
    spark.stop()

    stages = {}
    jobs_per_run = []
    for e in _events(log_dir):
        if e.get("Event") == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            stages[info["Stage ID"]] = (
                info["Submission Time"], info["Completion Time"], info["Number of Tasks"], info["Stage Name"][:40]
            )
        elif e.get("Event") == "SparkListenerJobStart":
            jobs_per_run.append(e["Submission Time"])
    ordered = sorted(stages.items(), key=lambda kv: kv[1][0])
    last = ordered[-(len(ordered) // runs):] if runs and ordered else ordered
    if not last:
        print("no stages recorded")
        return
    t0 = last[0][1][0]
    for sid, (sub, comp, tasks, label) in last:
        print(f"stage {sid:4d}  start +{sub - t0:6d} ms  {comp - sub:6d} ms  {tasks:4d} tasks  {label}")
    print(f"stages in last run: {len(last)}, log: {log_dir}")


if __name__ == "__main__":
    main(sys.argv[1:])
