"""Summarize a Spark event log: per job, stages with task count, wall time and shuffle bytes.

Usage: python tools/eventlog_summary.py <event-log-file> [min_stage_seconds]
"""

from __future__ import annotations

import json
import sys


def main() -> None:
    path = sys.argv[1]
    min_s = float(sys.argv[2]) if len(sys.argv) > 2 else 0.5
    stages, jobs, desc = {}, [], {}
    if path.endswith(".zstd"):
        import io
        import zstandard
        lines = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(path, "rb")), encoding="utf-8")
    else:
        lines = open(path, encoding="utf-8")
    for line in lines:
        ev = json.loads(line)
        e = ev.get("Event")
        if e == "SparkListenerJobStart":
            jobs.append((ev["Job ID"], ev.get("Properties", {}).get("spark.job.description", ""),
                         [s["Stage ID"] for s in ev["Stage Infos"]]))
        elif e == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
            dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
            stages[info["Stage ID"]] = (info["Number of Tasks"], dur, acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0),
                                        acc.get("internal.metrics.shuffle.write.bytesWritten", 0), info["Stage Name"])
    for sid, (n, dur, rb, wb, name) in sorted(stages.items()):
        if dur >= min_s:
            print(f"stage {sid:4d} tasks={n:4d} {dur:7.2f}s shuffle_write={int(wb or 0)/1e6:8.1f}MB  {name[:90]}")


if __name__ == "__main__":
    main()
