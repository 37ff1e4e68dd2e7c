"""Summarise stage times per job group from a Spark event log folder (zstd or plain JSON lines).

    python tools/stage_times.py EVENT_LOG_DIR [group ...]

Enable the log for a run with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir`` pointing
at a scratch folder; tag the work with ``sparkContext.setJobGroup``.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard
        fh = open(path, "rb")
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    return open(path, encoding="utf-8")


def main():
    root = sys.argv[1]
    wanted = set(sys.argv[2:])
    files = [p for p in glob.glob(os.path.join(root, "**", "*"), recursive=True)
             if os.path.isfile(p) and "appstatus" not in os.path.basename(p)]
    stages, group_of = {}, {}
    for f in sorted(files):
        for line in _lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e["Stage IDs"]:
                    group_of[sid] = g
            elif e["Event"] == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (si["Stage Name"][:70], si["Number of Tasks"],
                                          si.get("Completion Time", 0) - si.get("Submission Time", 0))
    groups = sorted({g for g in group_of.values() if g and (not wanted or g in wanted)})
    for g in groups:
        total = 0
        print(f"== {g}")
        for sid, (name, n, ms) in sorted(stages.items()):
            if group_of.get(sid) == g:
                total += ms
                print(f"  stage {sid:5d} tasks={n:4d} {ms:6d} ms  {name}")
        print(f"  total stage time {total} ms")


if __name__ == "__main__":
    main()
