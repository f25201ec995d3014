"""Run manifests: what went in, how long it took, what came out; one JSON row per run."""

from __future__ import annotations

import datetime
import importlib.metadata
import json
import subprocess
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PACKAGES = ("pyspark", "pyarrow", "numpy", "pandas")


def git_commit() -> str:
    found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return found.stdout.strip() if found.returncode == 0 else "unknown"


def versions() -> dict[str, str]:
    out = {}
    for name in PACKAGES:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = "absent"
    return out


class RunManifest:
    def __init__(self, config_hash: str, params: dict[str, Any] | None = None):
        self.data: dict[str, Any] = {"run_id": uuid.uuid4().hex, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "config_hash": config_hash, "git_commit": git_commit(), "versions": versions(), "params": params or {}, "scenes": {}, "stats": {}, "timings": {}, "results": {}}
        self._began: dict[str, float] = {}

    def add_scenes(self, epoch: str, ids: list[str], dates: list[str]) -> None:
        self.data["scenes"][epoch] = {"ids": ids, "dates": dates}

    def add_stats(self, epoch: str, **stats: float) -> None:
        self.data["stats"].setdefault(epoch, {}).update(stats)

    def add_results(self, **results: Any) -> None:
        self.data["results"].update(results)

    def start_timer(self, name: str) -> None:
        self._began[name] = time.perf_counter()

    def stop_timer(self, name: str) -> float:
        took = round(time.perf_counter() - self._began.pop(name), 3)
        self.data["timings"][name] = took
        return took

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.data["run_id"], json.dumps(self.data, sort_keys=True))], "run_id string, manifest string")

    def save(self, spark: SparkSession, folder: str) -> None:
        self.frame(spark).write.mode("append").json(folder)
