"""Run-versioned fact tables with an atomically replaced manifest.

Rows of a run are written to folders of their own and never changed. What is active is told by the manifest of the highest
number; a new one is created exclusively, so of two writers that start from the same manifest one fails and
nothing is half active. Readers see the manifest that they opened and the folders that it names. All file access goes
through Hadoop's FileSystem, so the root may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions import hashing

# The states of a run, and those that each may become.
NEXT = {"Staging": ("Completed", "Failed", "Cancelled"), "Completed": (), "Failed": (), "Cancelled": ()}
SCHEMA_VERSION = 1


class StoreError(Exception):
    """Carries a diagnostic code as its first argument."""


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "schema": SCHEMA_VERSION, "invocation": 0, "runs": {}, "active": {}}
        rows = self.spark.read.text(f"{self.root}/manifests/{numbers[-1]:012d}.json", wholetext=True).collect()
        found = json.loads(rows[0].value)
        if found["schema"] > SCHEMA_VERSION:
            raise StoreError("SD2002", "the store was written by a newer version")
        body = {k: v for k, v in found.items() if k != "sha256"}
        if found["sha256"] != hashing.digest(body):
            raise StoreError("SD2003", "the manifest's checksum does not match")
        return body

    def _replace(self, old: dict, **changes) -> dict:
        new = old | changes | {"number": old["number"] + 1}
        path = self._path(f"{self.root}/manifests/{new['number']:012d}.json")
        # Written aside and renamed without overwriting: the file appears whole or not at all.
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(new | {"sha256": hashing.digest(new)}, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(path) or not self._fs.rename(aside, path):
            self._fs.delete(aside, False)
            raise StoreError("PD3001", "the manifest was replaced meanwhile")
        return new

    def begin(self, profiles: list[str]) -> dict[str, str]:
        """A staging run for each profile of a new invocation."""
        old = self.manifest()
        invocation = old["invocation"] + 1
        runs = {p: hashing.stable_id("run", {"invocation": invocation, "profile": p}) for p in sorted(profiles)}
        added = {r: {"profile": p, "invocation": invocation, "state": "Staging"} for p, r in runs.items()}
        self._replace(old, invocation=invocation, runs=old["runs"] | added)
        return runs

    def _folder(self, run: str, name: str) -> str:
        return f"{self.root}/facts/{name}/run_id={run.replace(':', '-')}"

    def stage(self, run: str, name: str, rows: DataFrame) -> None:
        if self.manifest()["runs"].get(run, {}).get("state") != "Staging":
            raise StoreError("PD3002", "facts can be staged for a run in staging only")
        rows.write.mode("errorifexists").parquet(self._folder(run, name))

    def read(self, run: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(run, name))

    def verify(self, run: str, name: str, rows: DataFrame) -> None:
        """Read back and compare with what was meant, as bags of rows."""
        back = self.read(run, name)
        if back.exceptAll(rows).limit(1).count() or rows.exceptAll(back).limit(1).count():
            raise StoreError("PD3003", f"{name} does not read back as written")

    def activate(self, runs: list[str]) -> None:
        """Complete the runs of one invocation and point their profiles to them, all or none."""
        old = self.manifest()
        states = {r: self._moved(old, r, "Completed") for r in runs}
        whole = {r for r, x in old["runs"].items() if x["invocation"] in {s["invocation"] for s in states.values()} and x["state"] == "Staging"}
        if whole != set(runs):
            raise StoreError("PD3004", "an invocation is activated with all its runs")
        self._replace(old, runs=old["runs"] | states, active=old["active"] | {s["profile"]: r for r, s in states.items()})

    def finish(self, runs: list[str], state: str) -> None:
        """Fail or cancel staging runs and delete what they have staged."""
        old = self.manifest()
        self._replace(old, runs=old["runs"] | {r: self._moved(old, r, state) for r in runs})
        facts = self._path(f"{self.root}/facts")
        for table in self._fs.listStatus(facts) if self._fs.exists(facts) else ():
            for r in runs:
                self._fs.delete(self._path(self._folder(r, table.getPath().getName())), True)

    @staticmethod
    def _moved(manifest: dict, run: str, state: str) -> dict:
        found = manifest["runs"].get(run)
        if found is None or state not in NEXT[found["state"]]:
            raise StoreError("SD2004", f"a run cannot become {state} from {found and found['state']}")
        return found | {"state": state}

    def active(self, name: str, profile: str | None = None) -> DataFrame | None:
        """The active rows of a profile, or of all in the order of their ids; None where nothing is active."""
        pointers = self.manifest()["active"]
        out = None
        for p in sorted(pointers):
            if profile in (None, p):
                rows = self.read(pointers[p], name)
                out = rows if out is None else out.unionByName(rows)
        return out
