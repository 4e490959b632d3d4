"""A store of findings in which a run replaces what earlier runs found about the same files and layers.

Each commit writes its findings and the list of what it ran on (file, layer) to folders of its
own, then a manifest that names all commits that count, under the next number. A manifest
appears whole or not at all, and only once a number; readers take the highest. So what broke
off before its manifest is never read, two writers can't both take a number, and a reader
keeps what it began with. A file that ran without findings replaces what it had by nothing.

A batch of a stream that is sent again finds its mark among the commits and writes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import store

#: Pairs of file and layer up to which a read broadcasts which commit is theirs (some 50 MB).
BROADCAST_RUNS = 500_000

KEY = ["file_id", "layer"]


class Conflict(RuntimeError):
    """Another writer took the number; the commit can be made again."""


class FindingsStore:
    """``path`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> list[int]:
        fs, at = store(self.spark, f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commits(self, at: int | None = None) -> list[dict]:
        """The commits that count, the newest last: of the newest manifest, or of the one numbered ``at``."""
        known = self._manifests()
        if at is None and not known:
            return []
        number = known[-1] if at is None else at
        text = self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()
        return json.loads(text["value"])

    def _publish(self, number: int, commits: list[dict]) -> None:
        fs, draft = store(self.spark, f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(commits).encode()))
        out.close()
        _, final = store(self.spark, f"{self.path}/manifests/{number}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"manifest {number} exists")

    def _stage(self, findings: DataFrame, runs: DataFrame, number: int, batch: str | None) -> dict:
        """Write a commit's folders; nothing reads them before a manifest names them."""
        folder = f"{self.path}/commits/{number}-{uuid.uuid4().hex}"
        findings.write.partitionBy("layer").parquet(f"{folder}/findings")
        runs.select(*KEY).distinct().write.parquet(f"{folder}/runs")
        count = self.spark.read.parquet(f"{folder}/runs").count()
        return {"number": number, "folder": folder, "runs": count, "batches": [] if batch is None else [batch], "schema": findings.schema.json()}

    def commit(self, findings: DataFrame, runs: DataFrame, batch: str | None = None) -> int:
        """Replace the findings of the pairs in ``runs`` (file_id, layer); the commit's number.

        ``findings`` has file_id, layer and whatever else, and the same columns each time; those
        of pairs that weren't run don't count. A ``batch`` that was committed before is passed over.
        """
        known = self._manifests()
        before = self.commits(known[-1]) if known else []
        for c in before:
            if batch in c["batches"]:
                return c["number"]
        number = known[-1] + 1 if known else 0
        made = self._stage(findings, runs, number, batch)
        self._publish(number, [*before, made])
        return number

    def read(self, at: int | None = None) -> DataFrame:
        """The findings that count, with ``commit``, the number of the commit that they are from."""
        commits = self.commits(at)
        if not commits:
            raise ValueError("nothing was committed")
        kind = self.spark.createDataFrame([], "x int").schema.fromJson(json.loads(commits[-1]["schema"]))
        runs = findings = None
        for c in commits:  # plans only; ``compact`` keeps them few
            number = F.lit(c["number"]).alias("commit")
            r = self.spark.read.parquet(f"{c['folder']}/runs").select(*KEY, number)
            f = self.spark.read.schema(kind).parquet(f"{c['folder']}/findings").select(*kind.names, number)
            runs, findings = (r, f) if runs is None else (runs.unionByName(r), findings.unionByName(f))
        last = runs.groupBy(*KEY).agg(F.max("commit").alias("commit"))
        if sum(c["runs"] for c in commits) <= BROADCAST_RUNS:
            last = F.broadcast(last)
        return findings.join(last, [*KEY, "commit"], "left_semi")

    def compact(self) -> int:
        """One commit in place of all; earlier manifests still read what they name, until ``vacuum``."""
        commits = self.commits()
        known = self._manifests()
        runs = None
        for c in commits:
            r = self.spark.read.parquet(f"{c['folder']}/runs")
            runs = r if runs is None else runs.unionByName(r)
        made = self._stage(self.read().drop("commit"), runs, known[-1] + 1, None)
        # marks of batches stay known, so that none of them is taken twice
        made["batches"] = [b for c in commits for b in c["batches"]]
        self._publish(known[-1] + 1, [made])
        return known[-1] + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` manifests, and folders that neither these name nor a later commit may still be writing."""
        known = self._manifests()
        kept, gone = known[-keep:], known[:-keep]
        named = {c["folder"].rsplit("/", 1)[1] for n in kept for c in self.commits(n)}
        fs, _ = store(self.spark, self.path)
        for n in gone:
            fs.delete(store(self.spark, f"{self.path}/manifests/{n}.json")[1], False)
        deleted = []
        for x in fs.listStatus(store(self.spark, f"{self.path}/commits")[1]):
            name = x.getPath().getName()
            if name not in named and int(name.split("-")[0]) <= known[-1]:
                fs.delete(x.getPath(), True)
                deleted.append(name)
        return deleted
