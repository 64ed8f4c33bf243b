"""A versioned Parquet table with a manifest: content-addressed documents, resumable runs, upserts that can be replayed.

Data go to folders of their own, named by the run that writes them; a commit is one small JSON file that lists the folders
of a version, made only if no other has made it. Readers see the last commit. A run that dies after it has written and
before it has committed leaves an unlisted folder, which the same run overwrites when it is repeated; a run that has
committed is not done again. Everything goes through Hadoop's file systems, so the path may be on any of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed in between, as often as was tried."""


class VersionedTable:
    """A table at ``path``. Writers name their runs: a name that is committed is not written again."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 10):
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _commits(self) -> list[str]:
        fs, where = self._fs("_commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []

    def state(self) -> dict:
        """The last commit: version, folders, schema (JSON) and the names of all runs so far."""
        names = self._commits()
        if not names:
            return {"version": 0, "folders": [], "schema": None, "runs": []}
        fs, where = self._fs(f"_commits/{names[-1]}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, new: dict) -> bool:
        """Make the commit file of a version, unless there is one."""
        fs, final = self._fs(f"_commits/{new['version']:012d}.json")
        if fs.exists(final):
            return False
        _, draft = self._fs(f"_commits/.{new['version']:012d}-{hashlib.sha256(new['runs'][-1].encode()).hexdigest()[:16]}.tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        try:
            made = fs.rename(draft, final)  # a rename onto a file fails
        except Exception:  # some file systems raise instead of returning false
            made = False
        if not made:
            fs.delete(draft, False)
        return bool(made)

    def read(self) -> DataFrame | None:
        """All rows of the last version; None before the first commit."""
        return self._read(self.state())

    def _read(self, state: dict) -> DataFrame | None:
        if not state["folders"]:
            return None
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in state["folders"]])

    def done(self, run: str) -> bool:
        return run in self.state()["runs"]

    def _write(self, run: str, rows: Callable[[DataFrame | None], DataFrame], replaces: bool) -> bool:
        """Write what ``rows`` makes of the current table and commit it; again if another commit came first."""
        for _ in range(self.tries):
            now = self.state()
            if run in now["runs"]:
                return False
            new = rows(self._read(now))
            folder = f"data/{hashlib.sha256(f'{run}|{now['version']}'.encode()).hexdigest()[:32]}"
            new.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{folder}")
            commit = {"version": now["version"] + 1, "folders": [folder] if replaces else [*now["folders"], folder], "schema": new.schema.json(), "runs": [*now["runs"], run]}
            if self._commit(commit):
                return True
        raise Conflict(f"{run} was not committed in {self.tries} tries")

    def append_missing(self, rows: DataFrame, keys: list[str], run: str) -> bool:
        """Add the rows whose keys the table lacks (null keys match null keys), each key once. False if the run is committed already."""

        def missing(old: DataFrame | None) -> DataFrame:
            once = rows.dropDuplicates(keys)
            if old is None:
                return once
            have = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
            on: Column = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
            return once.join(have, on, "left_anti").select(*old.columns)

        return self._write(run, missing, False)

    def missing(self, keys_to_do: DataFrame, keys: list[str]) -> DataFrame:
        """The keys that the table lacks: what a resumed run has left to do."""
        old = self.read()
        return keys_to_do if old is None else keys_to_do.join(old.select(*keys), keys, "left_anti")

    def upsert(self, rows: DataFrame, keys: list[str], order: str, run: str) -> bool:
        """Keep the last row of every key by ``order`` among the table and ``rows``. False if the run is committed already."""

        def last(old: DataFrame | None) -> DataFrame:
            both = rows if old is None else old.unionByName(rows)
            rest = [c for c in both.columns if c not in keys]
            return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(*keys, "__last.*").select(*both.columns)

        return self._write(run, last, True)

    def sink(self, keys: list[str], order: str, query: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that upserts; a batch that is replayed after its commit changes nothing."""
        return lambda batch, batch_id: self.upsert(batch, keys, order, f"{query}-{batch_id}") and None

    def vacuum(self) -> int:
        """Delete data folders that no commit's last version lists; returns how many went. No writer may be at work."""
        fs, where = self._fs("data")
        listed = {f.rsplit("/", 1)[-1] for f in self.state()["folders"]}
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in listed] if fs.exists(where) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)


class DocumentStore:
    """Documents by id and by the sha256 of their content. The same content is stored once, under the id it came with first."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def save(self, documents: DataFrame, run: str, id_col: str = "id", body_col: str = "body") -> bool:
        """Add documents (id, body as string or binary). A missing id becomes one made of the content's hash.

        Among documents of equal content the smallest id stays; ids that are stored with other content are replaced.
        """
        body = F.col(body_col).cast("binary")
        sha = F.sha2(body, 256)
        rows = documents.where(F.col(body_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("doc_"), F.substring(sha, 1, 10))).alias("id"), sha.alias("sha256"), body.alias("body"))
        rows = rows.groupBy("sha256").agg(F.min_by(F.struct("id", "body"), F.col("id")).alias("d")).select("d.id", "sha256", "d.body")
        rows = rows.dropDuplicates(["id"])

        def merged(old: DataFrame | None) -> DataFrame:
            if old is None:
                return rows
            new = rows.join(old.select("sha256"), "sha256", "left_anti").select("id", "sha256", "body")
            return old.join(new.select("id"), "id", "left_anti").select("id", "sha256", "body").unionByName(new)

        return self.table._write(run, merged, True)

    def by_id(self, ids: DataFrame) -> DataFrame:
        """(id, sha256, body) of the ids that are stored."""
        return self.table.read().join(ids.select("id").distinct(), "id", "left_semi")

    def by_sha(self, hashes: DataFrame) -> DataFrame:
        """(id, sha256, body) of the contents that are stored."""
        return self.table.read().join(hashes.select("sha256").distinct(), "sha256", "left_semi")
