"""Tables of named parts whose content changes in one step.

Every part is a list of Parquet folders, a manifest names them all. A writer puts its rows into new folders first and then
renames a finished manifest into place, so a reader sees the old table or the new one, a killed writer leaves no trace, and
readers of an older version are not disturbed until it is vacuumed. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """What a table needs of the file system that its folder lies in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """The whole file or none of it; a file that is there already is an error."""
        draft = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(path) or not self.fs.rename(self._path(draft), self._path(path)):
            self.fs.delete(self._path(draft), False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class PartTable:
    """Rows by named part under ``folder``; a version is a manifest {part: [folders]}."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, part: Column):
        self.spark, self.folder, self.schema, self.part = spark, folder, schema, part
        self.files = Files(spark, folder)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        known = self.versions()
        if version is None and not known:
            return {}
        return json.loads(self.files.read(f"{self.folder}/manifests/{known[-1] if version is None else version:012d}.json"))

    def read(self, keep: Callable[[str], bool] | Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the parts that ``keep`` names or lets pass; only their folders are listed."""
        wanted = keep if callable(keep) else (lambda part, names=None if keep is None else set(keep): names is None or part in names)
        folders = [f"{self.folder}/data/{f}" for part, fs in self.manifest(version).items() if wanted(part) for f in fs]
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(
        self, append: DataFrame | None = None, replace: DataFrame | None = None, parts: Iterable[str] = (), version: int | None = None,
    ) -> int:
        """A new version: ``parts`` hold the rows of ``replace`` alone, those without any are dropped; ``append`` is added.

        Returns the version's number, the next one unless given.
        """
        known = self.versions()
        version = version if version is not None else (known[-1] + 1 if known else 0)
        manifest = {p: fs for p, fs in (self.manifest(known[-1]) if known else {}).items() if p not in set(parts)}
        for rows in (replace, append):
            if rows is not None:
                for part, folder in self._write(rows, version).items():
                    manifest[part] = [*manifest.get(part, []), folder]
        self.files.put(f"{self.folder}/manifests/{version:012d}.json", json.dumps(manifest, sort_keys=True))
        return version

    def _write(self, rows: DataFrame, version: int) -> dict[str, str]:
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        # a large part is several tasks' work and several files
        dealt = rows.withColumn("_part", self.part).repartition("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
        dealt.write.partitionBy("_part").parquet(f"{self.folder}/data/{name}")
        found = [n for n in self.files.names(f"{self.folder}/data/{name}") if n.startswith("_part=")]
        return {unquote(n.removeprefix("_part=")): f"{name}/{n}" for n in found}

    def names_of(self, rows: DataFrame) -> list[str]:
        """The parts that rows belong to: one name a part reaches the driver, as in the manifest."""
        return [r[0] for r in rows.select(self.part.alias("part")).distinct().collect()]

    def vacuum(self, keep: int = 2) -> None:
        """Take away all but the last ``keep`` versions and the folders that only older or unfinished ones name."""
        known = self.versions()
        held = {f for v in known[-keep:] for fs in self.manifest(v).values() for f in fs}
        for v in known[:-keep]:
            self.files.delete(f"{self.folder}/manifests/{v:012d}.json")
        for commit in self.files.names(f"{self.folder}/data"):
            for part in self.files.names(f"{self.folder}/data/{commit}"):
                if f"{commit}/{part}" not in held and part.startswith("_part="):
                    self.files.delete(f"{self.folder}/data/{commit}/{part}")
            if not any(f.startswith(f"{commit}/") for f in held):
                self.files.delete(f"{self.folder}/data/{commit}")
