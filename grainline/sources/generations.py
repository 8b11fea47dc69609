"""Generations of a table, switched by a manifest: readers see one or the next, never half of it."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


class Superseded(Exception):
    """Another writer has committed since the version that this one began with."""


class ProfileMismatch(Exception):
    """The table's vectors are of another embedding profile: it takes a table of its own."""


@dataclass(frozen=True)
class Manifest:
    """What a version of the table is: its generation's folder, its profile, and how many rows it has."""

    version: int
    generation: str
    profile: str
    rows: int


class Generations:
    """A table below ``root``: ``generation=<id>`` folders of Parquet, and ``_manifest/v<n>`` files that name one each.

    A manifest is written aside and then renamed to the next number, which fails if another
    writer had that number first. Rows are never changed in place, so whoever read a
    version goes on reading it until ``expire`` takes it away.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _file(self, version: int):
        return self._path(f"{self.root}/_manifest/v{version:010d}.json")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d{10})\.json", n)))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of a version, or the current one; None before the first."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        with_text = self.spark.read.text(self._file(version).toString(), wholetext=True).first()
        return Manifest(**json.loads(with_text[0]))

    def stage(self, rows: DataFrame) -> str:
        """Write a generation that nobody sees yet; its id."""
        generation = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/generation={generation}")
        return generation

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, or of the current one; later commits don't change what was read."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return self.spark.read.parquet(f"{self.root}/generation={found.generation}")

    def commit(self, generation: str, profile: str, parent: int) -> Manifest:
        """Make a staged generation the one after version ``parent`` (0: the first).

        Refused if there has been another commit since, if the table is of another
        profile, or if the generation isn't all there.
        """
        now = self.manifest()
        if now is not None and now.profile != profile:
            raise ProfileMismatch(f"{self.root} is of profile {now.profile}, not {profile}")
        if (now.version if now else 0) != parent:
            raise Superseded(f"{self.root} is at version {now.version if now else 0}, not {parent}")
        folder = f"{self.root}/generation={generation}"
        if not self._fs.exists(self._path(f"{folder}/_SUCCESS")):
            raise FileNotFoundError(f"{folder} isn't written to its end")
        new = Manifest(parent + 1, generation, profile, self.spark.read.parquet(folder).count())
        aside = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        self._publish(aside, new.version)
        return new

    def _publish(self, aside, version: int) -> None:
        """Rename without overwriting: of two writers with one number, the second fails."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._file(version)), options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(self._file(version)):
                raise Superseded(f"{self.root} has a version {version} already") from error
            raise

    def expire(self, keep: int = 2) -> list[str]:
        """Take away manifests but the last ``keep``, and generations that only those name; what is staged and not committed stays."""
        known = self.versions()
        old = [self.manifest(v) for v in known[:-keep]] if keep > 0 else []
        named = {self.manifest(v).generation for v in known[-keep:]}
        gone = []
        for m in old:
            self._fs.delete(self._file(m.version), False)
            if m.generation not in named:
                self._fs.delete(self._path(f"{self.root}/generation={m.generation}"), True)
                gone.append(m.generation)
        return gone
