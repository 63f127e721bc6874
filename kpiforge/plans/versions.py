"""Versioned publishing of a folder of tables.

A build writes into a folder of its own; readers follow the newest manifest. The
manifest is written after every table is there and every check has passed, so a
build that fails, or is lost with its driver, leaves the published version as it
was. Layout below a root::

    <root>/data/<version>/<table>/...      tables of one build
    <root>/_versions/<number>.json         manifest of a published build

A number is taken by creating its manifest without overwriting, so of two builds
that publish at once each gets a number of its own. All access goes through the
Hadoop file system of the path.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from kpiforge.operators.checks import Measured

KEEP = 2  # published versions that stay; readers of the one before finish undisturbed


@dataclass(frozen=True)
class Manifest:
    """What a published version holds: folder of each table, and what was measured while writing it."""

    version: str
    tables: Mapping[str, str]
    measured: Mapping[str, Measured] = field(default_factory=dict)
    number: int = 0

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "tables": dict(self.tables),
                           "measured": {n: asdict(m) for n, m in self.measured.items()}})

    @staticmethod
    def of_json(text: str, number: int) -> Manifest:
        got = json.loads(text)
        return Manifest(got["version"], got["tables"], {n: Measured(**m) for n, m in got["measured"].items()}, number)


class VersionedFolder:
    """The published versions below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def new_version(self) -> str:
        """Name of a version to be built; its tables go below ``folder(version)``."""
        return f"v-{uuid.uuid4().hex[:12]}"

    def folder(self, version: str) -> str:
        return f"{self.root}/data/{version}"

    def numbers(self) -> list[int]:
        """Numbers of the manifests, newest first."""
        where = self._path("_versions")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted((int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m), reverse=True)

    def _read(self, number: int) -> Manifest | None:
        """A manifest, or None while it is being written."""
        stream = self._fs.open(self._path(f"_versions/{number}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest.of_json(text, number)
        except ValueError:
            return None

    def current(self) -> Manifest | None:
        """The newest complete manifest."""
        return next((m for m in map(self._read, self.numbers()) if m is not None), None)

    def publish(self, manifest: Manifest, keep: int = KEEP) -> Manifest:
        """Make a finished build the current version, then remove all but the newest ``keep``."""
        number = max(self.numbers(), default=0) + 1
        while True:
            try:
                stream = self._fs.create(self._path(f"_versions/{number}.json"), False)
                break
            except Exception as error:  # taken by another build meanwhile
                if not self._fs.exists(self._path(f"_versions/{number}.json")):
                    raise error
                number += 1
        try:
            stream.write(bytearray(manifest.to_json().encode("utf-8")))
        finally:
            stream.close()
        self._retire(keep)
        return Manifest(manifest.version, manifest.tables, manifest.measured, number)

    def _retire(self, keep: int) -> None:
        """Remove old versions that this root published, manifest first."""
        for number in self.numbers()[keep:]:
            old = self._read(number)
            self._fs.delete(self._path(f"_versions/{number}.json"), False)
            if old is not None:
                self._fs.delete(self._path(f"data/{old.version}"), True)

    def discard(self, version: str) -> None:
        """Remove a build that was not published, or (as version/table) a table that only its build needed."""
        self._fs.delete(self._path(f"data/{version}"), True)
