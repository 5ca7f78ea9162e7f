"""Committed tables: staged files and a numbered commit log.

Layout of a table::

    <root>/data/<writer>/...              staged Parquet files, one folder per writer
    <root>/_commits/<version>.json        what a version adds and drops
    <root>/_commits/<version>.live.json   every ``LIVE_EVERY`` versions: all live folders

A writer stages its files first, which readers do not see, and then claims the
next version by moving a complete manifest into place without replacing one.
Of two writers that claim a version one wins; the other looks at what was
committed meanwhile and claims the next.  A writer that dies leaves at most
staged files that no version names (``unreferenced`` lists them).  Readers take
the folders named by the log up to a version, so a reader never sees half a
write, and an older version stays readable until its folders are removed.

The move without replacement is atomic where the file system's is (HDFS and
other stores with an atomic rename); an object store needs a connector that
offers it.  Only manifests pass through the driver: one short text per commit.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LIVE_EVERY = 50
_VERSION = re.compile(r"(\d{20})\.json")
_LIVE = re.compile(r"(\d{20})\.live\.json")


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._staged: dict[str, str] = {}  # folder -> schema, for the manifest

    # --- files ---------------------------------------------------------------

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _write(self, name: str, text: str) -> None:
        out = self._fs().create(self._path("_commits", name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, name: str) -> dict:
        source = self._fs().open(self._path("_commits", name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    # --- log -------------------------------------------------------------------

    def exists(self) -> bool:
        return self._fs().exists(self._path("_commits"))

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names("_commits") if (m := _VERSION.fullmatch(n)))

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        return self._read(f"{version:020d}.json")

    def live(self, upto: int | None = None) -> list[str]:
        """Folders of the table as of a version, oldest first."""
        names = self._names("_commits")
        upto = max((int(m[1]) for n in names if (m := _VERSION.fullmatch(n))), default=0) if upto is None else upto
        start = max((v for n in names if (m := _LIVE.fullmatch(n)) and (v := int(m[1])) <= upto), default=0)
        folders = self._read(f"{start:020d}.live.json")["folders"] if start else []
        for version in range(start + 1, upto + 1):
            made = self.manifest(version)
            gone = set(made["drop"])
            folders = [f for f in folders if f not in gone] + made["add"]
        return folders

    def commit(self, version: int, add: Sequence[str], drop: Sequence[str] = (), note: dict | None = None) -> bool:
        """Claim ``version``; false if another writer has it."""
        schema = next((self._staged[f] for f in add if f in self._staged), None)
        made = {"version": version, "add": list(add), "drop": list(drop), "note": note or {}, "schema": schema}
        name, draft = f"{version:020d}.json", f".{uuid.uuid4().hex}.draft"
        self._write(draft, json.dumps(made))
        renames = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(renames, 1)
        none[0] = renames.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf)
        try:
            context.rename(self._path("_commits", draft), self._path("_commits", name), none)
        except Py4JJavaError as exc:
            if "FileAlreadyExistsException" not in str(exc.java_exception.getClass().getName()):
                raise
            self._fs().delete(self._path("_commits", draft), False)
            return False
        if version % LIVE_EVERY == 0:
            self._write(f"{version:020d}.live.json", json.dumps({"folders": self.live(version)}))
        return True

    def unreferenced(self) -> list[str]:
        """Staged folders that no version ever named (a writer died, or is
        still at work)."""
        named = {f for v in self.versions() for f in self.manifest(v)["add"]}
        return sorted(f for n in self._names("data") if (f := f"data/{n}") not in named)

    # --- tables ---------------------------------------------------------------

    def stage(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write ``df`` where no reader looks; the folder to commit."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{folder}")
        self._staged[folder] = df.schema.json()
        return folder

    def frame(self, folders: Sequence[str], schema: T.StructType | None = None) -> DataFrame | None:
        """The rows of some folders, or None without any."""
        if not folders:
            return None
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The committed rows, of now or of a version, in the schema of that
        version unless another is given (a partitioned write without rows leaves
        no file to take it from)."""
        at = self.latest() if version is None else version
        if schema is None and at and self.manifest(at)["schema"]:
            schema = T.StructType.fromJson(json.loads(self.manifest(at)["schema"]))
        found = self.frame(self.live(at), schema)
        if found is not None:
            return found
        if schema is None:
            raise FileNotFoundError(f"{self.root} has no committed rows and no schema was given")
        return self.spark.createDataFrame([], schema)

    def append(self, df: DataFrame, partition_by: Sequence[str] = (), note: dict | None = None,
               recheck: Callable[[DataFrame, DataFrame], DataFrame] | None = None, seen: int | None = None) -> int:
        """Stage and commit rows; the version they got.  ``recheck(mine,
        theirs)`` is what is left of the staged rows once ``theirs`` was
        committed after version ``seen``; it is asked again for each version
        that another writer gets first."""
        folder = self.stage(df, partition_by)
        seen = self.latest() if seen is None else seen
        while True:
            newest = self.latest()
            if newest > seen and recheck is not None:
                theirs = self.frame([f for v in range(seen + 1, newest + 1) for f in self.manifest(v)["add"]], df.schema)
                if theirs is not None:
                    folder = self.stage(recheck(self.frame([folder], df.schema), theirs), partition_by)
            seen = max(seen, newest)
            if self.commit(seen + 1, [folder], note=note):
                return seen + 1


def read_committed(spark: SparkSession, root: str, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    return CommitLog(spark, root).read(version, schema)
