"""Published versions of stored collections.

Files are never replaced. A job writes its partitions into folders of their
own (``<collection>/<key>=<value>/.../v=<label>``) next to those of earlier
versions, and then publishes: one small manifest that names, for every
collection, the folders that make it up. The manifest appears under its
number by a rename, so a reader sees all of a version or nothing of it, for
all collections at once, and a job that dies before leaves only folders that
no manifest names. Of two jobs that start from the same version, one
publishes; the other fails and may start again.

A partition may be *replaced* (its earlier folders are not named any more) or
*added to* (it has several folders, and the reader merges their rows).
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"
LABEL = "v"

#: Decides for a partition, given its key values (as text), whether a write replaces it.
Scope = Callable[[dict[str, str]], bool]


class PublishConflict(RuntimeError):
    """Another job published a version since this one started."""


@dataclass(frozen=True)
class Collection:
    """What a version holds of one collection."""

    schema: str                      # of the rows, without the label; as JSON
    partition_by: tuple[str, ...]
    folders: tuple[str, ...]         # relative to the collection, ending in ``v=<label>``
    meta: dict = field(default_factory=dict)

    @property
    def added_to(self) -> bool:
        """True if some partition has rows of more than one write."""
        partitions = [f.rpartition("/")[0] for f in self.folders]
        return len(set(partitions)) < len(partitions)


@dataclass(frozen=True)
class Manifest:
    number: int
    collections: dict[str, Collection]

    def text(self) -> str:
        return json.dumps({"number": self.number, "collections": {
            n: {"schema": c.schema, "partition_by": c.partition_by, "folders": c.folders, "meta": c.meta} for n, c in sorted(self.collections.items())}})

    @staticmethod
    def read(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(raw["number"], {n: Collection(c["schema"], tuple(c["partition_by"]), tuple(c["folders"]), c["meta"])
                                        for n, c in raw["collections"].items()})


def folder_keys(folder: str) -> dict[str, str]:
    """Key values of a partition folder, without the label."""
    return {k: v for k, _, v in (part.partition("=") for part in folder.split("/")) if k != LABEL}


class Versions:
    """All versions under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._read: dict[int, Manifest] = {}

    # -- files -----------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of all published versions, ascending: one listing of a folder of small files."""
        fs, folder = self._fs(), self._path(MANIFESTS)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def at(self, number: int) -> Manifest:
        """The version with this number. Manifests never change, so each is read once."""
        if number not in self._read:
            stream = self._fs().open(self._path(MANIFESTS, f"{number:012d}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._read[number] = Manifest.read(text)
        return self._read[number]

    def newest(self) -> Manifest | None:
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else None

    # -- reading ---------------------------------------------------------
    def frame(self, manifest: Manifest, name: str, keep: Scope | None = None) -> DataFrame:
        """Rows of a collection as a version holds them; ``keep`` leaves only
        some partitions. Folders are named one by one: nothing else is listed."""
        c = manifest.collections[name]
        schema = StructType.fromJson(json.loads(c.schema))
        folders = [f for f in c.folders if keep is None or keep(folder_keys(f))]
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        df = self.spark.read.schema(schema.add(LABEL, "string")).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))
        return df.drop(LABEL).select([f.name for f in schema.fields if f.name != LABEL])

    def portions(self, manifest: Manifest, name: str, key: str, most: int) -> list[set[str]]:
        """Values of the partition key ``key``, in groups: as many neighbours as
        hold up to ``most`` bytes together, by the sizes of their folders."""
        fs, sizes = self._fs(), {}
        for f in manifest.collections[name].folders:
            value = folder_keys(f)[key]
            sizes[value] = sizes.get(value, 0) + fs.getContentSummary(self._path(name, f)).getLength()
        out, room = [], 0
        for value in sorted(sizes, key=lambda v: (len(v), v)):
            if not out or sizes[value] > room:
                out.append(set())
                room = most
            out[-1].add(value)
            room -= sizes[value]
        return out

    # -- writing ---------------------------------------------------------
    def draft(self) -> Draft:
        return Draft(self)

    def prune(self, keep: int = 2) -> list[int]:
        """Remove all but the newest ``keep`` versions, and folders that no
        version left names. Not while a job that will publish is running: its
        folders are not named yet. Readers of a removed version fail."""
        numbers = self.numbers()
        left, gone = numbers[-keep:], numbers[:-keep]
        named = {(n, f) for k in left for n, c in self.at(k).collections.items() for f in c.folders}
        names = {n for k in numbers for n in self.at(k).collections}
        fs = self._fs()
        for k in gone:
            fs.delete(self._path(MANIFESTS, f"{k:012d}.json"), False)
            self._read.pop(k, None)
        for name in sorted(names):
            folder = self._path(name)
            depth = max((len(c.partition_by) for k in left for n, c in self.at(k).collections.items() if n == name), default=None)
            if depth is None:
                fs.delete(folder, True)
                continue
            for status in fs.globStatus(self._path(name, *["*=*"] * depth, f"{LABEL}=*")) or ():
                relative = "/".join(status.getPath().toString().split("/")[-depth - 1:])
                if (name, relative) not in named:
                    fs.delete(status.getPath(), True)
        return gone


class Draft:
    """A version in the making, on top of the newest one."""

    def __init__(self, versions: Versions):
        self.versions = versions
        self.base = versions.newest() or Manifest(0, {})
        self.collections = dict(self.base.collections)
        self._last: dict[str, str] = {}
        self._lock = threading.Lock()

    def write(self, df: DataFrame | list[DataFrame], name: str, partition_by: tuple[str, ...] = (), replaces: Scope | None = None,
              adds: bool = False, meta: dict | None = None, clustered: bool = False) -> None:
        """Write ``df`` as partitions of collection ``name``. Partitions for
        which ``replaces`` holds (default: all) are those of ``df`` then, also
        where it has no rows for them; with ``adds`` all stay, and the rows come on top.

        The ``rebalance`` hint clusters rows by the partition columns (few
        files per partition) and lets adaptive execution split a hot one. Rows
        that are ``clustered`` come from a shuffle of their own already, in
        tasks that adaptive execution sized: they are written from these, a file
        for each task and partition, and do not cross the network again
        (without adaptive execution, all rows are clustered here). Each
        task commits its own files, so a lost executor re-runs its tasks only.
        Jobs of one draft may write different collections at the same time.
        """
        versions, label = self.versions, f"{self.base.number + 1}-{uuid.uuid4().hex[:8]}"
        sized = all(versions.spark.conf.get(f"spark.sql.adaptive.{c}", "true") == "true" for c in ("enabled", "coalescePartitions.enabled"))
        frames = df if isinstance(df, list) else [df]
        for rows in frames:
            rows = rows.hint("rebalance", *partition_by) if partition_by and not (clustered and sized) else rows
            rows.withColumn(LABEL, F.lit(label)).write.mode("append").partitionBy(*partition_by, LABEL).parquet(f"{versions.root}/{name}")
        found = versions._fs().globStatus(versions._path(name, *["*=*"] * len(partition_by), f"{LABEL}={label}")) or ()
        depth = len(partition_by) + 1
        folders = ["/".join(s.getPath().toString().split("/")[-depth:]) for s in found]
        with self._lock:
            self._last[name] = label
            had = self.collections.get(name)
            kept = [] if had is None or (replaces is None and not adds) else \
                [f for f in had.folders if adds or not replaces(folder_keys(f))]
            self.collections[name] = Collection(frames[0].schema.json(), tuple(partition_by), tuple(sorted({*kept, *folders})),
                                                meta if meta is not None else had.meta if had else {})

    def frame(self, name: str, keep: Scope | None = None) -> DataFrame:
        """Rows of a collection as the draft holds them now."""
        return self.versions.frame(Manifest(self.base.number, self.collections), name, keep)

    def portions(self, name: str, key: str, most: int) -> list[set[str]]:
        return self.versions.portions(Manifest(self.base.number, self.collections), name, key, most)

    def own(self, name: str) -> DataFrame:
        """Rows that this draft wrote last to a collection."""
        held, end = self.collections[name], f"{LABEL}={self._last[name]}"
        mine = replace(held, folders=tuple(f for f in held.folders if f.endswith(end)))
        return self.versions.frame(Manifest(self.base.number, {name: mine}), name)

    def publish(self) -> int:
        """Make this version the newest one; :class:`PublishConflict` if another came first."""
        versions, number = self.versions, self.base.number + 1
        jvm = versions.spark._jvm
        fs = versions._fs()
        written = versions._path(MANIFESTS, f"{number:012d}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(written, True)
        try:
            stream.write(bytearray(Manifest(number, self.collections).text().encode()))
        finally:
            stream.close()
        target = versions._path(MANIFESTS, f"{number:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), versions.spark._jsc.hadoopConfiguration())
        none = versions.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(written), fs.makeQualified(target), none)  # refuses a name that is taken
        except Exception as exc:
            fs.delete(written, False)
            if fs.exists(target):
                raise PublishConflict(f"version {number} of {versions.root} was published by another job") from exc
            raise
        return number
