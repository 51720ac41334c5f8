"""A store of enumerated paths that keeps up with its functions: read back, replace, invalidate, at any kept version."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.compare import KEY, cached_paths, content_hashes, path_elements

_MARKS = "function_id long, content_hash string, version long"
_ELEMENTS = "function_id long, path_id string, path_kind string, sequence_order int, block_id int, bucket int"
#: Folders by function in each part of the store; parts beyond which a put compacts; seconds that a version may take to write.
BUCKETS, PARTS, WAIT = 16, 16, 10.0


class PathStore:
    """Parquet under ``folder``: ``parts/<name>/marks`` and ``elements``, never changed once written, and
    ``versions/<number>``, one small file for each version, which lists the parts that it consists of.

    A put writes its part under a new name and then takes the next free version number, which only one writer can: the file
    is made where there is none, or not at all (the file system must know this; HDFS and local ones do). So writers lose
    nothing to each other, whatever numbers they count their own puts by, and a part that failed half-way is in no version.
    A function's newest mark says which part holds its paths, and what they were made from; no elements there: it has
    none, or they are invalid. Every PARTS puts all valid paths are written to one part, so that a reader never meets many
    more than that. A version stays as it is, until ``expire``.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder, self.fixed = spark, folder, version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(name) for f in self._fs.listStatus(at) if (name := f.getPath().getName()).isdigit())

    def _entry(self, version: int) -> dict | None:
        """``parts``, as version and name, and the last epoch of all ``writers``; None while it is being written."""
        if version == 0:
            return {"parts": [], "writers": {}}
        try:
            stream = self._fs.open(self._path(self._file(version)))
        except Exception as e:  # the JVM's FileNotFoundException, by way of py4j
            if "FileNotFound" in str(e):
                return None
            raise
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def _file(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}"

    def _latest(self) -> tuple[int, dict]:
        return next(((v, e) for v in reversed([0, *self._numbers()]) if (e := self._entry(v)) is not None))

    def versions(self) -> list[int]:
        """The numbers of all kept versions."""
        return [v for v in self._numbers() if self._entry(v) is not None]

    def at(self, version: int) -> PathStore:
        """The store as it was at that version, whatever is put later."""
        if self._entry(version) is None:
            raise ValueError(f"version {version} is not kept in {self.folder}")
        return PathStore(self.spark, self.folder, version)

    def next_epoch(self) -> int:
        """The version that the next put gets where nobody else puts."""
        return max(self._numbers(), default=0) + 1

    def _commit(self, change: Callable[[dict, int], dict | None]) -> int | None:
        """The number of a new version: what ``change`` makes of the latest one and the number; None where it makes nothing.

        A version that stays unwritten for WAIT seconds is passed over. Should its writer still be at work, both look
        again after writing, and who finds a version that lacks the other's part makes one with both.
        """
        while True:
            (parent, entry), number = self._latest(), self.next_epoch()
            until = time.monotonic() + WAIT
            while number != parent + 1 and time.monotonic() < until:
                time.sleep(0.1)
                (parent, entry), number = self._latest(), self.next_epoch()
            new = change(entry, number)
            if new is None:
                return None
            try:
                out = self._fs.create(self._path(self._file(number)), False)
            except Exception as e:  # the JVM's FileAlreadyExistsException, by way of py4j
                if "AlreadyExists" in str(e):
                    continue
                raise
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            self._mend(entry, parent, number)
            return number

    def _mend(self, base: dict, parent: int, number: int) -> None:
        """Joins versions that were made beside each other: passed-over ones that were written after all, and newer ones."""
        others = [e for v in self._numbers() if v > parent and (e := self._entry(v)) is not None]
        added = {tuple(p) for e in others for p in e["parts"]} - {tuple(p) for p in base["parts"]}
        latest = {tuple(p) for p in self._latest()[1]["parts"]}
        own = {tuple(p) for p in self._entry(number)["parts"]}
        replaced = {tuple(p) for p in base["parts"]} - own  # by a compaction
        if not (added - replaced) <= latest:
            writers = {w: max(e["writers"].get(w, -1) for e in others) for e in others for w in e["writers"]}
            self._commit(lambda e, _: {"parts": sorted({tuple(p) for p in e["parts"]} | added), "writers": writers | e["writers"]} if not added <= {tuple(p) for p in e["parts"]} else None)

    # --- writing

    def put(self, functions: DataFrame, paths: DataFrame, epoch: int | None = None, writer: str | None = None) -> int | None:
        """What ``paths`` has (``function_id, path_id, path_kind, blocks``) takes the place of all paths that each of the
        ``functions`` (``function_id, content_hash``) had, also where it has none for one. Returns the version.

        ``epoch`` is the ``writer``'s own number of this put: of a named writer's puts, in order, one that was made already
        is not made again (None is returned). It says nothing about other writers, or without a name.
        """
        done = lambda e: writer is not None and epoch is not None and epoch <= e["writers"].get(writer, epoch - 1)
        if done(self._latest()[1]):
            return None
        name = uuid.uuid4().hex
        self._write(name, functions.select(KEY, F.col("content_hash").cast("string")), path_elements(paths))
        own = {} if writer is None or epoch is None else {writer: epoch}
        version = self._commit(lambda e, n: None if done(e) else {"parts": [*e["parts"], [n, name]], "writers": e["writers"] | own})
        if len(self._latest()[1]["parts"]) > PARTS:
            self.compact()
        return version

    def _write(self, part: str, marks: DataFrame, elements: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int")
        elements.withColumn("bucket", bucket).repartition("bucket", KEY).sortWithinPartitions(KEY).write.partitionBy("bucket").parquet(f"{self.folder}/parts/{part}/elements")
        marks.write.parquet(f"{self.folder}/parts/{part}/marks")

    def invalidate(self, functions: DataFrame, epoch: int | None = None, writer: str | None = None) -> int | None:
        """The functions (``function_id``) have no stored paths any more."""
        none = self.spark.createDataFrame([], "function_id long, path_id string, path_kind string, blocks array<int>")
        return self.put(functions.select(KEY, F.lit(None).alias("content_hash")).distinct(), none, epoch, writer)

    def compact(self) -> int | None:
        """Writes what is valid now as one part; parts put meanwhile stay beside it. Returns the version."""
        upto, entry = self._latest()
        now, name, old = self.at(upto), uuid.uuid4().hex, [tuple(p) for p in entry["parts"]]
        if not old:
            return None
        self._write(name, now.marks().select(KEY, "content_hash"), now.elements())

        def replace(e: dict, _: int) -> dict | None:
            parts = [tuple(p) for p in e["parts"]]
            if not set(old) <= set(parts):  # another compaction came first
                return None
            return {"parts": [(max(v for v, _ in old), name), *(p for p in parts if p not in old)], "writers": e["writers"]}

        return self._commit(replace)

    def expire(self) -> None:
        """Deletes all versions but the latest, and parts that only they have."""
        last, entry = self._latest()
        kept = {name for _, name in entry["parts"]}
        old = {v: e for v in self._numbers() if v < last and (e := self._entry(v)) is not None}
        for name in {name for e in old.values() for _, name in e["parts"]} - kept:
            self._fs.delete(self._path(f"{self.folder}/parts/{name}"), True)
        for v in old:
            self._fs.delete(self._path(self._file(v)), False)

    # --- reading

    def _parts(self) -> list[tuple[int, str]]:
        return (self._latest()[1] if self.fixed is None else self._entry(self.fixed))["parts"]

    def _read(self, part: str, kind: str, schema: str) -> DataFrame:
        at = f"{self.folder}/parts/{part}/{kind}"
        return self.spark.read.schema(schema).parquet(at)

    def marks(self) -> DataFrame:
        """``function_id, content_hash, version``: the newest mark of each function; hash null: invalid."""
        some = [self._read(p, "marks", "function_id long, content_hash string").withColumn("version", F.lit(v).cast("long")) for v, p in self._parts()]
        if not some:
            return self.spark.createDataFrame([], _MARKS)
        newest = reduce(DataFrame.unionByName, some).groupBy(KEY).agg(F.max(F.struct("version", "content_hash")).alias("m"))
        return newest.select(KEY, "m.content_hash", "m.version")

    def elements(self, functions: list[int] | None = None) -> DataFrame:
        """The valid paths' blocks (``compare.path_elements``), of all functions or of a few: then only their folders are read."""
        some = [self._read(p, "elements", _ELEMENTS).withColumn("version", F.lit(v).cast("long")) for v, p in self._parts()]
        rows = reduce(DataFrame.unionByName, some) if some else self.spark.createDataFrame([], f"{_ELEMENTS}, version long")
        if functions is not None:
            own = self.spark.createDataFrame([(f,) for f in functions], "f long").select(F.pmod(F.xxhash64("f"), F.lit(BUCKETS))).distinct()
            rows = rows.where(F.col("bucket").isin([r[0] for r in own.collect()]) & F.col(KEY).isin(functions))
        return rows.join(self.marks().select(KEY, "version"), [KEY, "version"], "left_semi").drop("version", "bucket")

    def paths(self, functions: list[int] | None = None) -> DataFrame:
        """``function_id, path_id, path_kind, entry, exit, blocks`` of all valid paths, or of a few functions'."""
        return cached_paths(self.elements(functions))

    def changed(self, blocks: DataFrame) -> DataFrame:
        """``function_id, content_hash`` of functions whose paths aren't stored, or were made from other blocks."""
        return content_hashes(blocks).join(self.marks().where("content_hash is not null").select(KEY, "content_hash"), [KEY, "content_hash"], "left_anti")

    def gone(self, blocks: DataFrame) -> DataFrame:
        """``function_id`` of stored functions that have no block any more."""
        return self.marks().where("content_hash is not null").select(KEY).join(blocks.select(KEY).distinct(), KEY, "left_anti")
