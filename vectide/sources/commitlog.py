"""A store on shared storage whose versions share files: a commit log names, part by part, the folders that hold it.

    base/data/commit=<id>/<part>=<n>/*.parquet     rows; a commit's folder is written once and never changed
    base/side/<id>-<name>                          small tables that belong to a commit
    base/log/<version>.json                        for each part the commits that hold it: rows, then deltas

A version exists once its log file is there. That file is written aside and renamed to a name that must not exist
yet, so readers see a version whole or not at all, and of two writers one has to try again. A write copies only
the parts that it touches; all other parts stay the same files. Deltas are added without a copy and count at once;
`fold` puts them into the parts they touch. What a failed write leaves behind is in no log file and goes with
`vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from vectide.operators.store import few_keys, latest_per_id, settle
from vectide.session import cut_lineage

# Deltas that a stream adds before it folds them in.
FOLD_AFTER = 8


class Conflict(RuntimeError):
    """Another writer has committed the version that this one meant to."""


@dataclass
class State:
    """One version: the commits of each part (rows, then deltas), the side tables, the last batch of each writer."""

    version: int = 0
    schema: str = ""
    parts: dict[str, list[str]] = field(default_factory=dict)
    side: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    ms: int = 0

    @property
    def deltas(self) -> list[str]:
        return sorted({c for commits in self.parts.values() for c in commits[1:]})


class _Folder:
    """Names, small files and renames in the file system of a path, whichever Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.no_options = spark.sparkContext._gateway.new_array(
            getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.conf), place

    def names(self, path: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what is in a folder; nothing where there is none."""
        system, place = self._at(path)
        if not system.exists(place):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(place))

    def read(self, path: str) -> str:
        system, place = self._at(path)
        stream = system.open(place)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """The whole file or nothing; Conflict where the name is taken."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        system, place = self._at(aside)
        stream = system.create(place, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(place).toUri(), self.conf)
        try:
            context.rename(system.makeQualified(place), system.makeQualified(target), self.no_options)
        except Py4JJavaError as error:
            system.delete(place, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(path) from None
            raise

    def delete(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)


class StoreLog:
    """The store below `base`, with one row per `key`, in parts by the int column `part`.

    The newest row of a key by `newest` counts, then the highest `tie` where rows have one; a write beats a stored
    row of equal age. Rows without a part are in part -1.
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "embedding_id", part: str = "shard",
                 tie: str | None = None):
        self.spark, self.base, self.key, self.part, self.tie = spark, base.rstrip("/"), key, part, tie
        self.files = _Folder(spark)

    # -- versions

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n, _ in self.files.names(f"{self.base}/log") if n.endswith(".json")]

    def state(self, version: int | None = None) -> State:
        """A version, by default the newest; version 0 is the empty store before the first write."""
        if version is None:
            version = max(self.versions(), default=0)
        return State(**json.loads(self.files.read(self._log(version)))) if version else State()

    def _log(self, version: int) -> str:
        return f"{self.base}/log/{version:020d}.json"

    def _commit(self, old: State, parts: dict[str, list[str]], schema: StructType, side: dict[str, str],
                writer: str | None, batch: int | None) -> int:
        applied = old.applied if writer is None else old.applied | {writer: batch}
        new = State(old.version + 1, schema.json(), parts, side, applied, int(time.time() * 1000))
        self.files.write_new(self._log(new.version), json.dumps(vars(new)))
        return new.version

    # -- reading

    def _rows(self, state: State, folders: list[tuple[str, str]]) -> DataFrame:
        """Rows of (commit, part) folders; commit and part are partition columns."""
        schema = StructType.fromJson(json.loads(state.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.base}/data/commit={commit}/{self.part}={part}" for commit, part in sorted(folders)]
        whole = StructType([*schema.fields, StructField("_commit_id", StringType())])
        read = self.spark.read.schema(whole).option("basePath", f"{self.base}/data").parquet(*paths)
        return read.select([f.name for f in schema.fields])

    def _plain(self, state: State) -> DataFrame:
        return self._rows(state, [(commits[0], part) for part, commits in state.parts.items() if commits[0]])

    def _pending(self, state: State) -> DataFrame:
        return self._rows(state, [(c, part) for part, commits in state.parts.items() for c in commits[1:]])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. A filter on the part column prunes folders, if no deltas wait to be folded in."""
        state = self.state(version)
        rows = self._plain(state) if state.version else None
        if rows is None:
            raise ValueError(f"no version in {self.base}")
        return settle(rows, self._latest(self._pending(state)), self.key, self.tie) if state.deltas else rows

    def side(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.state(version).side[name])

    # -- writing

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest_per_id(rows, self.key, tie=self.tie)

    def _write_rows(self, rows: DataFrame) -> tuple[str, list[str]]:
        """(commit id, parts) of rows written to a folder of their own; large parts are split, small ones merged."""
        commit = f"c{uuid.uuid4().hex}"
        rows = rows.withColumn(self.part, F.coalesce(F.col(self.part).cast("int"), F.lit(-1)))
        rows.hint("rebalance", self.part).write.partitionBy(self.part).parquet(f"{self.base}/data/commit={commit}")
        written = [n for n, _ in self.files.names(f"{self.base}/data/commit={commit}")]
        return commit, [n.removeprefix(f"{self.part}=") for n in written if n.startswith(f"{self.part}=")]

    def _write_side(self, tables: dict[str, DataFrame] | None) -> dict[str, str]:
        out = {}
        for name, table in (tables or {}).items():
            out[name] = f"{self.base}/side/{uuid.uuid4().hex}-{name}"
            table.write.parquet(out[name])
        return out

    def _done(self, state: State, writer: str | None, batch: int | None) -> bool:
        return writer is not None and state.applied.get(writer, -1) >= batch

    def _schema(self, rows: DataFrame) -> StructType:
        return StructType([*(f for f in rows.schema.fields if f.name != self.part), StructField(self.part, IntegerType())])

    def write(self, rows: DataFrame, side: dict[str, DataFrame] | None = None) -> int:
        """A whole new version; its number. `rows` has one row per key."""
        state = self.state()
        if self.tie and self.tie not in rows.columns:
            rows = rows.withColumn(self.tie, F.lit(-1).cast("long"))
        commit, parts = self._write_rows(rows)
        return self._commit(state, {p: [commit] for p in parts}, self._schema(rows), self._write_side(side), None, None)

    def touched(self, state: State, writes: DataFrame) -> list[int]:
        """Parts that hold a written key now or are to hold it; at most all parts, by number."""
        stored = self._plain(state).select(self.key, self.part).join(few_keys(writes, self.key), self.key, "left_semi")
        both = stored.select(self.part).union(writes.select(F.coalesce(F.col(self.part).cast("int"), F.lit(-1))))
        return [row[0] for row in both.distinct().collect()]

    def upsert(self, writes: DataFrame, writer: str | None = None, batch: int | None = None, side=None) -> int:
        """The version after `writes`: the parts that hold a written key, before or after, are written anew.

        `writer` and `batch` make a repeated call change nothing. `side`, given the parts (as numbers) and their new
        rows, returns side tables. Deltas that wait are folded in as well.
        """
        state = self.state()
        if self._done(state, writer, batch):
            return state.version
        if not state.version:
            raise ValueError(f"no version in {self.base}")
        if state.deltas:
            writes = self._pending(state).unionByName(writes, allowMissingColumns=True)
        writes = cut_lineage(self._latest(writes))
        numbers = self.touched(state, writes)
        old = self._plain(state)
        new = settle(old.filter(F.col(self.part).isin(numbers)), writes, self.key, self.tie)
        commit, written = self._write_rows(new)
        parts = {p: commits[:1] for p, commits in state.parts.items() if int(p) not in numbers}
        parts |= {p: [commit] for p in written}
        fresh = self._rows(state, [(commit, p) for p in written])
        tables = state.side | self._write_side(side(numbers, fresh) if side else None)
        return self._commit(state, parts, old.schema, tables, writer, batch)

    def append(self, writes: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """The version with `writes` as a delta: no stored part is read or written."""
        state = self.state()
        if self._done(state, writer, batch):
            return state.version
        schema = self._plain(state).schema
        rows = self._latest(writes).select([
            (F.col(f.name) if f.name in writes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        commit, written = self._write_rows(rows)
        parts = {p: list(commits) for p, commits in state.parts.items()}
        for p in written:
            parts.setdefault(p, [""]).append(commit)  # a part that has only deltas has no rows yet
        return self._commit(state, parts, schema, state.side, writer, batch)

    def fold(self) -> int:
        """The version with all deltas in the parts they touch."""
        state = self.state()
        return self.upsert(self._pending(state)) if state.deltas else state.version

    def vacuum(self, keep_ms: int) -> list[str]:
        """Removes versions older than `keep_ms` but the newest, and folders no version left names; their names.

        `keep_ms` must be longer than any read or write takes.
        """
        limit, versions = int(time.time() * 1000) - keep_ms, self.versions()
        gone = [v for v in versions[:-1] if self.state(v).ms <= limit]
        for version in gone:
            self.files.delete(self._log(version))
        left = [self.state(v) for v in versions if v not in gone]
        named = {f"commit={c}" for s in left for commits in s.parts.values() for c in commits}
        named |= {path.rsplit("/", 1)[1] for s in left for path in s.side.values()}
        removed = []
        for folder in ("data", "side"):
            for name, changed in self.files.names(f"{self.base}/{folder}"):
                if name not in named and changed <= limit:
                    self.files.delete(f"{self.base}/{folder}/{name}")
                    removed.append(f"{folder}/{name}")
        return removed
