"""Tables as Parquet: a folded base with a log of later writes.

Every write goes to a folder of its own below the table's log and gets the next version of the store, which is taken by
creating a file of that number: no clock is asked. A write counts once its folder is complete. compact() folds what is
there into a new base and then, as its last step, puts down a marker that names the base and the writes in it. Readers
take the newest marker's base and all writes that it doesn't name, so a write that goes on beside a compaction is
never lost. vacuum() removes what no marker needs any more.

Reading folds only keys that the log touches; all other rows come straight from the base, with filters pushed down to
its files. Without a log nothing is folded or shuffled. Deleting a session writes a tombstone, which hides all rows of
lower versions from every table at once. Files are partitioned by a hash bucket of the session, so a read of one session
touches one folder of each write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict
from ..operators import upsert
from ..schemas import SCHEMA_VERSION, TABLES

KEYS = {
    "sessions": upsert.SESSION_KEY, "transcripts": upsert.MESSAGE_KEY, "events": upsert.EVENT_KEY,
    "transcript_vectors": ("user_id", "session_id", "parent_id"),
}
FIRST = {"sessions": upsert.SESSION_FIRST, "transcripts": upsert.MESSAGE_FIRST}
BROADCAST_BYTES, _WRITE = 32 << 20, "__write="
_TOMBSTONES = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("__dead", T.LongType())])


@dataclass(frozen=True)
class Snapshot:
    """What a table consists of: its base (None before the first compaction) and the writes that come on top."""

    base: int | None
    folded: tuple[int, ...]
    log: tuple[int, ...]


class Store:
    def __init__(self, spark: SparkSession, base_path: str, buckets: int = 64):
        self.spark, self.base, self.buckets = spark, base_path.rstrip("/"), buckets
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files ------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._exists(folder) else []

    def _numbers(self, folder: str) -> list[int]:
        """The complete folders below a folder of writes."""
        found = sorted(int(n.removeprefix(_WRITE)) for n in self._names(folder) if n.startswith(_WRITE))
        return [n for n in found if self._exists(f"{folder}/{_WRITE}{n}/_SUCCESS")]

    def _bytes(self, names: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(n)).getLength() for n in names)

    def _version(self) -> int:
        """The next version: whoever creates its file has it."""
        n = max((int(x) for x in self._names("versions") if x.isdigit()), default=0)
        for _ in range(10_000):
            n += 1
            try:
                self._fs.create(self._path(f"versions/{n}"), False).close()
                return n
            except Py4JJavaError as e:
                if not self._exists(f"versions/{n}"):
                    raise Conflict("no version can be taken", base=self.base) from e
        raise Conflict("no version can be taken", base=self.base)

    def snapshot(self, table: str) -> Snapshot:
        markers = [int(n[:-5]) for n in self._names(f"{table}/markers") if n.endswith(".json")]
        base, folded = None, ()
        if markers:
            base = max(markers)
            stream = self._fs.open(self._path(f"{table}/markers/{base}.json"))
            try:
                folded = tuple(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        done = set(folded)
        return Snapshot(base, folded, tuple(n for n in self._numbers(f"{table}/log") if n not in done))

    def bucket(self, session_id) -> F.Column:
        return F.pmod(F.xxhash64(session_id.cast("string")), F.lit(self.buckets)).cast("int")

    # -- reading ----------------------------------------------------------------------------------------------

    def _load(self, table: str, names: list[str], session_id: str | None) -> DataFrame:
        fields = [*TABLES[table].fields, T.StructField("__v", T.LongType()), T.StructField("__bucket", T.IntegerType())]
        schema = T.StructType(fields)
        if not names:
            return self.spark.createDataFrame([], schema)
        root = f"{self.base}/{names[0].rpartition('/')[0]}"
        rows = self.spark.read.schema(schema).option("basePath", root).parquet(*(f"{self.base}/{n}" for n in names)).drop("__write")
        if session_id is not None:
            rows = rows.filter((F.col("__bucket") == self.bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
        return rows

    def _alive(self, rows: DataFrame, since: int, session_id: str | None) -> DataFrame:
        """rows without those that a tombstone later than version `since` hides."""
        names = [f"tombstones/{_WRITE}{n}" for n in self._numbers("tombstones") if n > since]
        if not names:
            return rows
        dead = self.spark.read.schema(_TOMBSTONES).option("basePath", f"{self.base}/tombstones").parquet(*(f"{self.base}/{n}" for n in names))
        if session_id is not None:
            dead = dead.filter(F.col("session_id") == session_id)
        dead = dead.groupBy(F.col("user_id").alias("__u"), F.col("session_id").alias("__s")).agg(F.max("__dead").alias("__dead"))
        if self._bytes(names) <= BROADCAST_BYTES:
            dead = F.broadcast(dead)
        same = F.col("user_id").eqNullSafe(F.col("__u")) & F.col("session_id").eqNullSafe(F.col("__s"))
        return rows.join(dead, same & (F.col("__v") < F.col("__dead")), "left_anti")

    @staticmethod
    def _fold(table: str, rows: DataFrame) -> DataFrame:
        if table == "transcript_vectors":  # a parent's vectors are replaced together
            newest = F.max("__v").over(Window.partitionBy(*KEYS[table]))
            return rows.withColumn("__newest", newest).filter("__v = __newest").drop("__newest")
        return upsert.fold(rows, KEYS[table], "__v", FIRST.get(table, ()), keep_version=True)

    def _folded(self, table: str, session_id: str | None, at: Snapshot | None = None) -> DataFrame:
        at = at or self.snapshot(table)
        log = [f"{table}/log/{_WRITE}{n}" for n in at.log]
        base = [f"{table}/base/{_WRITE}{at.base}"] if at.base is not None else []
        since = min([at.base or 0, *at.log]) if base or log else 0
        old, new = (self._alive(self._load(table, names, session_id), since, session_id).drop("__bucket") for names in (base, log))
        if not log:
            return old
        if not base:
            return self._fold(table, new)
        keys = KEYS[table]
        touched = new.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
        if self._bytes(log) <= BROADCAST_BYTES:
            touched = F.broadcast(touched)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return old.join(touched, same, "left_anti").unionByName(self._fold(table, old.join(touched, same, "left_semi").unionByName(new)))

    def read(self, table: str, session_id: str | None = None) -> DataFrame:
        return self._folded(table, session_id).select(*TABLES[table].names)

    def written(self, table: str, version: int) -> DataFrame:
        """The rows of one write."""
        return self._load(table, [f"{table}/log/{_WRITE}{version}"], None).select(*TABLES[table].names)

    def schema_meta(self) -> DataFrame:
        return self.spark.createDataFrame([("version", str(SCHEMA_VERSION))], "key string, value string")

    def views(self) -> None:
        """Registers all tables, transcript_messages and vectors_with_context for SQL."""
        from ..operators.vectors import with_context

        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)
        self.read("transcripts").createOrReplaceTempView("transcript_messages")
        with_context(self.read("transcript_vectors"), self.read("transcripts")).createOrReplaceTempView("vectors_with_context")
        self.schema_meta().createOrReplaceTempView("schema_meta")

    # -- writing ----------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("__bucket").write.option("partitionOverwriteMode", "static").partitionBy("__bucket").parquet(f"{self.base}/{name}")

    def append(self, table: str, rows: DataFrame) -> int:
        """Appends rows (columns that are missing are null) and gives the version they got."""
        version = self._version()
        columns = []
        for f in TABLES[table].fields:
            own = F.col(f.name) if f.name in rows.columns else F.lit(None)
            columns.append(own.cast(f.dataType).alias(f.name))
        full = rows.select(*columns).withColumns({"__v": F.lit(version).cast("long"), "__bucket": self.bucket(F.col("session_id"))})
        self._write(full, f"{table}/log/{_WRITE}{version}")
        return version

    def delete(self, sessions: DataFrame) -> None:
        """Hides all rows of the sessions (user_id, session_id) that are stored up to now."""
        version = self._version()
        rows = sessions.select("user_id", "session_id", F.lit(version).cast("long").alias("__dead"))
        rows.write.parquet(f"{self.base}/tombstones/{_WRITE}{version}")

    def migrate(self, messages: DataFrame) -> int | None:
        """Takes over messages of the oldest layout, with a vector column for each content type: their vectors become
        rows, unless there are vectors already. Gives the version of the write, if any (W11)."""
        now = self.snapshot("transcript_vectors")
        if now.base is not None or now.log:
            return None
        own = messages.select(F.col("id").alias("parent_id"), "user_id", "session_id", "project_slug")
        return self.append("transcript_vectors", upsert.unpivot_vectors(messages).join(own, "parent_id"))

    def compact(self, table: str) -> int | None:
        """Folds the log into a new base, without what tombstones hide; gives its number, if there was a log."""
        at = self.snapshot(table)
        if not at.log and not [n for n in self._numbers("tombstones") if n > (at.base or 0)]:
            return None
        number = self._version()
        rows = self._folded(table, None, at).withColumn("__bucket", self.bucket(F.col("session_id")))
        self._write(rows, f"{table}/base/{_WRITE}{number}")
        hidden = self._path(f"{table}/markers/.{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(json.dumps(sorted({*at.folded, *at.log})).encode()))
        stream.close()
        if not self._fs.rename(hidden, self._path(f"{table}/markers/{number}.json")):
            raise Conflict("the marker of a compaction can't be put down", table=table)
        return number

    def vacuum(self, table: str) -> int:
        """Deletes older bases and the writes that the newest one holds; gives how many. Readers that began before the
        last compaction may fail, so run it when they are done."""
        at = self.snapshot(table)
        older = [n for n in self._names(f"{table}/base") if n.startswith(_WRITE) and int(n.removeprefix(_WRITE)) < (at.base or 0)]
        gone = [f"{table}/log/{_WRITE}{n}" for n in at.folded] + [f"{table}/base/{n}" for n in older]
        return sum(bool(self._fs.delete(self._path(n), True)) for n in gone)
