"""A table of keyed rows that is appended to and merged when it is read.

Rows are written once and never changed: a start row, later a row with the same key and
the completion's columns.  A reader merges them: of each column the last value that is
not null, by version.  ``compact`` rewrites the key buckets that have new rows and swaps
them in.  What belongs to the table is listed in numbered commit files; a commit is one
rename that fails if its number is taken, so a job that dies between writing and that
rename leaves files that nobody lists, and loses nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class CommitTaken(RuntimeError):
    """Somebody else made this commit; read the state again and retry."""


class KeyedLog:
    """A merged-on-read table under ``path``, a folder that driver and executors share.

    ``schema`` lists all columns; ``key`` names a row, ``version`` orders its rows (equal versions:
    the larger value wins).  Rows with a null in the key are kept as one key like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: Sequence[str], version: str, buckets: int = 16):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), list(key), version, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.Path(self.path).getFileSystem(self._conf)

    # commits -----------------------------------------------------------------------------

    def _commits(self) -> list[int]:
        folder = self._jvm.Path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The last commit: its number, the folder of each bucket, rows not yet merged in, applied batches."""
        numbers = self._commits()
        if not numbers:
            return {"number": 0, "base": {}, "deltas": [], "batches": {}}
        text = self.spark.read.text(f"{self.path}/commits/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        return json.loads(text) | {"number": numbers[-1]}

    def _commit(self, state: dict, number: int) -> None:
        data = json.dumps({k: state[k] for k in ("base", "deltas", "batches")}, sort_keys=True).encode()
        folder = f"{self.path}/commits"
        self._fs.mkdirs(self._jvm.Path(folder))
        draft, final = self._jvm.Path(f"{folder}/.{uuid.uuid4().hex}"), self._jvm.Path(f"{folder}/{number:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(data))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "Options$Rename"), 0)
        files = self._jvm.FileContext.getFileContext(self._jvm.Path(self.path).toUri(), self._conf)
        try:
            files.rename(draft, final, options)  # fails if the number is taken
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise CommitTaken(number) from e
            raise

    def _change(self, change: Callable[[dict], dict], tries: int = 20) -> None:
        for left in range(tries - 1, -1, -1):
            state = self.state()
            try:
                return self._commit(change(state), state["number"] + 1)
            except CommitTaken:
                if not left:
                    raise

    # rows --------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)
        own = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        # each bucket is one file of a task, split where it grows large
        rows.select(*own, bucket).repartition(BUCKET).write.option("maxRecordsPerFile", 5_000_000).partitionBy(BUCKET).parquet(f"{self.path}/data/rows={name}")
        return name

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Add rows with some or all of the columns; what is missing stays as it was.

        With ``writer`` and ``batch`` a batch is added once: again, or an earlier one, changes nothing
        and gives False."""
        if writer is not None and self.state()["batches"].get(writer, -1) >= batch:
            return False
        name = self._write(rows)

        def change(state: dict) -> dict:
            batches = state["batches"] | ({writer: batch} if writer is not None else {})
            return state | {"deltas": [*state["deltas"], name], "batches": batches}

        self._change(change)
        return True

    def _load(self, folders: Sequence[str]) -> DataFrame | None:
        shape = T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])
        found = [f"{self.path}/data/rows={f}" for f in folders]
        return self.spark.read.schema(shape).option("basePath", f"{self.path}/data").parquet(*found).select(*shape.names) if found else None

    def _merged(self, rows: DataFrame) -> DataFrame:
        # the key is compared as it is, nulls and all
        order = F.col(self.version)
        last = {f.name: F.max(F.when(F.col(f.name).isNotNull(), F.struct(order.alias("v"), F.col(f.name).alias("x")))) for f in self.schema if f.name not in self.key}
        merged = rows.groupBy(*self.key, BUCKET).agg(*[c.alias(n) for n, c in last.items()])
        return merged.select(*[F.col(f.name) if f.name in self.key else F.col(f.name)["x"].alias(f.name) for f in self.schema], BUCKET)

    def _parts(self, state: dict, buckets: Sequence[str] | None = None) -> list[str]:
        return sorted({f"{name}/{BUCKET}={b}" for b, name in state["base"].items() if buckets is None or b in buckets})

    def read(self) -> DataFrame:
        """One row a key.  Buckets without new rows are taken as they are."""
        state = self.state()
        fresh = self._load(state["deltas"])
        base = self._load(self._parts(state))
        if fresh is None:
            return (base if base is not None else self.spark.createDataFrame([], self.schema)).select(self.schema.names)
        rows = fresh if base is None else base.unionByName(fresh)
        return self._merged(rows).select(self.schema.names)

    def compact(self, before_swap: Callable[[], None] | None = None) -> int:
        """Merge new rows into the buckets they belong to; the number of buckets swapped.

        Rows appended meanwhile stay new rows.  ``before_swap`` is called when all is written."""
        state = self.state()
        done = state["deltas"]
        fresh = self._load(done)
        if fresh is None:
            return 0
        touched = sorted(str(r[0]) for r in fresh.select(BUCKET).distinct().collect())
        base = self._load(self._parts(state, touched))
        name = self._write(self._merged(fresh if base is None else base.unionByName(fresh)))
        if before_swap:
            before_swap()

        def change(now: dict) -> dict:
            if any(now["base"].get(b) != state["base"].get(b) for b in touched) or now["deltas"][: len(done)] != done:
                raise RuntimeError("another compaction of these buckets came first")
            return now | {"base": now["base"] | dict.fromkeys(touched, name), "deltas": now["deltas"][len(done) :]}

        self._change(change)
        return len(touched)

    def unlisted(self) -> list[str]:
        """Folders of data that the last commit does not list: replaced, or left by a job that died."""
        folder = self._jvm.Path(f"{self.path}/data")
        state = self.state()
        used = {*state["base"].values(), *state["deltas"]}
        if not self._fs.exists(folder):
            return []
        return sorted(n for s in self._fs.listStatus(folder) if (n := s.getPath().getName().removeprefix("rows=")) not in used)


def command_log(spark: SparkSession, path: str, buckets: int = 16) -> KeyedLog:
    """The log of maintenance commands: a row when a command starts, its end and error when it completes."""
    schema = "id long, database_name string, command_type string, start_time timestamp_ntz, end_time timestamp_ntz, error_number long, step int"
    return KeyedLog(spark, path, schema, ["id"], "step", buckets)


def log_started(log: KeyedLog, rows: DataFrame) -> bool:
    return log.append(rows.drop("end_time", "error_number").withColumn("step", F.lit(0)))


def log_completed(log: KeyedLog, rows: DataFrame) -> bool:
    return log.append(rows.select(*log.key, "end_time", "error_number").withColumn("step", F.lit(1)))


def upsert_sink(log: KeyedLog, writer: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends each micro-batch once, with its number as the version."""

    def write(rows: DataFrame, batch: int) -> None:
        log.append(rows.withColumn(log.version, F.lit(batch).cast(log.schema[log.version].dataType)), writer, batch)

    return write

