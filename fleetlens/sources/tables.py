"""Access to the adapter views as DataFrames, batch or streaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.adapters import ADAPTERS

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# DISTINCT views of nearly as many rows as their base table, and that table
LARGE_DISTINCT = {"db_permissions": "lineitem"}
ROWS_A_PART = 250_000  # of such a view: what one task holds in memory at once
_FROM = re.compile(r"\b(from|join)\s+(" + "|".join(BASE) + r")\b", re.IGNORECASE)


class Tables:
    """``tables.waits`` is the adapter view ``waits`` over the files in ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A base table; its footer is read once per instance."""
        key = f"base:{name}"
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._frames[key]

    def stream_base(self, name: str) -> DataFrame:
        """The same file as a file stream."""
        schema = self.base(name).schema
        return (
            self.spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.root)
        )

    def _shape(self, text: str, load) -> DataFrame:
        used = {m.group(2).lower() for m in _FROM.finditer(text)}
        query = _FROM.sub(lambda m: f"{m.group(1)} {{{m.group(2).lower()}}}", text)
        return self.spark.sql(query, **{name: load(name) for name in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ADAPTERS:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._distinct(name) if name in LARGE_DISTINCT else self._shape(ADAPTERS[name], self.base)
        return self._frames[name]

    def _distinct(self, name: str) -> DataFrame:
        """A DISTINCT view in parts of so many rows, however many there are: a hash table of rows that hardly
        repeat is as large as the part.  The rows are counted from the footers."""
        one = self._shape(re.sub(r"(?i)^\s*select\s+distinct\b", "select", ADAPTERS[name]), self.base)
        parts = max(self.spark.sparkContext.defaultParallelism, -(-self.base(LARGE_DISTINCT[name]).count() // ROWS_A_PART))
        return one.repartition(parts, *one.columns).distinct()

    def spread(self, name: str) -> DataFrame:
        """An adapter view whose narrow base rows are spread over all cores before
        the view is built, for views that are costly per row (large documents)."""
        width = self.spark.sparkContext.defaultParallelism
        return self._shape(ADAPTERS[name], lambda base: self.base(base).repartition(width))

    def stream(self, name: str) -> DataFrame:
        """An adapter view over file streams; zone-less times become timestamps,
        which watermarks need."""
        df = self._shape(ADAPTERS[name], self.stream_base)
        ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


class FleetTables(Tables):
    """Every adapter view repeated for several servers, to exercise the fleet keys."""

    def __init__(self, spark: SparkSession, root: str, servers: tuple[str, ...]):
        super().__init__(spark, root)
        self.servers = servers

    def _per_server(self, one: DataFrame) -> DataFrame:
        return one.withColumn("server_name", F.explode(F.array(*[F.lit(s) for s in self.servers])))

    def __getattr__(self, name: str) -> DataFrame:
        return self._per_server(super().__getattr__(name))

    def spread(self, name: str) -> DataFrame:
        return self._per_server(super().spread(name))
