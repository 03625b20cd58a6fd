"""A warehouse of Parquet tables in one directory, written in buckets.

Rows lie in buckets by a hash of the filing they belong to, or of their key. A write stages new files for the buckets it
touches and leaves all others alone; then one manifest, which names every table's folder of every bucket, takes effect by
a rename, for all tables of the write at once. Readers see the state before or after, never one between, and of two
writers that began from the same state the second is refused. Scans, joins and the upsert are ordinary DataFrames.

Section and chunk ids begin with their accession and a colon, so that a filing's rows share a bucket in all three tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import schemas

BUCKETS = 32
#: Columns whose text before a colon names the bucket, where it isn't the whole key.
_HOME = {"sections": "section_id", "chunks": "chunk_id", "embeddings": "chunk_id"}


class Conflict(RuntimeError):
    """Another write took effect since this one began."""


class Warehouse:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, buckets: int = BUCKETS):
        self.spark, self.path, self.read_only, self._buckets = spark, path.rstrip("/"), read_only, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False, buckets: int = BUCKETS) -> Warehouse:
        """Opens a warehouse, and makes one where there is none, also before a read-only use. The number of buckets is fixed then."""
        own = cls(spark, path, buckets=buckets)
        if own.manifest()["version"] < 0:
            own._commit(-1, {})
        own.read_only = read_only
        return own

    def manifest(self) -> dict:
        """{version, buckets, tables: {name: {bucket: folder}}} of the current state."""
        folder = self._path(f"{self.path}/_manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
        if not versions:
            return {"version": -1, "buckets": self._buckets, "tables": {}}
        stream = self._fs.open(self._path(f"{self.path}/_manifest/{max(versions):012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: int, staged: dict[str, dict[int, str | None]]) -> None:
        """Puts staged buckets (None: now empty) in place of the ones of state `base`."""
        if self.read_only:
            raise PermissionError("the warehouse is open for reading only")
        now = self.manifest()
        tables = {n: dict(t) for n, t in now["tables"].items()}
        for name, buckets in staged.items():
            own = tables.setdefault(name, {})
            for b, folder in buckets.items():
                own.pop(str(b), None)
                if folder is not None:
                    own[str(b)] = folder
        beside = self._path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps({"version": base + 1, "buckets": now["buckets"], "tables": tables}).encode()))
        out.close()
        target = self._path(f"{self.path}/_manifest/{base + 1:012d}.json")
        if now["version"] != base or self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise Conflict(f"the warehouse is no longer in state {base}")

    def _bucket(self, name: str, column: str | None = None) -> Column:
        """The bucket of a table's rows; column: of rows that only have the filing's key."""
        home = column or _HOME.get(name)
        parts = [F.substring_index(home, ":", 1)] if home else [F.col(k) for k in schemas.KEYS[name]]
        return F.pmod(F.xxhash64(*parts), F.lit(self.manifest()["buckets"])).cast("int")

    def _rows(self, name: str, state: dict, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{name}/{f}" for b, f in sorted(state["tables"].get(name, {}).items()) if only is None or int(b) in only]
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], schemas.TABLES[name])

    def _stage(self, name: str, rows: DataFrame, touched: set[int]) -> dict[int, str | None]:
        """Writes the rows of the touched buckets beside the old ones."""
        if self.read_only:
            raise PermissionError("the warehouse is open for reading only")
        folder = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket(name)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}/{folder}")
        written = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{name}/{folder}"))}
        return {b: f"{folder}/_bucket={b}" if f"_bucket={b}" in written else None for b in touched}

    def _touched(self, *buckets: DataFrame) -> set[int]:
        """Numbers of buckets, of one column; there are at most as many as buckets."""
        out: set[int] = set()
        for b in buckets:
            out |= {r[0] for r in b.distinct().collect()}
        return out

    def table(self, name: str) -> DataFrame:
        """The table's current state, with its declared schema."""
        if name not in schemas.TABLES:
            raise KeyError(f"no table {name!r}")
        return self._rows(name, self.manifest())

    def register(self, names: tuple[str, ...] = tuple(schemas.TABLES)) -> None:
        """Temporary views of the tables."""
        for n in names:
            self.table(n).createOrReplaceTempView(n)

    def query(self, sql: str, **args) -> DataFrame:
        self.register()
        return self.spark.sql(sql, args=args or None)

    def _upserting(self, name: str, rows: DataFrame, state: dict) -> dict[int, str | None]:
        new = checked(name, rows)
        touched = self._touched(new.select(self._bucket(name)))
        return self._stage(name, upserted(self._rows(name, state, touched), new, schemas.KEYS[name]), touched) if touched else {}

    def _replacing(self, name: str, rows: DataFrame, parents: DataFrame, key: str, state: dict) -> dict[int, str | None]:
        new, parents = checked(name, rows), parents.select(key).distinct()
        touched = self._touched(new.select(self._bucket(name)), parents.select(self._bucket(name, key)))
        return self._stage(name, replaced(self._rows(name, state, touched), new, parents, key), touched) if touched else {}

    def upsert(self, name: str, rows: DataFrame) -> None:
        """rows is evaluated more than once: write or persist it first if that is dear."""
        state = self.manifest()
        self._commit(state["version"], {name: self._upserting(name, rows, state)})

    def replace_children(self, name: str, rows: DataFrame, parents: DataFrame, key: str = "accession") -> None:
        """All rows of the parents (also of those that have none now) give way to the given ones. Rows belong to the parents."""
        state = self.manifest()
        self._commit(state["version"], {name: self._replacing(name, rows, parents, key, state)})

    def ingest_filing_rows(self, filings: DataFrame, sections: DataFrame, chunks: DataFrame, reviews: DataFrame | None = None) -> None:
        """Filings are upserted; their sections and chunks are replaced; all takes effect at once. Doing it again changes nothing."""
        state = self.manifest()
        staged = {"filings": self._upserting("filings", filings, state)}
        staged |= {name: self._replacing(name, rows, filings, "accession", state) for name, rows in (("sections", sections), ("chunks", chunks))}
        if reviews is not None:
            staged["review_queue"] = self._upserting("review_queue", reviews, state)
        self._commit(state["version"], staged)

    def vacuum(self, name: str) -> int:
        """Deletes a table's files that the current state doesn't name, and older manifests; the number of deleted buckets."""
        state, n = self.manifest(), 0
        keep = set(state["tables"].get(name, {}).values())
        root = self._path(f"{self.path}/{name}")
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            held = False
            for b in self._fs.listStatus(s.getPath()):
                at = f"{s.getPath().getName()}/{b.getPath().getName()}"
                if at in keep:
                    held = True
                elif b.isDirectory():
                    self._fs.delete(b.getPath(), True)
                    n += 1
            if not held:
                self._fs.delete(s.getPath(), True)
        for f in self._fs.listStatus(self._path(f"{self.path}/_manifest")):
            if f.getPath().getName() != f"{state['version']:012d}.json":
                self._fs.delete(f.getPath(), False)
        return n


def checked(name: str, rows: DataFrame) -> DataFrame:
    """rows with the table's column types; a null in a key or an unknown column is an error when they are written."""
    schema = schemas.TABLES[name]
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    lacking = [k for k in schemas.KEYS[name] if k not in rows.columns]
    if lacking:
        raise ValueError(f"{name} needs {lacking}")
    out = []
    for f in schema:
        if f.name in rows.columns:
            c = F.col(f.name).cast(f.dataType)
            if not f.nullable:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"{name}.{f.name} is null")).cast(f.dataType)).otherwise(c)
            out.append(c.alias(f.name))
    return rows.select(out)


def upserted(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """old with the rows of new put in by key. Columns that new lacks keep their old value; of several new rows with one key
    the greatest one counts (rows of one write have no order). old has one row per key, none with a null in it."""
    given = [c for c in new.columns if c not in key]
    last = Window.partitionBy(*key).orderBy(F.to_json(F.struct(*given)).desc() if given else F.lit(1))
    new = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    if set(old.columns) == set(new.columns):
        return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new)
    both = old.withColumn("_old", F.lit(True)).join(new.select(*key, *[F.col(c).alias(f"_{c}") for c in given], F.lit(True).alias("_new")), list(key), "full_outer")
    return both.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return old.join(parents.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def newest(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key by a column."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
