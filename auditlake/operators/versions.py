"""Versions of a rule set as a log of changes (SYN-1, SYN-2, SYN-5): a sync, an import or a rollback writes what it changes and nothing else, and any version is the fold of the log by key up to its number.

The log is a table in folders by version, so a version's fold reads no later ones. Old versions are folded together: a base holds all rows of one version, versions before it are gone, and those after it
stay as changes. A version counts once its folder is complete (Spark's _SUCCESS), a base too, so a broken write is not seen and is written over. A set is written by one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How many versions can be gone back to.
KEPT = 10
ADDED, CHANGED, REMOVED, DISABLED = "added", "changed", "removed", "disabled"


def changes(old: DataFrame, new: DataFrame, key: str, enabled: str | None = None) -> DataFrame:
    """(status, and the columns of old): rows that were added or changed (as they are now) or removed (as they were). A changed row that is not enabled any more is `disabled`. Of rows that repeat a key the
    largest counts; rows without a key are left out."""
    names = old.columns
    one = lambda df, a: df.select(names).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*names)).alias(a))
    both = one(old, "a").join(one(new, "b"), "_key", "full_outer")
    off = F.lit(False) if enabled is None else F.col(f"a.{enabled}") & ~F.col(f"b.{enabled}")
    status = F.when(F.col("a").isNull(), ADDED).when(F.col("b").isNull(), REMOVED).when(F.col("a") == F.col("b"), None).when(F.coalesce(off, F.lit(False)), DISABLED).otherwise(CHANGED)
    return both.select(status.alias("status"), F.coalesce("b", "a").alias("r")).where("status IS NOT NULL").select("status", "r.*")


class Versions:
    """The versions of rules of one schema, under a folder that all executors share. Version 0 has no rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: str = "rule_id", enabled: str | None = "enabled"):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = spark.createDataFrame([], schema).schema
        self.enabled = enabled if enabled in self.schema.names else None

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str) -> list[int]:
        """Complete folders of a kind: `version` or `base`."""
        fs, top = self._fs(self.folder)
        found = [x.getPath() for x in fs.listStatus(top)] if fs.exists(top) else []
        names = [p.getName() for p in found if p.getName().startswith(f"{kind}=") and fs.exists(self._fs(f"{p.toString()}/_SUCCESS")[1])]
        return sorted(int(n.split("=")[1]) for n in names)

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        own = StructType().add("status", "string")
        for f in self.schema:
            own.add(f)
        if not numbers:
            return self.spark.createDataFrame([], own).withColumn("version", F.lit(0))
        number = F.regexp_extract(F.input_file_name(), rf"{kind}=(\d+)", 1).cast("int")
        return self.spark.read.schema(own).parquet(*(f"{self.folder}/{kind}={n}" for n in numbers)).withColumn("version", number)

    @property
    def base(self) -> int:
        return max(self._numbers("base"), default=0)

    @property
    def latest(self) -> int:
        return max(self._numbers("version"), default=self.base)

    def log(self) -> DataFrame:
        """(status, row, version) of the versions after the base."""
        first = self.base
        return self._read("version", [n for n in self._numbers("version") if n > first])

    def at(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest."""
        last, first = self.latest, self.base
        version = last if version is None else version
        if version < first or version > last:
            raise ValueError(f"version {version} is not kept: {first} to {last} are")
        rows = self._read("base", [first] if first else []).unionByName(self._read("version", [n for n in self._numbers("version") if first < n <= version]))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct("status", *(c for c in self.schema.names if c != self.key)), "version").alias("r"))
        return newest.where(F.col("r.status") != REMOVED).select(*(F.col(c) if c == self.key else F.col(f"r.{c}").alias(c) for c in self.schema.names))

    def commit(self, rows: DataFrame) -> int:
        """A new version with these rows; only what differs from the latest one is written. Its number."""
        n = self.latest + 1
        changes(self.at(), rows.select(self.schema.names), self.key, self.enabled).write.mode("overwrite").parquet(f"{self.folder}/version={n}")
        return n

    def rollback(self, version: int) -> int:
        """A new version with the rows of an old one: the inverse of what came after it is appended, nothing is taken back."""
        return self.commit(self.at(version))

    def history(self) -> DataFrame:
        """(version, added, changed, removed, disabled) of the versions after the base."""
        count = lambda s: F.count_if(F.col("status") == s).alias(s)
        numbers = [n for n in self._numbers("version") if n > self.base]
        every = self.spark.createDataFrame([(n,) for n in numbers], "version int")
        return every.join(self.log().groupBy("version").agg(*map(count, (ADDED, CHANGED, REMOVED, DISABLED))), "version", "left").na.fill(0)

    def compact(self, keep: int = KEPT) -> None:
        """Folds all but the last versions together; `keep` of them can still be gone back to."""
        new = self.latest - keep + 1
        if new <= self.base:
            return
        old = [n for n in self._numbers("version") if n <= new]
        self.at(new).select(F.lit(ADDED).alias("status"), "*").write.mode("overwrite").parquet(f"{self.folder}/base={new}")
        for path in [f"version={n}" for n in old] + [f"base={n}" for n in self._numbers("base") if n < new]:
            fs, p = self._fs(f"{self.folder}/{path}")
            fs.delete(p, True)
