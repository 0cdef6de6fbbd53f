"""Sinks: upsert by key, update from a table, range delete, versioned replacement, and writers."""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Fail if a key is null or occurs twice."""
    bad = df.groupBy(*keys).count().where(" or ".join(["count > 1", *[f"`{k}` is null" for k in keys]]))
    if row := bad.first():
        raise ValueError(f"null or repeated key {row.asDict()}")


def merge(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in by key: columns that new has take its values, nulls included; other columns keep theirs.

    Columns that only new has are added. With no columns besides the keys, only missing rows are added.
    """
    if old is None:
        return new
    n = new.withColumnsRenamed({c: f"_new_{c}" for c in new.columns if c not in keys}).withColumn("_there", F.lit(True))
    joined = old.join(n, keys, "full")
    columns = [*old.columns, *[c for c in new.columns if c not in old.columns]]

    def value(c: str):
        if c in keys:
            return F.col(c)
        if c not in new.columns:
            return F.col(c)
        return (F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in old.columns else F.col(f"_new_{c}")).alias(c)

    return joined.select(*map(value, columns))


def update_from(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """df with the values of matching rows, nulls included; no rows are added."""
    v = values.withColumnsRenamed({c: f"_new_{c}" for c in values.columns if c not in keys}).withColumn("_there", F.lit(True))
    joined = df.join(v, keys, "left")
    changed = [c for c in values.columns if c not in keys]
    return joined.select(*[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])


def delete_before(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(date) < F.lit(cutoff).cast("date"), F.lit(False)))


def version_of(folder: str) -> str:
    """The folder that one write has made, of a partition's folder in it or of itself."""
    return "/".join(folder.split("/")[:2])


class VersionedTable:
    """A Parquet table as a list of folders that a manifest names; the newest manifest counts.

    Data folders and manifests are only ever added under new names, and a manifest is put in place, whole, under its number by a
    step that fails if another writer has taken the number. So a reader sees a whole version, a writer that stops at any step
    leaves the last one, and of writers that meet one goes first and the others follow: an upsert whose values of the partition
    nobody touched is published on top of the other's, else it is merged anew. With `partition`, an expression, each of its values has folders of its
    own, and an upsert rewrites the values that the new rows have; a row must keep its value. The newest KEEP versions stay,
    for readers that have begun. The file system must rename without replacing, as HDFS does; a local one is linked to.
    """

    KEEP = 3

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        return hadoop, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        hadoop, fs = self._fs()
        at = hadoop.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifests") if n.endswith(".json")]

    def _parts(self, manifest: str) -> dict[str, str]:
        """Partition value to folder."""
        hadoop, fs = self._fs()
        stream = fs.open(hadoop.Path(f"{self.path}/manifests/{manifest}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict[str, str]]:
        """Number and parts of the newest version; 0 and none of an empty table."""
        while names := self._manifests():
            try:
                return int(names[-1][:12]), self._parts(names[-1])
            except Py4JJavaError:
                if names[-1] in self._manifests():  # else other writers went so far ahead that it is gone
                    raise
        return 0, {}

    def read(self) -> DataFrame | None:
        _, parts = self._newest()
        return self._of(parts) if parts else None

    def _of(self, parts: dict[str, str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{folder}" for folder in parts.values()])

    def _write(self, df: DataFrame) -> dict[str, str]:
        version = f"data/{uuid.uuid4().hex}"
        if not self.partition:
            df.write.parquet(f"{self.path}/{version}")
            return {"": version}
        df.withColumn("_part", F.coalesce(F.expr(self.partition).cast("string"), F.lit("none"))).write.partitionBy("_part").parquet(f"{self.path}/{version}")
        return {name: f"{version}/{name}" for name in self._names(version) if name.startswith("_part=")}

    def _publish(self, number: int, parts: dict[str, str]) -> bool:
        """Put the version in place, unless another writer has; says whether it did."""
        hadoop, fs = self._fs()
        written, final = hadoop.Path(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp"), hadoop.Path(f"{self.path}/manifests/{number:012d}.json")
        out = fs.create(written, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                try:
                    os.link(written.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    return False
            elif not fs.rename(written, final):
                if fs.exists(final):
                    return False
                raise OSError(f"{final} can't be put in place")
        finally:
            fs.delete(written, False)
        self._clean()
        return True

    def _discard(self, parts: dict[str, str]) -> None:
        hadoop, fs = self._fs()
        for version in {version_of(folder) for folder in parts.values()}:
            fs.delete(hadoop.Path(f"{self.path}/{version}"), True)

    def _clean(self) -> None:
        """Drop manifests beyond the newest KEEP, and folders that only these name."""
        hadoop, fs = self._fs()
        names = self._manifests()
        old, kept = names[: -self.KEEP], names[-self.KEEP :]
        try:
            used = {folder for n in kept for folder in self._parts(n).values()} if old else set()
            versions = {version_of(folder) for folder in used}
            for n in old:
                for folder in set(self._parts(n).values()) - used:
                    whole = version_of(folder)
                    fs.delete(hadoop.Path(f"{self.path}/{folder if whole in versions else whole}"), True)
                fs.delete(hadoop.Path(f"{self.path}/manifests/{n}"), False)
        except Py4JJavaError:
            if set(names) <= set(self._manifests()):  # else another writer cleans
                raise

    def vacuum(self, older_than_s: float = 86_400.0) -> list[str]:
        """Delete what writers that stopped have left: folders and unfinished manifests that no manifest names. Younger ones stay, as their writers may be at work."""
        hadoop, fs = self._fs()
        used = {version_of(folder) for n in self._manifests() for folder in self._parts(n).values()}
        left = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in used] + [f"manifests/{n}" for n in self._names("manifests") if n.endswith(".tmp")]
        old = [n for n in left if fs.getFileStatus(hadoop.Path(f"{self.path}/{n}")).getModificationTime() / 1000 <= time.time() - older_than_s]
        for n in old:
            fs.delete(hadoop.Path(f"{self.path}/{n}"), True)
        return old

    def replace(self, df: DataFrame) -> None:
        """The table is df; of writers that meet the last one's rows stay."""
        written = self._write(df)
        while not self._publish(self._newest()[0] + 1, written):
            pass

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        """Merge new into the table by key; without a partition the whole table is written anew, else the touched values."""
        assert_unique(new, keys)
        if self.partition:
            value = F.concat(F.lit("_part="), F.coalesce(F.expr(self.partition).cast("string"), F.lit("none")))
            touched = {r[0] for r in new.select(value).distinct().collect()}
        else:
            touched = {""}
        base, written = None, {}
        while True:
            number, parts = self._newest()
            own = {p: parts[p] for p in touched & parts.keys()}
            if own != base:  # what is merged now isn't what was merged before
                self._discard(written)
                try:
                    written, base = self._write(merge(self._of(own) if own else None, new, keys)), own
                except Exception:
                    kept = [int(n[:12]) for n in self._manifests()]
                    if not kept or number >= kept[0]:
                        raise
                    written, base = {}, None  # other writers went so far ahead that this version may be gone
                    continue
            if self._publish(number + 1, parts | written):
                return


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; NaN, which JSON lacks, is left out like null."""
    from tessella.functions.repair import no_nan

    return no_nan(df).select(F.to_json(F.struct("*")).alias("json"))


def to_geojson_rows(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One GeoJSON point feature a row."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("json"))


def archive(df: DataFrame, folder: str, label: str, formats: tuple[str, ...] = ("parquet",)) -> str:
    """Copies of a result in a labelled folder, one a format."""
    for fmt in formats:
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{folder.rstrip('/')}/{label}/{fmt}")
    return f"{folder.rstrip('/')}/{label}"
