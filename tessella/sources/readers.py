"""Readers: Parquet, CSV with or without a header, delimited archives, JSON, GeoJSON, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.repair import no_nan
from tessella.sources import archives


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the given columns reach the scan; NaN becomes null."""
    df = spark.read.parquet(path)
    return no_nan(df.select(*columns) if columns else df)


def parquet_summary(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, n_rows): from the footers, as a count reads no column."""
    df = spark.read.parquet(path)
    n = df.count()
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), n) for f in df.schema], "column string, type string, n_rows long")


def read_csv_range(spark: SparkSession, path: str, schema: T.StructType | str, date: str, start: str, end: str) -> DataFrame:
    """Rows of a CSV with a header whose date is within start and end, both included."""
    return spark.read.schema(schema).option("header", True).csv(path).where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_csv_sniffed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV that may lack its header: the first line tells."""
    first = spark.read.text(path).limit(1).first()
    names = [x.strip().strip('"').lower() for x in (first[0] if first else "").split(",")]
    has_header = {f.name.lower() for f in schema} & set(names)
    return spark.read.schema(schema).option("header", bool(has_header)).csv(path)


def read_zipped_table(spark: SparkSession, path: str, columns: dict[int, str], sep: str = "\t") -> DataFrame:
    """Headerless delimited members of zip archives, as text; rows too short for the columns are dropped. See `archives` for types, bad lines and streams."""
    archives.register(spark)
    names = ", ".join(f"`{n}` string" for n in columns.values())
    return spark.read.format("zipped_tables").schema(names).options(sep=sep, columns=",".join(map(str, columns))).load(path)


def read_landed_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Pages of an API that were landed as JSON."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """lon, lat and properties of a collection's point features."""
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    feature = T.StructType([T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])), T.StructField("properties", props)])
    raw = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    return f.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), *[F.col(f"f.properties.{p}").alias(p) for p in properties])


def read_geojson_polygons(spark: SparkSession, path: str, properties: list[str], lines: bool = False) -> DataFrame:
    """feature, part, rings and properties of polygon features; one of several parts gives a row a part.

    feature is a hash of the whole geometry, so it names a feature wherever it is read. lines: a feature a line, which Spark
    splits over tasks; else collections, of which one file is read by one task. Other geometries are left out.
    """
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("geometry", shape), T.StructField("properties", props)])
    if lines:
        features = spark.read.schema(feature).json(path).select(F.struct("geometry", "properties").alias("f"))
    else:
        features = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single = F.array(F.from_json(text, "array<array<array<double>>>"))
    parts = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    named = [F.col(f"f.properties.{p}").alias(p) for p in properties]
    return features.select(F.sha2(F.to_json(parts), 256).alias("feature"), *named, F.posexplode(parts).alias("part", "rings")).select("feature", "part", "rings", *properties)


def files_of_manifest(manifest: DataFrame, line: str, pattern: str, start: str, end: str) -> DataFrame:
    """(file, stamp) of the manifest's lines whose name holds a time (yyyyMMddHHmmss, in the pattern's group) within start and end."""
    stamp = F.try_to_timestamp(F.regexp_extract(line, pattern, 1), F.lit("yyyyMMddHHmmss"))
    return manifest.select(F.col(line).alias("file"), stamp.alias("stamp")).where(F.col("stamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def load_settings(path: str) -> dict:
    """A settings file in YAML where the parser is there, else in JSON."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
