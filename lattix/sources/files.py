"""Readers and writers: tables by format, GAL and GWT weights files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc", "geojson", "jdbc")


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options) -> DataFrame:
    """schema: the types of all columns, in place of inferred ones.  parquet, csv (header, inferred types), json, orc, jdbc, or geojson: one row a feature with its properties and rings / x, y."""
    if kind == "geojson":
        return read_geojson(spark, path)
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false" if schema else "true")
    if schema:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", **options) -> None:
    """parquet, csv (with header), json or orc."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {kind}")
    base = {"header": "true"} if kind == "csv" else {}
    df.write.format(kind).mode(mode).options(**base, **options).save(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("multiLine", "true").json(path).schema["features"].dataType.elementType
    own = found["properties"].dataType.simpleString() if "properties" in found.fieldNames() else "struct<>"
    schema = f"features array<struct<properties:{own},geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.option("multiLine", "true").schema(schema).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("__c"))
    ring = "array<array<array<double>>>"
    pt = F.from_json("__c", "array<double>")
    lines = lambda c: F.transform(c, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    kind, one, two, three = F.col("geom_type"), F.from_json("__c", "array<array<double>>"), F.from_json("__c", ring), F.from_json("__c", f"array<{ring}>")
    shape = F.when(kind.isin("Polygon", "MultiLineString"), lines(two)).when(kind == "MultiPolygon", lines(F.flatten(three))).when(kind.isin("LineString", "MultiPoint"), lines(F.array(one)))
    return f.withColumn("x", F.when(F.col("geom_type") == "Point", pt[0])).withColumn("y", F.when(F.col("geom_type") == "Point", pt[1])).withColumn("rings", shape).drop("__c")


def drop_trailing_empty(df: DataFrame, row: str) -> DataFrame:
    """Drops the rows after the last one that holds any value besides its number."""
    cols = [c for c in df.columns if c != row]
    filled = F.coalesce(*[F.when(F.col(c).isNotNull(), F.col(row)) for c in cols])
    last = df.agg(F.max(filled)).first()[0]
    return df.where(F.col(row) <= F.lit(last)) if last is not None else df.where("false")


def write_gal(w: DataFrame, obs: DataFrame, key: str, path: str, layer: str = "layer") -> None:
    """Header `0 n layer key`, then two lines an observation; one text file in key order."""
    near = w.where("src <> dst").groupBy(F.col("src").alias(key)).agg(F.sort_array(F.collect_list("dst")).alias("n"))
    rows = obs.select(key).join(near, key, "left").select(key, F.coalesce("n", F.array().cast(near.schema["n"].dataType)).alias("n"))
    lines = rows.select(F.col(key).alias("k"), F.concat_ws("\n", F.concat_ws(" ", key, F.size("n")), F.concat_ws(" ", F.col("n").cast("array<string>"))).alias("value"))
    head = obs.agg(F.concat_ws(" ", F.lit("0"), F.count("*"), F.lit(layer), F.lit(key)).alias("value")).select(F.lit(None).cast(obs.schema[key].dataType).alias("k"), "value")
    head.unionByName(lines).orderBy(F.col("k").asc_nulls_first()).coalesce(1).select("value").write.text(path)


def read_gal(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight), ids as text; blank or missing neighbour lines are isolates."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    def parse(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for text in pdf["value"]:
                lines = text.splitlines()
                rows, i = [], 1
                while i < len(lines):
                    head = lines[i].split()
                    i += 1
                    if not head:
                        continue
                    if len(head) > 1 and int(head[1]) > 0:
                        rows += [(head[0], v, 1.0) for v in lines[i].split()]
                        i += 1
                    elif i < len(lines) and not lines[i].strip():
                        i += 1
                yield pd.DataFrame(rows, columns=["src", "dst", "weight"])

    schema = StructType().add("src", StringType()).add("dst", StringType()).add("weight", DoubleType())
    return spark.read.text(path, wholetext=True).mapInPandas(parse, schema)


def write_gwt(w: DataFrame, n: int, key: str, path: str, layer: str = "layer") -> None:
    lines = w.select(F.concat_ws(" ", "src", "dst", "weight").alias("value"), F.struct("src", "dst").alias("k"))
    head = w.sparkSession.range(1).select(F.lit(f"0 {n} {layer} {key}").alias("value"), F.lit(None).cast(lines.schema["k"].dataType).alias("k"))
    head.unionByName(lines).orderBy(F.col("k").asc_nulls_first()).coalesce(1).select("value").write.text(path)


def read_gwt(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") == 3)
    return rows.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"), F.col("p")[2].cast("double").alias("weight"))
