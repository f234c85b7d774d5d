"""Readers and writers of the formats that stages exchange. All bytes come through Spark's readers, so any store will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq.functions import scalar as S
from canopyq.sources.las import las_bytes, las_headers, read_las, write_las  # noqa: F401

def is_octree_file(files: DataFrame) -> DataFrame:
    """Adds ``is_copc`` to (path, content): by name, or by magic bytes and marker near the start of the file."""
    named = F.lower("path").rlike(r"\.copc\.la[sz]$")
    head = F.substring("content", 1, 8192)
    marked = (F.substring("content", 1, 4) == F.lit(b"LASF")) & F.hex(head).contains("636F7063")
    return files.withColumn("is_copc", named | F.coalesce(marked, F.lit(False)))


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ESRI ASCII grids: (file, row, col, x, y, value), row 0 at the south, nodata left out; malformed headers raise no row."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.asc").load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return ascii_cells(raw)


def ascii_cells(raw: DataFrame) -> DataFrame:
    """The same from (file, value) rows that hold whole grids as text."""
    key = lambda name: F.regexp_extract("value", rf"(?im)^\s*{name}\s+(\S+)", 1).try_cast("double")
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line).rlike(r"^[-0-9.]"))
    head = raw.select("file", *(key(k).alias(k) for k in ("nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")), F.posexplode(lines).alias("at", "line")).where("cellsize > 0")
    cells = head.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "text"))
    row = (F.col("nrows") - 1 - F.col("at")).cast("int")
    value = F.col("text").try_cast("double")
    out = cells.withColumn("row", row).withColumn("v", F.when(~value.eqNullSafe(F.coalesce("nodata_value", F.lit(-9999.0))), value)).where("v is not null and row >= 0")
    return out.select("file", "row", "col", (F.col("xllcorner") + (F.col("col") + 0.5) * F.col("cellsize")).alias("x"), (F.col("yllcorner") + (F.col("row") + 0.5) * F.col("cellsize")).alias("y"), F.col("v").alias("value"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Texts of grid files under a path, loose or inside zips: (file, value). Bad zips are skipped."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name.lower().endswith(".zip"):
                    try:
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            inner = [n for n in z.namelist() if n.lower().endswith(".asc")]
                            names += [f"{name}!{n}" for n in inner]
                            texts += [z.read(n).decode("latin-1") for n in inner]
                    except zipfile.BadZipFile:
                        continue
                elif name.lower().endswith(".asc"):
                    names.append(name)
                    texts.append(data.decode("latin-1"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(unpack, "file string, value string")


def tiles_for(files: DataFrame, refs: DataFrame, path: str = "path") -> DataFrame:
    """Files whose name begins with one of the wanted tile references: a semi join on the prefix."""
    key = F.upper(F.substring(S.base_name(F.col(path)), 1, 4))
    return files.withColumn("tile_ref", key).join(refs.select(F.upper("tile_ref").alias("tile_ref")).distinct(), "tile_ref", "left_semi")


def read_loose_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """CSV by name with the given columns as doubles, blanks and words for missing as null; rows where a number can't be read are dropped.

    A byte-order mark is ignored; a missing file is an empty table with these columns.
    """
    try:
        raw = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ", ".join(f"{n} double" for n in numbers))
    named = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    return named.withColumns({n: S.number_or_null(F.col(n)) for n in numbers}).where(" and ".join(f"{n} is not null" for n in numbers))


def geojson_compartments(raw: DataFrame) -> DataFrame:
    """Compartments of FeatureCollections given as (file, value) texts: (poly_id, ordinal, ref, species, area_hectares, rings); features without geometry are skipped."""
    shape = "struct<type: string, coordinates: string>"
    schema = f"struct<features: array<struct<id: string, properties: map<string, string>, geometry: {shape}>>>"
    each = raw.select("file", F.posexplode(F.from_json("value", schema)["features"]).alias("ordinal", "f")).where("f.geometry.coordinates is not null")
    many = F.col("f.geometry.type") == "MultiPolygon"
    parts = F.when(many, F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))).otherwise(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    prop = lambda *names: S.first_filled(*(F.try_element_at(F.col("f.properties"), F.lit(n)) for n in names))
    return each.select(
        F.coalesce("f.id", prop("id", "ref"), F.col("ordinal").cast("string")).alias("poly_id"), "ordinal", prop("ref", "reference", "name").alias("ref"), prop("species", "main_species", "Species").alias("species"),
        prop("area_hectares", "area_ha").try_cast("double").alias("area_hectares"), parts.alias("rings"),
    )


def geojson_features(df: DataFrame, geometry: str, properties: list[str], kind: str) -> DataFrame:
    """One GeoJSON feature a row, as ``value``; coordinates rounded to 7 decimals by the caller's column."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), F.col(geometry).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes so that the partitions present in ``df`` replace those on disk and others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def clustered_points(points: DataFrame, path: str, tile: float) -> None:
    """Points by tile, sorted inside, so that readers with bounds skip tiles and row groups."""
    tiled = points.withColumns({"tile_i": S.cell_of(F.col("x"), tile), "tile_j": S.cell_of(F.col("y"), tile)})
    tiled.repartitionByRange("tile_i", "tile_j").sortWithinPartitions("tile_i", "tile_j", "x", "y").write.mode("overwrite").partitionBy("tile_i", "tile_j").parquet(path)


def points_in_bounds(spark: SparkSession, path: str, tile: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Clustered points within half-open bounds; the tile predicate prunes partitions, the rest is pushed to the scan."""
    i0, i1, j0, j1 = (int(v // tile) for v in (x0, x1, y0, y1))
    found = spark.read.parquet(path).where(F.col("tile_i").between(i0, i1) & F.col("tile_j").between(j0, j1))
    return found.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def thinned(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A random share of points that leaves about ``most``; fewer stay as they are."""
    n = points.count()
    return points if n <= most else points.sample(False, most / n, seed)
