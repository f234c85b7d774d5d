"""Machine-file feed: harvester XML, ledger, routing, rollups, idempotent replacement."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.functions import scalar as S

_VALUE = "_VALUE"
#: The parts of a harvester file that the engine reads; names are matched without their namespace prefix.
HARVESTER_SCHEMA = """
MachineUserID string, MachineBaseModel string,
ObjectDefinition array<struct<ObjectName: string, StartTime: string>>,
SpeciesGroupDefinition array<struct<SpeciesGroupKey: string, SpeciesGroupName: string>>,
ProductDefinition array<struct<ProductKey: string, ProductName: string>>,
Stem array<struct<
  StemKey: string, StemNumber: int, SpeciesGroupKey: string, HarvestDate: string,
  StemCoordinates: array<struct<_receiverPosition: string, Latitude: struct<_VALUE: double, _latitudeCategory: string>, Longitude: struct<_VALUE: double, _longitudeCategory: string>>>,
  SingleTreeProcessedStem: struct<
    DBH: double, StemDiameters: struct<DiameterValue: array<struct<_VALUE: double, _diameterPosition: double>>>,
    Log: array<struct<LogKey: string, ProductKey: string, StartPos: double, LogLength: double, LogVolume: array<struct<_VALUE: double, _logVolumeCategory: string>>, LogDiameter: array<struct<_VALUE: double, _logDiameterCategory: string>>>>>>>
"""


def without_namespaces(xml: Column) -> Column:
    """XML without byte-order mark, prefixes and namespace declarations, so that elements are matched by local name."""
    clean = F.regexp_replace(xml, "^﻿", "")
    clean = F.regexp_replace(clean, r"<(/?)[A-Za-z0-9_.-]+:", "<$1")
    return F.regexp_replace(clean, r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")


def _degrees(value: Column, category: Column, negative: str) -> Column:
    sign = F.when(F.lower(category).contains(negative), -1.0).otherwise(1.0)
    return F.nullif(F.abs(value) * sign, F.lit(0.0))


def _preferred(volumes: Column, order: tuple[str, ...] = ("m3sub", "m3sob", "m3 (price)")) -> Column:
    pick = lambda name: F.get(F.filter(volumes, lambda v: F.lower(v["_logVolumeCategory"]) == name), F.lit(0))[_VALUE]
    return F.coalesce(*(pick(n) for n in order), F.get(volumes, F.lit(0))[_VALUE])


def parsed_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``machine`` to files of (file_name, content): the nested record, null where the XML is malformed."""
    body = F.nullif(F.regexp_extract(without_namespaces(F.col(content).cast("string")), r"(?s)<Machine[\s>].*</Machine>", 0), F.lit(""))
    return files.withColumn("machine", F.from_xml(body, HARVESTER_SCHEMA, {"rowTag": "Machine", "mode": "PERMISSIVE"}))


def harvested_stems(files: DataFrame) -> DataFrame:
    """One row for each stem of parsed files: species, product of most volume, diameter, volume, logs and taper as nested columns."""
    m = F.col("machine")
    names = lambda items, key, name: F.map_from_entries(F.filter(F.transform(F.coalesce(m[items], F.array()), lambda d: F.struct(d[key], d[name])), lambda e: e[key].isNotNull()))
    stems = files.select("file_name", m["MachineUserID"].alias("machine_id"), F.get(m["ObjectDefinition"], F.lit(0)).alias("_o"), names("SpeciesGroupDefinition", "SpeciesGroupKey", "SpeciesGroupName").alias("_species"), names("ProductDefinition", "ProductKey", "ProductName").alias("_products"), F.explode(m["Stem"]).alias("s"))
    body = F.col("s.SingleTreeProcessedStem")
    product = lambda log: F.coalesce(F.try_element_at(F.col("_products"), log["ProductKey"]), log["ProductKey"])
    logs = F.transform(F.coalesce(body["Log"], F.array()), lambda log: F.struct(log["LogKey"].alias("log_key"), product(log).alias("assortment"), log["StartPos"].alias("start_cm"), log["LogLength"].alias("length_cm"), F.coalesce(_preferred(log["LogVolume"]), F.lit(0.0)).alias("volume_m3")))
    taper = F.filter(F.transform(F.coalesce(body["StemDiameters"]["DiameterValue"], F.array()), lambda d: F.struct(d["_diameterPosition"].alias("pos_cm"), d[_VALUE].alias("diam_mm"))), lambda d: d["diam_mm"] > 0)
    placed = F.coalesce(F.get(F.filter("s.StemCoordinates", lambda c: F.lower(c["_receiverPosition"]).contains("crane")), F.lit(0)), F.get("s.StemCoordinates", F.lit(0)))
    out = stems.withColumns({"_logs": logs, "taper": taper, "_p": placed})
    # The running end of the logs so far fills missing starts.
    filled = F.aggregate("_logs", F.struct(F.lit(0.0).alias("at"), F.expr("cast(array() as array<struct<log_key:string,assortment:string,start_cm:double,length_cm:double,volume_m3:double>>)").alias("out")), lambda a, log: F.struct((F.coalesce(log["start_cm"], a["at"]) + F.coalesce(log["length_cm"], F.lit(0.0))).alias("at"), F.array_append(a["out"], F.struct(log["log_key"].alias("log_key"), log["assortment"].alias("assortment"), F.coalesce(log["start_cm"], a["at"]).alias("start_cm"), log["length_cm"].alias("length_cm"), log["volume_m3"].alias("volume_m3"))).alias("out")))
    out = out.withColumn("logs", filled["out"])
    volume = F.aggregate("logs", F.lit(0.0), lambda a, log: a + log["volume_m3"])
    kinds = F.array_distinct(F.transform("logs", lambda log: log["assortment"]))
    totals = F.transform(kinds, lambda k: F.struct(F.aggregate(F.filter("logs", lambda log: log["assortment"] == k), F.lit(0.0), lambda a, log: a + log["volume_m3"]).alias("v"), k.alias("k")))
    best = F.aggregate(totals, F.struct(F.lit(-1.0).alias("v"), F.lit(None).cast("string").alias("k")), lambda a, t: F.when(t["v"] > a["v"], t).otherwise(a))
    height = F.coalesce(F.nullif(F.try_element_at(F.col("taper"), F.lit(-1))["pos_cm"], F.lit(0.0)), F.aggregate("logs", F.lit(0.0), lambda a, log: F.greatest(a, log["start_cm"] + F.coalesce(log["length_cm"], F.lit(0.0)))))
    day = F.substring(F.coalesce(F.nullif(F.col("s.HarvestDate"), F.lit("")), F.nullif(F.col("_o.StartTime"), F.lit(""))), 1, 10)
    return out.select(
        "file_name", "machine_id", F.col("_o.ObjectName").alias("object_name"), F.col("s.StemKey").alias("stem_key"), F.col("s.StemNumber").alias("stem_number"),
        F.coalesce(F.try_element_at(F.col("_species"), F.col("s.SpeciesGroupKey")), F.col("s.SpeciesGroupKey")).alias("species"), body["DBH"].alias("dbh_mm"), (height / 10.0).alias("length_dm"), volume.alias("volume_ob_m3"), best["k"].alias("assortment"), "logs", "taper",
        _degrees(F.col("_p.Longitude")[_VALUE], F.col("_p.Longitude")["_longitudeCategory"], "west").alias("longitude"), _degrees(F.col("_p.Latitude")[_VALUE], F.col("_p.Latitude")["_latitudeCategory"], "south").alias("latitude"),
        F.try_to_timestamp(F.concat(day, F.lit(" 12:00:00"))).alias("felled_at"),
    )


def fresh_files(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed files that the ledger doesn't have, each name once."""
    return listed.join(ledger.select("file_name").distinct(), "file_name", "left_anti").dropDuplicates(["file_name"])


def routed(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Route of each object by its key's mapping rule: linked (with the rule's site), ignored, or pending."""
    keyed = objects.withColumn("object_key", S.match_key(F.col("object_name")))
    j = keyed.join(rules.select("object_key", F.col("status").alias("_s"), F.col("site_id").alias("_site")), "object_key", "left")
    route = F.when(F.col("_s") == "ignored", "ignored").when((F.col("_s") == "linked") & F.col("_site").isNotNull(), "linked").otherwise("pending")
    return j.withColumn("route", route).withColumn("site_id", F.when(F.col("route") == "linked", F.col("_site"))).drop("_s", "_site")


def operation_link(operations: DataFrame) -> DataFrame:
    """The operation of each site if it is clear: the only one in progress, else the only one, else null."""
    busy = F.col("status") == "in_progress"
    out = operations.groupBy("site_id").agg(F.count_if(busy).alias("_b"), F.count(F.lit(1)).alias("_n"), F.max(F.when(busy, F.col("operation_id"))).alias("_o"), F.max("operation_id").alias("_a"))
    return out.select("site_id", F.when(F.col("_b") == 1, F.col("_o")).when(F.col("_n") == 1, F.col("_a")).alias("operation_id"))


def rollup(files: DataFrame, by: list[str], time: str, volume: str, machine: str) -> DataFrame:
    """Counters, dates and machines of each object, recomputed from its files; each file name counts once."""
    once = files.dropDuplicates(["file_name"])
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum(volume).alias("volume"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.array_sort(F.collect_set(machine)).alias("machines"))


def merged_rollup(state: DataFrame, change: DataFrame, by: list[str]) -> DataFrame:
    """A rollup's state with the rollup of new files added: equal to the rollup of all files when no file is in both."""
    both = state.unionByName(change)
    return both.groupBy(*by).agg(F.sum("n_files").alias("n_files"), F.sum("volume").alias("volume"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("machines")))).alias("machines"))


def replaced(current: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``current`` with all rows of the keys in ``new`` replaced by it: loading a file again changes nothing."""
    return current.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def filled_blanks(current: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Upsert that fills blanks and never overwrites what is there; new keys are added."""
    names = [c for c in current.columns if c != key]
    f = found.select(key, *(F.col(c).alias(f"_n_{c}") for c in names))
    kept = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_n_{c}")).alias(c)
    return current.join(f, key, "full_outer").select(key, *(kept(c) for c in names))


def ignored_conflicts(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``current`` nor twice in ``new``'s result."""
    return new.join(current.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def orphans_failed(jobs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Jobs that are neither done nor heard of for some minutes become failed."""
    stale = ~F.col("status").isin("ready", "failed") & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def due(connections: DataFrame, now: Column, forced: bool = False) -> DataFrame:
    """Active connections whose time has come, or all active ones, with their next time."""
    ready = F.col("active") & (F.lit(forced) | F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))
    return connections.where(ready).withColumn("next_run_at", now + F.make_interval(hours=F.col("interval_hours")))


def convex_hull_kernel(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the smallest point."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(items: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def convex_hulls(points: DataFrame, by: str, salt: int = 64) -> DataFrame:
    """Hull of each group's (x, y) as array<struct<x, y>>: hulls of salted parts first, then the hull of their corners, so no task holds a whole hot group."""
    import pandas as pd

    kind = points.schema[by].dataType.simpleString()

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull_kernel(list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame({by: pdf[by].iloc[0], "x": [p[0] for p in hull], "y": [p[1] for p in hull], "place": range(len(hull))})

    schema = f"{by} {kind}, x double, y double, place int"
    first = points.where("x is not null and y is not null").select(by, "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(salt)).alias("_salt"))
    part = first.groupBy(by, "_salt").applyInPandas(corners, schema)
    whole = part.groupBy(by).applyInPandas(corners, schema)
    return whole.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("_h")).select(by, F.transform("_h", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("hull"))


def pushed_out(hull: Column, metres: float = 25.0) -> Column:
    """Hull corners moved away from their mean by a distance."""
    n = F.size(hull).cast("double")
    mean = lambda c: F.aggregate(hull, F.lit(0.0), lambda a, p: a + p[c]) / n
    cx, cy = mean("x"), mean("y")
    far = lambda p: F.sqrt((p["x"] - cx) * (p["x"] - cx) + (p["y"] - cy) * (p["y"] - cy))
    move = lambda p, c, m: p[c] + F.coalesce(F.try_divide((p[c] - m) * metres, far(p)), F.lit(0.0))
    return F.transform(hull, lambda p: F.struct(move(p, "x", cx).alias("x"), move(p, "y", cy).alias("y")))


def leaf_sites(sites: DataFrame) -> DataFrame:
    """Sites that are neither deleted nor a grouping of other sites."""
    return sites.where(F.col("deleted_at").isNull() & ~F.coalesce(F.col("kind").isin("portfolio", "estate"), F.lit(False)))


def poll_window(last_good: Column, now: Column, overlap_minutes: int = 60, backfill_days: int = 14) -> Column:
    """Window of a poll as a struct: from an overlap before the last good run, on the first run from some days back, until now."""
    start = F.coalesce(last_good - F.make_interval(mins=F.lit(overlap_minutes)), now - F.make_interval(days=F.lit(backfill_days)))
    return F.struct(start.alias("window_start"), now.alias("window_end"))


def listed_by_type(listers: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of what each type's lister gives, with its type, and the errors of those that fail: one type never sinks the others.

    A lister should reach its source when called, as readers that resolve their paths do.
    """
    parts, errors = [], {}
    for kind, lister in listers.items():
        try:
            parts.append(lister().withColumn("file_type", F.lit(kind)))
        except Exception as error:  # a vendor's listing may fail in any way; the run reports it and goes on
            errors[kind] = str(error)[:300]
    return (reduce(DataFrame.unionByName, parts) if parts else None), errors


def unassigned(files: DataFrame) -> DataFrame:
    """Parsed harvester files without a site: the backlog to match again."""
    return files.where((F.col("file_type") == "hpr") & (F.col("parse_status") == "parsed") & F.col("site_id").isNull())


def rematched(files: DataFrame, found: DataFrame, operations: DataFrame) -> DataFrame:
    """``files`` with the backlog's sites and operations filled from ``found`` (object_id, site_id, matched_by); others stay as they are.

    ``files`` has object_id, file_type, parse_status, site_id, operation_id and matched_by.
    """
    link = found.where("site_id is not null").select("object_id", F.col("site_id").alias("_site"), F.col("matched_by").alias("_how"))
    link = link.join(operation_link(operations).select(F.col("site_id").alias("_site"), F.col("operation_id").alias("_operation")), "_site", "left")
    open_ = F.coalesce((F.col("file_type") == "hpr") & (F.col("parse_status") == "parsed"), F.lit(False)) & F.col("site_id").isNull() & F.col("_site").isNotNull()
    new = {"site_id": "_site", "operation_id": "_operation", "matched_by": "_how"}
    out = files.join(link, "object_id", "left")
    return out.select(*(F.when(open_, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns))


def sizes_filled(jobs: DataFrame, listing: DataFrame, paths: list[str], key: str = "job_id") -> DataFrame:
    """``jobs`` with null size_bytes filled by the sum over the objects that their paths name; null where none is listed.

    ``listing`` has one row for each object: object_key and bytes.
    """
    open_ = jobs.where("size_bytes is null").select(key, F.explode(F.array(*(S.path_key(F.col(p)) for p in paths))).alias("object_key"))
    found = open_.where("object_key <> ''").join(listing.select("object_key", "bytes"), "object_key").groupBy(key).agg(F.sum("bytes").alias("_found"))
    return jobs.join(found, key, "left").withColumn("size_bytes", F.coalesce("size_bytes", "_found")).select(*jobs.columns)
