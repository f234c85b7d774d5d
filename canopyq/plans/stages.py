"""The stages as a dependency graph of functions over DataFrames, and their runner."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq.operators import grid, segmentation, segments, stats, stems, tariff, terrain
from canopyq.plans.storage import stored

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named table function: what it needs, its defaults, and the tables it makes by role."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[Tables, Mapping[str, Any]], Tables]
    parameters: Mapping[str, Any] = field(default_factory=dict)


def _normalise(t: Tables, p: Mapping[str, Any]) -> Tables:
    marked = terrain.ground_points(t["points"], p["size"])
    ground = grid.ground_median(marked.where("is_ground"), p["size"]).withColumn("ground_id", F.xxhash64("row", "col"))
    above = terrain.height_above(t["points"], ground)
    return {"heights": above.withColumn("z", F.col("height")).drop("height", "distance"), "ground": ground}


def _dtm(t: Tables, p: Mapping[str, Any]) -> Tables:
    surface = t["ground"].select("row", "col", F.col("ground_z").alias("value"))
    return {"dtm": terrain.filled_surface(surface, p["half"])}


def _treetops(t: Tables, p: Mapping[str, Any]) -> Tables:
    peaks = grid.local_maxima(t["chm"], p["half"], p["least"])
    tops = peaks.select(F.xxhash64("row", "col").alias("tree_id"), "row", "col", ((F.col("col") + 0.5) * p["size"]).alias("x"), ((F.col("row") + 0.5) * p["size"]).alias("y"), F.col("value").cast("double").alias("height_m"))
    left = segments.suppressed(tops, p["apart"]).drop("tree_id").withColumn("_block", F.floor(F.col("row") / 1024))
    return {"treetops": stats.numbered(left, ["_block"], ["row", "col"], "tree_id").drop("_block")}


def _segmentation(t: Tables, p: Mapping[str, Any]) -> Tables:
    crowns = segments.watershed(t["chm"].withColumn("value", F.col("value").cast("double")), t["treetops"].select("row", "col", F.col("tree_id").alias("label")), least=p["least"])
    return {"crowns": crowns, "crown_summary": segments.crown_summary(crowns, p["size"])}


def _segments(t: Tables, p: Mapping[str, Any]) -> Tables:
    """The whole segmentation with its own canopy model and tops; the summary has a row for every top."""
    made = segmentation.segment_trees(t["heights"], segmentation.SegmentRules(**p))
    return {k: made[k] for k in ("segment_points", "segment_summary")}


def _site_volumes(t: Tables, p: Mapping[str, Any]) -> Tables:
    return {"volumes": tariff.volumes_of_site(t["treetops"], t["dbh"], t.get("profile_volumes"), t["compartment_edges"], t["compartments"], p["strip"])}


STAGES: dict[str, Stage] = {
    s.name: s
    for s in (
        Stage("normalise", (), _normalise, {"size": 0.5}),
        Stage("chm", ("normalise",), lambda t, p: {"chm": grid.canopy_height(t["heights"], p["size"])}, {"size": 0.5}),
        Stage("dtm", ("normalise",), _dtm, {"half": 3}),
        Stage("slope", ("dtm",), lambda t, p: {"slope": grid.slope_aspect(t["dtm"], p["size"])}, {"size": 0.5}),
        Stage("drainage", ("dtm",), lambda t, p: {"flow": terrain.flow_accumulation(terrain.priority_flood(t["dtm"].withColumn("site", F.lit(0)), "site").drop("site"), p["size"])}, {"size": 0.5}),
        Stage("treetops", ("chm",), _treetops, {"size": 0.5, "half": 1, "least": 2.0, "apart": 1.0}),
        Stage("density", ("treetops",), lambda t, p: {"density": grid.hex_density(t["treetops"], p["area"])}, {"area": 25.0}),
        Stage("segmentation", ("chm", "treetops"), _segmentation, {"size": 0.5, "least": 2.0}),
        Stage("segments", ("normalise",), _segments, asdict(segmentation.SegmentRules())),
        Stage("stem_profile", (), lambda t, p: {"profile": stems.profile(t["models"], t["slices"], ["tree_id"])}, {}),
        Stage("dbh", (), lambda t, p: {"dbh": stems.breast_diameter(t["slices"], t["models"], ["tree_id"])}, {}),
        Stage("site_volumes", ("treetops",), _site_volumes, {"strip": 50.0}),
        Stage("tariff", (), lambda t, p: {"volumes": tariff.tree_tariffs(t["trees"], t.get("profile_volumes"))}, {}),
    )
}


def list_stages() -> list[dict[str, Any]]:
    return [{"name": s.name, "needs": list(s.needs), "parameters": dict(s.parameters)} for s in STAGES.values()]


def resolved(names: list[str], stages: Mapping[str, Stage] = STAGES) -> list[str]:
    """The named stages and all they need, each once, needs first. Unknown names are ignored; a cycle raises."""
    order: list[str] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in stages:
            return
        if name in open_:
            raise ValueError(f"stages need each other: {' -> '.join([*open_, name])}")
        open_.append(name)
        for need in stages[name].needs:
            visit(need)
        open_.pop()
        order.append(name)

    for name in names:
        visit(name)
    return order


def overrides(spark: SparkSession, stage: Stage) -> dict[str, Any]:
    """A stage's parameters that the session sets, as ``canopyq.<stage>.<parameter>``, in the type of their defaults."""
    found = {k: spark.conf.get(f"canopyq.{stage.name}.{k}", None) for k in stage.parameters}
    return {k: type(stage.parameters[k])(v) for k, v in found.items() if v is not None}


def run(names: list[str], inputs: Tables, parameters: Mapping[str, Mapping[str, Any]] | None = None, keep: bool = True) -> Tables:
    """Runs stages over input tables and returns all tables made; with ``keep`` each is stored, since several stages read it.

    Parameters given here win over the session's, and those over the defaults.
    """
    spark = next(iter(inputs.values())).sparkSession
    tables = dict(inputs)
    for name in resolved(names):
        stage = STAGES[name]
        made = stage.make(tables, {**stage.parameters, **overrides(spark, stage), **(parameters or {}).get(name, {})})
        tables |= {k: stored(v, k) if keep else v for k, v in made.items()}
    return tables
