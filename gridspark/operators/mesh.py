"""Quadtree meshes and extreme events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import cell_size_km, compare, haversine

#: Event type, variable, operator, threshold.
EVENTS = (
    ("typhoon", "vorticity", ">", 1e-4),
    ("typhoon", "pressure", ">", 99000.0),
    ("typhoon", "wind_speed", ">", 17.0),
    ("heatwave", "temperature_2m", ">", 305.15),
    ("heatwave", "humidity", ">", 0.6),
    ("heavy_rain", "precipitation", ">", 1e-4),
)
#: A cell's id is its level times this, and its place in the level: four times its parent's, and its quarter.
LEVEL = 1 << 52
EVENT_RADIUS = {"typhoon": 500.0, "heatwave": 300.0, "heavy_rain": 200.0}


def base_mesh(spark: SparkSession, resolution: float, lat=(-90.0, 90.0), lon=(0.0, 360.0)) -> DataFrame:
    """Cells of level 0 in rows from the south: cell_id, level, bounds."""
    rows, columns = (int((x[1] - x[0]) / resolution + 1e-9) for x in (lat, lon))
    i, j = F.expr(f"id div {columns}"), F.col("id") % columns
    # Each bound is worked out once for both cells that it parts, so that no point lies in two cells or in none.
    south, west, north, east = lat[0] + i * resolution, lon[0] + j * resolution, lat[0] + (i + 1) * resolution, lon[0] + (j + 1) * resolution
    cells = spark.range(rows * columns)
    return cells.select(F.col("id").alias("cell_id"), F.lit(0).alias("level"), south.alias("lat_min"), north.alias("lat_max"), west.alias("lon_min"), east.alias("lon_max"))


def children(cells: DataFrame) -> DataFrame:
    """Four quarters of each cell: south-west, south-east, north-west, north-east."""
    mid_lat, mid_lon = (F.col("lat_min") + F.col("lat_max")) / 2, (F.col("lon_min") + F.col("lon_max")) / 2
    parts = []
    for k in range(4):
        a = (F.col("lat_min"), mid_lat) if k < 2 else (mid_lat, F.col("lat_max"))
        o = (F.col("lon_min"), mid_lon) if k % 2 == 0 else (mid_lon, F.col("lon_max"))
        parts.append(F.struct(F.lit(k).alias("k"), a[0].alias("lat_min"), a[1].alias("lat_max"), o[0].alias("lon_min"), o[1].alias("lon_max")))
    out = cells.select("cell_id", "level", F.explode(F.array(*parts)).alias("c"))
    return out.select(
        ((F.col("level") + 1).cast("long") * LEVEL + (F.col("cell_id") % LEVEL) * 4 + F.col("c.k")).alias("cell_id"), (F.col("level") + 1).alias("level"), "c.lat_min", "c.lat_max", "c.lon_min", "c.lon_max", F.col("cell_id").alias("parent")
    )


def refine(mesh: DataFrame, chosen: DataFrame, max_level: int = 4, min_km: float = 1.0) -> DataFrame:
    """The mesh with its chosen leaves (cell_id) quartered, unless they are at
    the deepest level or too small."""
    flags = mesh.join(chosen.select("cell_id", F.lit(True).alias("_go")).distinct(), "cell_id", "left")
    size = cell_size_km(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"))
    go = F.coalesce("_go", F.lit(False)) & (F.col("level") < max_level) & (size > min_km)
    keep = flags.where(~go).drop("_go")
    new = children(flags.where(go))
    return keep.unionByName(new.select(*keep.columns) if "parent" in keep.columns else new.drop("parent"))


def coarsen(mesh: DataFrame) -> DataFrame:
    """Parents of which all four children are leaves."""
    return mesh.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("parent")


def locate(points: DataFrame, mesh: DataFrame, base: float) -> DataFrame:
    """Each point (lat, lon) with the deepest leaf that contains it (half-open
    bounds). Points and leaves meet by the base cell they lie in, a leaf by its
    centre; a point so near an edge that rounding decides meets those on either
    side, and the bounds settle it."""
    near = lambda x: F.array_distinct(F.array(F.floor(x / base - 1e-6), F.floor(x / base + 1e-6)))
    mid = lambda c: F.floor((F.col(f"{c}_min") + F.col(f"{c}_max")) / 2 / base)
    p = points.withColumn("_a", F.explode(near(F.col("lat")))).withColumn("_o", F.explode(near(F.col("lon"))))
    m = mesh.withColumns({"_a": mid("lat"), "_o": mid("lon")})
    inside = (F.col("lat") >= F.col("lat_min")) & (F.col("lat") < F.col("lat_max")) & (F.col("lon") >= F.col("lon_min")) & (F.col("lon") < F.col("lon_max"))
    return p.join(m, ["_a", "_o"]).where(inside).drop("_a", "_o")


def cells_to_refine(located: DataFrame, variable: str, operator: str, threshold: float) -> DataFrame:
    """Leaves whose largest value meets the criterion."""
    top = located.groupBy("cell_id").agg(F.max(variable).alias("top"))
    return top.where(compare(F.col("top"), operator, F.lit(threshold)))


def near_point(mesh: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    centre = ((F.col("lat_min") + F.col("lat_max")) / 2, (F.col("lon_min") + F.col("lon_max")) / 2)
    return mesh.where(haversine(F.lit(lat), F.lit(lon), *centre) <= radius_km)


def mesh_statistics(mesh: DataFrame) -> DataFrame:
    size = cell_size_km(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"))
    return mesh.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.min(size).alias("min_km"), F.max(size).alias("max_km"), F.avg(size).alias("mean_km"))


def event_candidates(cells: DataFrame, events=EVENTS, top: int = 20) -> DataFrame:
    """The strongest cells (lat, lon, variables...) of each event type: all of
    its thresholds on variables that the cells have are exceeded; intensity is
    the mean ratio to the thresholds. The top of a type is kept in each task
    before the shuffle."""
    parts = []
    for kind in dict.fromkeys(e[0] for e in events):
        own = [e for e in events if e[0] == kind and e[1] in cells.columns]
        if not own:
            continue
        test, ratio = F.lit(True), F.lit(0.0)
        for _, v, op, limit in own:
            test = test & compare(F.col(v), op, F.lit(limit))
            ratio = ratio + F.abs(F.col(v)) / limit / len(own)
        parts.append(cells.where(test).withColumns({"event_type": F.lit(kind), "intensity": ratio, "radius_km": F.lit(EVENT_RADIUS[kind])}))
    if not parts:
        return cells.limit(0).withColumns({"event_type": F.lit(""), "intensity": F.lit(0.0), "radius_km": F.lit(0.0), "confidence": F.lit(0.0), "rank": F.lit(0)})
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("intensity"), "lat", "lon"))
    return out.withColumns({"confidence": F.least(F.lit(1.0), F.col("intensity")), "rank": rank}).where(F.col("rank") <= top)


def cluster_events(events: DataFrame) -> DataFrame:
    """Greedy clusters in order of intensity: an event joins the first seed of
    its type nearer than the mean of their radii. Depends on the order, so a
    type (``top`` rows of event_candidates) is one group."""
    import pandas as pd

    from .enkf import distance

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, left = [], pdf.sort_values(["intensity", "lat", "lon"], ascending=[False, True, True])
        while len(left):
            seed = left.iloc[0]
            away = distance(left["lat"].to_numpy(), left["lon"].to_numpy(), seed["lat"], seed["lon"])
            near = away < (left["radius_km"].to_numpy() + seed["radius_km"]) / 2
            near[0] = True
            own, left = left[near], left[~near]
            rows.append((seed["event_type"], own["lat"].mean(), own["lon"].mean(), own["intensity"].max(), own["confidence"].max(), len(own)))
        return pd.DataFrame(rows, columns=["event_type", "lat", "lon", "intensity", "confidence", "members"])

    return events.groupBy("event_type").applyInPandas(one, "event_type string, lat double, lon double, intensity double, confidence double, members long")


def contains(lat: Column, lon: Column) -> Column:
    return (lat >= F.col("lat_min")) & (lat < F.col("lat_max")) & (lon >= F.col("lon_min")) & (lon < F.col("lon_max"))


def centres(mesh: DataFrame) -> DataFrame:
    """lat and lon of the cells' centres, and their area in square degrees."""
    mid = lambda c: (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2
    area = (F.col("lat_max") - F.col("lat_min")) * (F.col("lon_max") - F.col("lon_min"))
    return mesh.withColumns({"lat": mid("lat"), "lon": mid("lon"), "area": area})


def refine_to(mesh: DataFrame, points: DataFrame, level: int, base: float, max_level: int = 4, min_km: float = 1.0) -> DataFrame:
    """The mesh with the leaves that hold the points quartered until these are
    leaves of ``level``. A level reads the mesh of the one before several times, so
    each is written to the shared folder and no plan holds more than one."""
    from ..plans.scratch import materialise

    for k in range(min(level, max_level)):
        hit = locate(points.select("lat", "lon"), mesh.where(F.col("level") == k), base).select("cell_id").distinct()
        mesh = materialise(refine(mesh, hit, max_level, min_km), "mesh")
    return mesh


def cells_by_gradient(located: DataFrame, variable: str = "value", lat: str = "lat_idx", lon: str = "lon_idx") -> DataFrame:
    """Of each mesh cell the largest forward-difference gradient of the grid
    points in it; points without a neighbour on either axis inside the cell count
    for nothing."""
    ahead = lambda by, axis: F.lead(variable).over(W.partitionBy("cell_id", by).orderBy(axis)) - F.col(variable)
    out = located.withColumns({"_dy": ahead(lon, lat), "_dx": ahead(lat, lon)})
    return out.groupBy("cell_id").agg(F.max(F.sqrt(F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx"))).alias("gradient"))


def refined_by(mesh: DataFrame, cells: DataFrame, criteria: list[tuple[str, str, float]], base: float, events=EVENTS, max_level: int = 4, min_km: float = 1.0) -> DataFrame:
    """One turn of the refiner: leaves are quartered where a criterion (variable,
    operator, threshold) holds on the cells (lat, lon, variables...) in them, and
    those that hold the centre of an extreme event."""
    located = locate(cells, mesh, base)
    chosen = event_candidates(cells, events).select("lat", "lon")
    hit = locate(chosen, mesh, base).select("cell_id")
    for variable, operator, threshold in criteria:
        if variable in cells.columns:
            hit = hit.unionByName(cells_to_refine(located, variable, operator, threshold).select("cell_id"))
    return refine(mesh, hit, max_level, min_km)
