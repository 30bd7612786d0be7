"""A basin: its polygon, what is known of it, and what was done with it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import flow, network, polygons, rings
from freshet.sources import ledger


@dataclass
class Basin:
    """rings: vertices (ring, seq, x: longitude, y: latitude). provenance: how the polygon came about; log: what was fetched for it."""

    rings: DataFrame
    provenance: dict = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    @classmethod
    def from_rings(cls, table: DataFrame, **provenance) -> Basin:
        return cls(table.select("ring", "seq", "x", "y"), provenance)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Basin:
        """The polygons of a file of GeoJSON (features, collections or geometries, one for each line) as one basin."""
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("poly"), F.col("value").alias("feature"))
        found = ledger.read_features(lines)
        return cls(found.select(F.concat_ws(".", "poly", "ring").alias("ring"), "seq", "x", "y"), {"file": path})

    @classmethod
    def from_geometry(cls, spark: SparkSession, geojson: str, **provenance) -> Basin:
        """A polygon or multipolygon given as GeoJSON text."""
        found = ledger.read_features(spark.createDataFrame([(0, geojson)], "poly int, feature string"))
        return cls(found.select("ring", "seq", "x", "y"), provenance)

    @classmethod
    def from_edges(cls, edges: DataFrame, **provenance) -> Basin:
        """The polygon that directed edges (x1, y1, x2, y2) bound, the inside on their left."""
        found = rings.assemble(edges.select(F.lit(0).alias("poly"), "x1", "y1", "x2", "y2"))
        return cls(found.select("ring", "seq", "x", "y", "shell"), provenance)

    @classmethod
    def from_point(cls, units: DataFrame, unit_rings: DataFrame, outlet: int | tuple[float, float], within: float = 1e-5, cell: float = 0.5) -> Basin:
        """The union of all units (id, next) that drain to the outlet, of their polygons (poly, ring, seq, x, y).

        outlet: the id of a unit, or longitude and latitude of a point, whose unit it is then.
        """
        spark = units.sparkSession
        own = polygons.edges(unit_rings)
        made = {"backend": "units"}
        if isinstance(outlet, tuple):
            point = spark.createDataFrame([(0, float(outlet[0]), float(outlet[1]))], "id int, x double, y double")
            hit = polygons.points_in(point, own, cell).agg(F.min("poly").alias("poly")).first()
            if hit["poly"] is None:
                raise ValueError(f"no unit holds the point {outlet}")
            made["point"], outlet = list(outlet), hit["poly"]
        up = network.upstream(units, spark.createDataFrame([(outlet,)], "id long"))
        union = rings.union(own, up.select(F.col("id").alias("poly"), F.lit(0).alias("grp")), within, overlaps=False)
        return cls.from_edges(union, outlet=outlet, units=up.count(), **made)

    @classmethod
    def from_surface(cls, tiles: DataFrame, outlet: tuple[int, int], west: float, north: float, step: float, tile: int = 512, layer: object = 0) -> Basin:
        """The cells of a routed surface (flow.route) that drain to a cell (row, col), as a polygon on the grid of the surface."""
        spark = tiles.sparkSession
        kind = dict(tiles.dtypes)["layer"]
        at = spark.createDataFrame([(1, *outlet)], "outlet long, row int, col int").withColumn("layer", F.lit(layer).cast(kind))
        mask = flow.basins(tiles, at, tile)
        edges = polygons.mask_outline(mask, F.lit(True))
        x, y = (lambda c: F.lit(west) + F.col(c) * step), (lambda c: F.lit(north) + F.col(c) * step)
        edges = edges.select(x("x1").alias("x1"), y("y1").alias("y1"), x("x2").alias("x2"), y("y2").alias("y2"))
        return cls.from_edges(edges, outlet=list(outlet), backend="surface")

    def __post_init__(self) -> None:
        self.edges = polygons.edges(self.rings.withColumn("poly", F.lit(0)).select("poly", "ring", "seq", "x", "y"))

    def feature(self, **properties) -> str:
        """The basin as one GeoJSON feature, with its measures among the properties."""
        known = {**self.measures(), **properties}
        one = self.rings.sparkSession.createDataFrame([(0, *known.values())], ["poly", *known])
        return ledger.features(self.rings.withColumn("poly", F.lit(0)), one).first()["feature"]

    def bounds(self) -> tuple[float, float, float, float]:
        r = self.edges.agg(F.min("x1"), F.min("y1"), F.max("x1"), F.max("y1")).first()
        return tuple(r)

    def centroid(self) -> tuple[float, float]:
        """Longitude and latitude of the polygon's centre of gravity, in degrees."""
        cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
        r = self.edges.agg(F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("x"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("y")).first()
        return r["x"] / (3 * r["a"]), r["y"] / (3 * r["a"])

    def measures(self) -> dict[str, float]:
        """area_km2, perimeter_km and box_efficiency, in an equal-area projection about the centroid."""
        lon0, lat0 = self.centroid()
        names = [("x1", "y1"), ("x2", "y2")]
        metres = [F.expr(e).alias(n) for pair in names for n, e in zip(pair, polygons.equal_area_sql(*pair, repr(float(lon0)), repr(float(lat0))), strict=True)]
        m = polygons.measures(self.edges.select(F.lit(0).alias("poly"), *metres)).first()
        return {"area_km2": m["area"] / 1e6, "perimeter_km": m["perimeter"] / 1e3, "box_efficiency": m["box_efficiency"]}

    def contains(self, points: DataFrame, cell: float = 0.1) -> DataFrame:
        """id of points (id, x, y) inside."""
        return polygons.points_in(points, self.edges, cell).select("id")

    def record(self, call: str, **attributes) -> None:
        """Adds to the log what was called, when, and with what."""
        self.log.append({"call": call, "at": datetime.now(UTC).isoformat(timespec="seconds"), **attributes})

    def summary(self, **parts) -> dict:
        """Measures and the given parts (functions of the basin); one that fails gives its error in place of a value."""
        out = {"bounds": self.bounds(), "centroid": self.centroid(), **self.measures(), "provenance": self.provenance}
        for name, part in parts.items():
            try:
                out[name] = part(self)
            except Exception as e:  # a summary tells what is known, and why the rest isn't
                out[name] = {"error": f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"}
        return out

    def to_json(self, **parts) -> str:
        return ledger.provenance(self.summary(**parts))
