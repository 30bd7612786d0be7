"""What was fetched, what may be passed on, and files for others: ledger, licences, series, features, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recheck(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """url and state of the last entry of each url (url, path, sha256, t) against files (path, content): unchanged, changed, absent or unverifiable."""
    last = ledger.groupBy("url").agg(F.max(F.struct("t", "path", "sha256")).alias("e")).select("url", "e.path", "e.sha256")
    both = last.join(files.select("path", F.sha2("content", 256).alias("now")), "path", "left")
    state = F.when(F.col("now").isNull(), "absent").when(F.col("sha256").isNull(), "unverifiable").when(F.col("sha256") == F.col("now"), "unchanged").otherwise("changed")
    return both.select("url", state.alias("state"))


def cache_key(url: Column) -> Column:
    """Sixteen hexadecimal digits that stand for a url."""
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 16)


def new_sources(ledger: DataFrame, since: Column) -> DataFrame:
    """Urls that were fetched anew since a time, once each, with the first time."""
    return ledger.where((F.col("t") > since) & ~F.coalesce("from_cache", F.lit(False))).groupBy("url").agg(F.min("t").alias("t"))


def licence_report(used: DataFrame, catalogue: DataFrame) -> DataFrame:
    """key, licence, problem of used layers (key) by the catalogue (key, licence, commercial, redistribute): null where nothing stands against it."""
    both = used.distinct().join(catalogue, "key", "left")
    problem = F.when(F.col("licence").isNull(), "unknown").when(~F.coalesce("commercial", F.lit(False)), "non-commercial").when(~F.coalesce("redistribute", F.lit(False)), "no redistribution")
    return both.select("key", "licence", problem.alias("problem"))


def catalogue(entries: DataFrame, category: str | None = None, implemented: bool | None = None, anonymous: bool | None = None) -> DataFrame:
    """Entries (key, category, implemented, anonymous, ...) that fit, by category and key."""
    for column, wanted in (("category", category), ("implemented", implemented), ("anonymous", anonymous)):
        if wanted is not None:
            entries = entries.where(F.col(column) == F.lit(wanted))
    return entries.orderBy("category", "key")


def union_ragged(*frames: DataFrame) -> DataFrame:
    """All rows of frames with different columns, without columns that are null throughout."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    some = out.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in out.columns]).first()
    return out.select(*[F.col(f"`{c}`") for c in out.columns if some[c]])


def flat(rows: DataFrame, key: str) -> DataFrame:
    """key, parameter, value: nested fields of each row as text, named by their way from the top."""

    def leaves(kind, name: str, way: Column):
        if kind.typeName() == "struct":
            for f in kind.fields:
                yield from leaves(f.dataType, f"{name}.{f.name}" if name else f.name, way[f.name])
        else:
            yield name, F.to_json(way) if kind.typeName() in ("array", "map") else way.cast("string")

    each = [leaf for f in rows.schema.fields if f.name != key for leaf in leaves(f.dataType, f.name, F.col(f"`{f.name}`"))]
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), v.alias("value")) for n, v in each])).alias("p")).select(key, "p.*")


def features(rings: DataFrame, properties: DataFrame) -> DataFrame:
    """poly and feature: GeoJSON of polygons (poly, ring, seq, x, y) with properties (poly, ...); a ring is closed by its first vertex.

    With a column shell (the ring that holds each hole, a shell's being itself) a polygon of several shells
    is a MultiPolygon; without it the first ring is the shell of all.
    """
    shell = F.col("shell") if "shell" in rings.columns else F.min("ring").over(Window.partitionBy("poly"))
    ring = rings.withColumn("shell", shell).groupBy("poly", "shell", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    points = F.transform(F.concat("v", F.slice("v", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    # a shell comes before its holes
    part = ring.groupBy("poly", "shell").agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("ring") != F.col("shell")).alias("hole"), "ring", points.alias("p")))), lambda r: r["p"]).alias("part"))
    parts = part.groupBy("poly").agg(F.transform(F.sort_array(F.collect_list(F.struct("shell", "part"))), lambda x: x["part"]).alias("parts"))
    named = properties.select("poly", F.struct(*[c for c in properties.columns if c != "poly"]).alias("properties"))

    def feature(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))

    one = F.size("parts") == 1
    return parts.join(named.hint("merge"), "poly").select("poly", F.when(one, feature("Polygon", F.get("parts", F.lit(0)))).otherwise(feature("MultiPolygon", F.col("parts"))).alias("feature"))


def read_features(lines: DataFrame) -> DataFrame:
    """poly, ring, seq, x, y of GeoJSON (poly, feature): a feature, a collection of them or a geometry in each row.

    Polygons and multipolygons; rings are numbered through in the order of the text, and which are holes
    tells their direction. Any other geometry is an error, null geometries have no rings.
    """
    kind = "struct<type: string, geometry: string, features: array<struct<geometry: string>>>"
    read = lines.select("poly", "feature", F.from_json("feature", kind).alias("f"))
    geometries = F.when(F.col("f.type") == "FeatureCollection", F.transform("f.features", lambda x: x["geometry"])).when(F.col("f.type") == "Feature", F.array("f.geometry")).otherwise(F.array("feature"))
    each = read.select("poly", F.posexplode(geometries).alias("n", "g")).where("g is not null")
    each = each.select("poly", "n", F.from_json("g", "struct<type: string, coordinates: string>").alias("g"))
    rings, parts = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    of = F.when(F.col("g.type") == "Polygon", F.from_json("g.coordinates", rings)).when(F.col("g.type") == "MultiPolygon", F.flatten(F.from_json("g.coordinates", parts)))
    of = of.otherwise(F.raise_error(F.concat(F.lit("no polygon: "), F.coalesce("g.type", F.lit("no type")))).cast(rings))
    whole = each.groupBy("poly").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", of.alias("r")))), lambda x: x["r"])).alias("rings"))
    out = whole.select("poly", F.posexplode("rings").alias("ring", "p"))
    points = out.select("poly", "ring", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("seq", "v"))
    return points.select("poly", "ring", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def write_series(series: DataFrame, path: str) -> None:
    """Series as CSV with a header, in files by ranges of time."""
    series.repartitionByRange("t").sortWithinPartitions("t").write.mode("overwrite").option("header", True).csv(path)


def write_all(spark, jobs: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every table that can be written, as Parquet, and a manifest of what became of each: name, status, rows, error.

    A job that fails doesn't stop the others. An empty table is no error and leaves no folder.
    """
    done = []
    for name, table in jobs.items():
        try:
            if table.isEmpty():
                done.append((name, "empty", 0, None))
                continue
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            done.append((name, "ok", spark.read.parquet(f"{path}/{name}").count(), None))
        except Exception as e:  # the manifest says which and why
            done.append((name, "failed", None, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"))
    manifest = spark.createDataFrame(done, "name string, status string, rows long, error string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def provenance(record: dict) -> str:
    """A record as JSON with keys in order, so that equal records are equal text."""
    return json.dumps(record, sort_keys=True, default=str)
