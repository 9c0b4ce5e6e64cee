"""The steps of a study: each reads tables that earlier ones wrote and writes its own, as Parquet in the study's folders (datos, derivados, resultados).

Inputs in datos: `trayectorias/*.gpx`; a file of lines (KMZ, KML, GeoPackage, shapefile, GeoJSON, GPX); `dem.parquet` and optionally `dem2.parquet`
(row, col, z on the study's grid, x and y counting from cell (0, 0) as in the engine's other tables), or text grids `dem.asc`; `sitios.csv`. A step says what it lacks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import figures
from .config import Config, Missing
from .functions.cost import visibility_cost
from .functions.geo import utm
from .operators import field, hydrology, lines, network, nulls, paths, raster, visibility
from .operators import trajectory as tr
from .plans import extent
from .sources import gpx, registry, services, vectors

COUNT_BANDS = [2, 3, 5, 8, 12]


class Study:
    """A study's settings and tables."""

    def __init__(self, spark: SparkSession, config: Config, again: bool = False):
        self.spark, self.c, self.again = spark, config, again

    def has(self, folder: str, name: str) -> bool:
        return (self.c.folder(folder) / f"{name}.parquet").exists()

    def table(self, folder: str, name: str, step: str) -> DataFrame:
        if not self.has(folder, name):
            raise Missing(f"{folder}/{name}.parquet is missing: run {step} first")
        return self.spark.read.parquet(str(self.c.folder(folder) / f"{name}.parquet"))

    def put(self, df: DataFrame, folder: str, name: str) -> DataFrame:
        at = str(self.c.folder(folder) / f"{name}.parquet")
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def show(self, df: DataFrame, name: str) -> list[dict]:
        """A result of a few rows, as a table and as JSON."""
        rows = [r.asDict(True) for r in self.put(df, "resultados", name).limit(10_000).collect()]  # a report
        (self.c.folder("resultados") / f"{name}.json").write_text(json.dumps(rows, indent=1, default=str, ensure_ascii=False))
        return rows

    # ------------------------------------------------ inputs

    def grid(self) -> dict:
        """Columns, rows and the north-western corner of the study's grid, snapped outward."""
        west, south, east, north = (F.lit(v) for v in self.c.box)
        xs, ys = zip(*[utm(lon, lat, self.c.epsg) for lon in (west, east) for lat in (south, north)], strict=True)
        size = self.c.resolution
        one = self.spark.range(1).select((F.floor(F.least(*xs) / size) * size).alias("west"), (F.ceil(F.greatest(*ys) / size) * size).alias("north"), (F.ceil(F.greatest(*xs) / size) * size).alias("east"), (F.floor(F.least(*ys) / size) * size).alias("south"))
        r = one.first()
        return {"west": r.west, "north": r.north, "columns": round((r.east - r.west) / size), "rows": round((r.north - r.south) / size)}

    def dem(self, name: str) -> DataFrame | None:
        at = self.c.folder("datos")
        if self.has("datos", name):
            return self.spark.read.parquet(str(at / f"{name}.parquet")).select("row", "col", "z")
        if (at / f"{name}.asc").exists():
            return vectors.read_grid(self.spark, str(at / f"{name}.asc")).select("row", "col", "z")
        return None

    def local(self, df: DataFrame) -> DataFrame:
        """x and y in the study's projection, from the centre of cell (0, 0), y with the rows."""
        g, half = self.grid(), self.c.resolution / 2
        return df.withColumns({"x": F.col("x") - g["west"] - half, "y": g["north"] - half - F.col("y")})

    def fixes(self) -> DataFrame:
        at = self.c.folder("datos") / "trayectorias"
        if not at.is_dir() or not any(at.glob("*.gpx")):
            raise Missing("datos/trayectorias holds no GPX file")
        return gpx.read_tracks(self.spark, str(at), self.c.epsg)

    def observed(self) -> DataFrame:
        return self.table("derivados", "units", "units")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self.table("derivados", "nodes", "graph"), self.table("derivados", "edges", "graph")

    def contexts(self, observed: DataFrame | None = None, components: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        """paths.units of the observed lines, with the components that depend on a unit's sites."""
        nodes, edges = self.graph()
        observed = self.observed() if observed is None else observed
        members, own, ends = (network.cut_lineage(x) for x in paths.units(nodes, edges, observed, self.c.corridor, self.c.resolution))
        wanted = [c for c in ("ceremonial", "visibilidad") if c in self.c.components]
        if not components or not wanted:
            return members, own, ends
        sites = self.local_sites()
        marks = observed.groupBy("unit").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
        places = marks.select(F.explode(F.array("a", "b")).alias("p")).select("p.x", "p.y")
        usable = raster.without_near(sites, places, self.c.site_end_radius)
        if usable.limit(1).count() == 0:
            raise Missing("no site is left away from the lines' ends")
        spots = nodes.join(members.select("node").distinct(), "node").select(F.col("node").alias("id"), "x", "y")
        for name in wanted:
            if name == "ceremonial":
                value = raster.site_proximity(spots, usable, self.c.site_saturation).select(F.col("id").alias("node"), (F.col("proximity") + self.c.epsilon).alias("value"))
            else:
                targets = usable.select("x", "y").withColumn("id", F.monotonically_increasing_id())
                seen = visibility.visible_share(self.table("derivados", "dem", "prepare"), spots, network.cut_lineage(targets), self.c.resolution, self.c.view_radius, self.c.eye_height, self.c.target_height)
                value = seen.select(F.col("id").alias("node"), (visibility_cost(F.col("share")) + self.c.epsilon).alias("value"))
            own = network.cut_lineage(paths.with_component(own, self.c.components.index(name), network.cut_lineage(value)))
        return members, own, ends

    def local_sites(self) -> DataFrame:
        at = [p for p in sorted(self.c.folder("datos").glob("sitios*")) if p.suffix == ".csv"]
        named = self.c.folder("datos") / self.c.sites_file if self.c.sites_file else (at[0] if at else None)
        if named is None or not Path(named).exists():
            raise Missing("the extended model needs sites: datos/sitios*.csv")
        s = registry.read_sites(self.spark, str(named))
        extra = self.c.view_places()
        if extra:
            s = s.unionByName(self.spark.createDataFrame([("", lon, lat) for lon, lat in extra], "name string, lon double, lat double"))
        x, y = utm(F.col("lon"), F.col("lat"), self.c.epsg)
        return self.local(s.select("name", x.alias("x"), y.alias("y")))

    def weights(self, model: str) -> DataFrame:
        return paths.model_weights(self.spark, list(self.c.components), list(self.c.models[model]), self.c.parts)

    @property
    def physical(self) -> list[float]:
        return [1.0] + [0.0] * (len(self.c.components) - 1)


# ---------------------------------------------------------------- steps


def fetch(s: Study) -> None:
    """Elevation models of the box, and standing water; a file that covers the box stays."""
    for model, name in (("COP30", "cop30.tif"), ("AW3D30", "aw3d30.tif")):
        url, params = services.elevation_query(s.c.box, model, s.c.need_key())
        services.saved(url, s.c.folder("datos") / name, params, s.again)


def layer(s: Study, fetch_: services.Fetch = services.over_http) -> Path:
    """The registry's lines, from its feature service or its paged one, or ways of the open map (`osm`), as a file in datos."""
    to = s.c.folder("datos") / "camino.geojson"
    kind, address = s.c.registry_service()
    if kind == "wfs":
        found = services.capabilities(address, fetch_)
        if found is None:
            raise Missing(f"{address} answers with no layers")
        name = s.c.wfs_layer or services.scored_layers(found[1])[0]["name"]
        text = services.layer_text(address, name, found[0], services.json_format(services.formats_of(found[1])), fetch_)
    else:
        text = json.dumps({"type": "FeatureCollection", "features": list(services.paged_features(s.c.need_rest(), s.c.box, fetch_))})
    to.write_text(text, encoding="utf-8")
    return to


def map_layer(s: Study, mirrors: tuple[str, ...] = services.MIRRORS, fetch_: services.Fetch = services.over_http) -> Path:
    """Ways of the open map that may be the road, as a file in datos."""
    features = services.map_features(services.map_answer(services.road_query(s.c.box), list(mirrors), fetch_))
    if not features:
        raise Missing("the open map has no such way in the box")
    to = s.c.folder("datos") / "camino.geojson"
    to.write_text(json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
    return to


def road(s: Study) -> list[dict]:
    """The road's lines (unit, seq, x, y), from a file, recorded tracks or the registry's service; names that are excluded go, and registry lines are
    cut to the box."""
    datos = s.c.folder("datos")
    best = vectors.best_source(s.spark, str(datos)) if any(p.is_file() for p in datos.iterdir()) else None
    kind = vectors.source_kind("auto", best is not None, (datos / "trayectorias").is_dir())
    if kind == "service":
        raise Missing("no file of lines in datos: fetch the registry's layer first")
    if kind == "tracks":
        made = tr.as_lines(s.fixes().withColumn("t", F.unix_micros("ts") / 1e6), s.c.resolution)
        rows = made.select(F.coalesce("label", "stretch").alias("name"), F.col("stretch").alias("feature"), F.lit(0).cast("long").alias("part"), "seq", "x", "y", F.lit(True).alias("recorded"))
    else:
        raw = vectors.read_vectors(s.spark, best).where("kind = 'LineString'")
        name = F.coalesce(F.col("attributes").getItem("tramnomb"), F.col("attributes").getItem("name"))
        kept = raw.where(~F.coalesce(name, F.lit("")).isin(list(s.c.excluded))) if s.c.excluded else raw
        points = kept.select(F.coalesce(name, F.lit("(sin nombre)")).alias("name"), F.col("feature").cast("string").alias("feature"), "part", F.posexplode(F.arrays_zip("x", "y")).alias("seq", "p"))
        x, y = utm(F.col("p.x"), F.col("p.y"), s.c.epsg)
        rows = points.select("name", "feature", "part", F.col("seq").cast("long").alias("seq"), x.alias("x"), y.alias("y"), F.lit(False).alias("recorded"))
    made = s.put(s.local(rows), "derivados", "road")
    return s.show(extent.source_summary(lines.segments(made, ["name", "feature", "part"])), "road_summary")


def units(s: Study) -> list[dict]:
    """What is compared: each name's longest feature that is long enough, or equal sectors of the longest one."""
    made = s.table("derivados", "road", "road")
    keyed = made.withColumn("id", F.concat_ws("|", "feature", "part"))
    total = lines.lengths(keyed, ["name", "id"])
    best = Window.partitionBy("name").orderBy(F.desc("length"), "id")
    longest = total.withColumn("n", F.row_number().over(best)).where("n = 1")
    if s.c.unit == "sector":
        one = longest.orderBy(F.desc("length"), "name").limit(1).select("name", "id")
        cut = lines.equal_parts(keyed.join(one, ["name", "id"]), ["name"], s.c.sectors)
        out = cut.select(F.concat(F.lit("s"), F.col("part").cast("string")).alias("unit"), "seq", "x", "y")
    else:
        out = keyed.join(longest.where(F.col("length") >= s.c.least_unit_m).select("name", "id"), ["name", "id"]).select(F.col("name").alias("unit"), "seq", "x", "y")
    out = s.put(out, "derivados", "units")
    if out.limit(1).count() == 0:
        raise Missing(f"no line is {s.c.least_unit_m / 1000:g} km long")
    g, size = s.grid(), s.c.resolution
    box = (-size / 2, -size / 2, (g["columns"] - 0.5) * size, (g["rows"] - 0.5) * size)
    return s.show(lines.lengths(out, ["unit"]).join(raster.cut_off(out, "unit", box, 2 * size), "unit").orderBy(F.desc("length")), "units")


def prepare(s: Study) -> list[dict]:
    """The surface, its disagreement with a second one, and the corridor around the lines."""
    dem = s.dem("dem")
    if dem is None:
        raise Missing("datos/dem.parquet or datos/dem.asc is missing")
    g = s.grid()
    if raster.off_grid(dem, g["rows"], g["columns"]).limit(1).count():
        raise Missing(f"the surface reaches beyond the box's {g['rows']} by {g['columns']} cells: it was made for another one")
    dem = s.put(dem, "derivados", "dem")
    seg = lines.segments(s.table("derivados", "road", "road"), ["name", "feature", "part"]).select("x", "y", "x1", "y1")
    s.put(raster.corridor_mask(dem, seg, s.c.resolution, s.c.corridor), "derivados", "corridor")
    other = s.dem("dem2")
    return s.show(raster.uncertainty(dem, other), "uncertainty") if other is not None else []


def surfaces(s: Study) -> None:
    """Slope, aspect, ruggedness, filled heights, upstream cells and channels of the corridor; the most rugged cells are out of the graph."""
    dem = s.table("derivados", "dem", "prepare").join(s.table("derivados", "corridor", "prepare"), ["row", "col"], "left_semi")
    terrain = s.put(raster.slope_aspect(dem, s.c.resolution), "derivados", "terrain")
    rugged = s.put(raster.ruggedness(terrain), "derivados", "ruggedness")
    out = raster.over_percentile(rugged, "vrm", s.c.ruggedness_percentile / 100)
    s.put(dem.join(out, ["row", "col"], "left_anti"), "derivados", "passable")
    high = s.put(hydrology.filled(dem), "derivados", "filled")
    water = hydrology.accumulation(raster.downstream(high, s.c.resolution))
    s.put(water.withColumn("channel", hydrology.is_channel(F.col("cells"), s.c.channel, s.c.resolution)), "derivados", "water")


def graph(s: Study) -> list[dict]:
    """Nodes and edges of the passable cells; components that depend on a unit stand at a half until it is known."""
    cells = s.table("derivados", "passable", "surfaces")
    width = s.grid()["columns"]
    size = s.c.resolution
    nodes = s.put(cells.select((F.col("row") * width + F.col("col")).alias("node"), "row", "col", (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y")), "derivados", "nodes")
    e = raster.edges(cells, size, s.c.offsets, s.c.g_max)
    neutral = [F.lit(0.5)] * (len(s.c.components) - 1)
    edges = s.put(e.select((F.col("row") * width + F.col("col")).alias("src"), (F.col("to_row") * width + F.col("to_col")).alias("dst"), "l", F.array("phi", *neutral).alias("phi"), "row", "col"), "derivados", "edges")
    return s.show(s.spark.range(1).select(F.lit(nodes.count()).alias("nodes"), F.lit(edges.count()).alias("edges")), "graph")


def review(s: Study) -> list[dict]:
    """For each unit the physical optimum against the line: lengths, distances, cost ratio, whether the neighbourhood's edge or the line's own shape
    decides."""
    observed = s.observed()
    members, own, ends = s.contexts(components=False)
    nodes, edges = s.graph()
    one = s.spark.createDataFrame([(0, s.physical)], "weight_id long, w array<double>")
    best = s.put(paths.sweep(own, ends, one, size=s.c.resolution), "derivados", "physical")
    lost = best.where("cost = double('infinity')").select("unit").collect()  # units, of which there are few
    if lost:
        raise Missing(f"no way between the ends of {', '.join(r[0] for r in lost)}: the corridor is cut")
    way = best.select("unit", F.posexplode("path").alias("seq", "node"))
    modelled = s.put(way.join(nodes.select("node", "x", "y"), "node").select("unit", "seq", "node", "x", "y"), "derivados", "modelled")
    bands = paths.band_costs(nodes, edges, observed, ends, s.physical, [2, 3, 5, 8], s.c.resolution)
    ratio = paths.band_ratios(bands, best.select("unit", "cost")).select("unit", "first_width", "first_ratio")
    run = lines.lengths(observed, ["unit"]).withColumnRenamed("length", "observed_m")
    marks = observed.groupBy("unit").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b")).select("unit", F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("straight_m"))
    dense = lines.equidistant(observed, ["unit"], step=s.c.resolution).select("unit", F.col("k").alias("seq"), "x", "y", "s")
    out = best.select("unit", F.col("length").alias("modelled_m"), F.col("d").alias("distance_m"), "cost")
    for more in (members.groupBy("unit").agg(F.count("*").alias("nodes")), run, marks, ratio, lines.frechet_distance(modelled, dense, "unit"), paths.self_proximity(dense), lines.turns(observed, ["unit"]), paths.touches_edge(modelled, members, nodes)):
        out = out.join(more.withColumnRenamed("distance_m", "self_distance_m") if "distance_m" in more.columns else more, "unit", "left")
    out = out.withColumns({"observed_sinuosity": paths.straightness(F.col("observed_m"), F.col("straight_m")), "modelled_sinuosity": paths.straightness(F.col("modelled_m"), F.col("straight_m"))})
    # a line that comes near itself or turns back is two branches sewn together
    odd = (F.coalesce("self_distance_m", F.lit(float("inf"))) < 150) | (F.col("turn") > 150)
    return s.show(out.withColumn("odd_shape", F.coalesce(odd, F.lit(False))).orderBy(F.desc("observed_m")), "review")


def ratios(s: Study) -> list[dict]:
    """The cost ratio of each unit by the width of the band around its line."""
    members, own, ends = s.contexts(components=False)
    nodes, edges = s.graph()
    one = s.spark.createDataFrame([(0, s.physical)], "weight_id long, w array<double>")
    free = network.cut_lineage(paths.sweep(own, ends, one, size=s.c.resolution).select("unit", "cost"))
    bands = network.cut_lineage(paths.band_costs(nodes, edges, s.observed(), ends, s.physical, COUNT_BANDS, s.c.resolution))
    return s.show(paths.band_ratios(bands, free).join(lines.lengths(s.observed(), ["unit"]), "unit"), "band_ratios")


def null_model(s: Study) -> list[dict]:
    """Paths over random terrain of the real spectrum: how far from the line, and at what cost, chance goes."""
    rugged = s.table("derivados", "ruggedness", "surfaces").select(F.lit(0).alias("tile"), "row", "col", F.col("vrm").alias("z"))
    exponent = nulls.exponents(rugged, "tile").first()["exponent"]
    _, own, ends = s.contexts(components=False)
    drawn = s.put(paths.null_paths(own, ends, s.c.draws, exponent, s.physical, s.c.seed, size=s.c.resolution, epsilon=s.c.epsilon), "derivados", "nulls")
    nodes, edges = s.graph()
    best = paths.sweep(own, ends, s.spark.createDataFrame([(0, s.physical)], "weight_id long, w array<double>"), size=s.c.resolution).select("unit", "cost")
    bands = paths.band_costs(nodes, edges, s.observed(), ends, s.physical, [2, 3, 5, 8], s.c.resolution)
    observed = network.cut_lineage(paths.band_ratios(bands, best).select("unit", "optimum", F.col("first_ratio").alias("ratio")))
    random = drawn.join(observed.select("unit", "optimum"), "unit").select("unit", (F.col("cost") / F.col("optimum")).alias("ratio"))
    return s.show(paths.cost_null(observed.select("unit", "ratio"), random), "cost_null")


def swept(s: Study) -> list[dict]:
    """Both models over all weights: optimum, distance, near-optimal range of each component, p among random paths."""
    _, own, ends = s.contexts()
    out = None
    for model in s.c.models:
        found = s.put(paths.sweep(own, ends, s.weights(model), size=s.c.resolution), "derivados", f"sweep_{model}")
        best = paths.optimum(found.select("unit", "weight_id", "cost", "d", "length")).join(s.weights(model), "weight_id")
        best = best.select("unit", F.lit(model).alias("model"), "d", "length", "w")
        near = paths.near_optimal(found.select("unit", "weight_id", "d"), 0.10).groupBy("unit").agg(F.count("*").alias("near_optimal"))
        one = best.join(near, "unit", "left")
        out = one if out is None else out.unionByName(one)
    out = network.cut_lineage(out)
    s.put(paths.extension(paths.near_optimal(s.table("derivados", "sweep_extended", "sweep").select("unit", "weight_id", "d"), 0.10), s.weights("extended")), "resultados", "extension")
    if s.has("derivados", "nulls"):
        p = paths.empirical_p(out.where("model = 'reference'").select("unit", "d"), s.table("derivados", "nulls", "nulls").select("unit", "d"))
        out = out.join(p, "unit", "left")
    gain = out.groupBy("unit").agg(*[F.max(F.when(F.col("model") == m, F.col("d"))).alias(m) for m in s.c.models]).select("unit", (100 * (F.col("reference") - F.col("extended")) / F.col("reference")).alias("gain_pct"))
    return s.show(out.join(gain, "unit"), "sweep")


def validate(s: Study) -> list[dict]:
    """Weights fitted without a block of the line and judged on it, for both models."""
    observed, n = s.observed(), s.c.blocks
    long = lines.lengths(observed, ["unit"]).where(F.col("length") / n >= s.c.least_block_m).select("unit")
    if long.limit(1).count() == 0:
        raise Missing(f"no unit gives {n} blocks of {s.c.least_block_m:g} m")
    parts = lines.equal_parts(observed.join(long, "unit", "left_semi"), ["unit"], n, s.c.least_block_m)
    blocks = network.cut_lineage(parts.select(F.concat_ws("|", "unit", "part").alias("unit"), "seq", "x", "y"))
    _, own, ends = s.contexts(blocks)
    held = None
    for model in s.c.models:
        found = paths.sweep(own, ends, s.weights(model), size=s.c.resolution)
        name = F.regexp_extract("unit", r"^(.*)\|(\d+)$", 1), F.regexp_extract("unit", r"^(.*)\|(\d+)$", 2).cast("long")
        one = paths.blocked_validation(found.select(name[0].alias("unit"), name[1].alias("block"), "weight_id", "d")).withColumn("model", F.lit(model))
        held = one if held is None else held.unionByName(one)
    held = s.put(held, "derivados", "held")
    s.show(paths.model_summary(held), "validation_summary")
    return s.show(held, "validation") if s.c.same_models else s.show(paths.paired_wins(held), "paired_wins")


def results(s: Study) -> list[dict]:
    """How the units' near-optimal weights overlap, by tau, with a figure."""
    found = s.table("derivados", "sweep_extended", "sweep").select("unit", "weight_id", "d")
    rows = s.show(paths.jaccard_profile(found, [s.c.tau_max * i / 25 for i in range(26)]), "jaccard_profile")
    (s.c.folder("resultados") / "jaccard_profile.svg").write_text(figures.jaccard_figure(rows))
    return rows


def sector_sensitivity(s: Study, cuts: tuple[int, ...] = (3, 4, 5, 6)) -> list[dict]:
    """Whether what dominates along the longest line hangs on where it is cut."""
    if s.c.unit != "sector":
        raise Missing("named stretches aren't cut, so nothing hangs on their cuts: set barrido.unidad to sector")
    made = s.table("derivados", "road", "road").withColumn("id", F.concat_ws("|", "name", "feature", "part"))
    one = lines.lengths(made, ["id"]).orderBy(F.desc("length"), "id").limit(1).select("id")
    rows = None
    for n in cuts:  # a parameter
        parts = lines.equal_parts(made.join(one, "id"), ["id"], n)
        _, own, ends = s.contexts(network.cut_lineage(parts.select(F.col("part").cast("string").alias("unit"), "seq", "x", "y")))
        best = paths.optimum(paths.sweep(own, ends, s.weights("extended"), size=s.c.resolution).select("unit", "weight_id", "d")).join(s.weights("extended"), "weight_id")
        k = F.col("unit").cast("int")
        own_rows = best.select(F.lit(n).alias("cut"), ((k - 1) / n).alias("start"), (k / n).alias("stop"), F.get(F.array(*map(F.lit, s.c.components)), F.array_position("w", F.array_max("w")).cast("int") - 1).alias("dominant"))
        rows = own_rows if rows is None else rows.unionByName(own_rows)
    rows = s.put(rows, "derivados", "sections")
    verdict = s.show(paths.majority_agreement(rows), "sector_agreement")
    (s.c.folder("resultados") / "sector_sensitivity.svg").write_text(figures.sections_figure([r.asDict() for r in rows.collect()], bool(verdict[0]["unstable"])))  # sum of cuts rows
    return verdict


def field_plan(s: Study) -> list[dict]:
    """Where line and model part, what that costs on the spot, and where to go and stand."""
    observed, modelled = s.observed(), s.table("derivados", "modelled", "review")
    nodes, edges = s.graph()
    run = network.cut_lineage(lines.profile(observed, modelled, ["unit"]))
    ends = network.cut_lineage(field.zone_ends(field.separation_zones(run), run))
    own, other = (network.cut_lineage(x) for x in field.zone_lines(ends, observed, modelled))
    zones = own.select(F.concat_ws("|", "unit", "part").alias("unit"), "seq", "x", "y")
    _, graph_, points = paths.units(nodes, edges, zones, s.c.corridor, s.c.resolution)
    one = s.spark.createDataFrame([(0, s.physical)], "weight_id long, w array<double>")
    free = paths.sweep(graph_, points, one, size=s.c.resolution).select("unit", "cost")
    band = paths.band_ratios(paths.band_costs(nodes, edges, zones, points, s.physical, [2, 3, 5, 8], s.c.resolution), free)
    name = F.regexp_extract("unit", r"^(.*)\|(\d+)$", 1), F.regexp_extract("unit", r"^(.*)\|(\d+)$", 2).cast("int")
    costs = band.select(name[0].alias("u"), name[1].alias("zone"), (F.col("first_ratio") * F.col("optimum")).alias("band"), F.col("optimum").alias("free")).withColumnRenamed("u", "unit")
    measured = s.put(field.measured_zones(ends, own, other, costs), "derivados", "zones")
    ratio = s.table("resultados", "review", "review").select("unit", F.col("first_ratio").alias("ratio"))
    goals = s.put(field.chosen_zones(measured, ratio), "resultados", "goals")
    dem = s.table("derivados", "dem", "prepare")
    s.show(field.day_plan(ends, own, other, observed, dem, s.c.resolution).join(goals.select("unit", "zone", "priority"), ["unit", "zone"]), "days")
    return s.show(field.stations(goals, ends, own, other, observed, dem, s.c.resolution).join(goals.select("unit", "zone", "priority", "control"), ["unit", "zone"]), "stations")


def tracks(s: Study) -> list[dict]:
    """Recorded tracks: where their time goes, by mode, by the stops' parameters, and speed by slope; one place a stop."""
    rows = network.cut_lineage(s.fixes())
    found = lambda r: tr.stops(r, s.c.stop_radius, s.c.stop_least_s, s.c.criterion)
    summary = s.put(tr.anatomy(rows, found, s.c.gap_s, s.c.foot_max), "derivados", "anatomy")
    s.show(tr.mode_subtotals(summary), "modes")
    s.show(tr.sensitivity(rows, tr.grid_of()), "stop_sensitivity")
    feet = rows.join(summary.where("mode = 'pie'").select("track"), "track", "left_semi")
    whole = feet.withColumn("piece", F.lit(0).cast("long"))
    marches = tr.marches(whole, tr.stops(whole, s.c.stop_radius, s.c.stop_least_s, s.c.criterion)).withColumn("march", F.concat_ws("|", "track", "from"))
    inside = whole.join(marches.select("track", "march", "from", "to"), "track").where("seq between from and to")
    s.show(tr.slope_bins(tr.step_speeds(tr.resample(inside, ["march"], s.c.step_m), ["march"], s.c.step_m), g_max=s.c.g_max), "speed_by_slope")
    s.put(found(tr.long_pieces(tr.pieces(rows))), "resultados", "stops")
    return s.show(summary, "tracks")


def box(s: Study) -> list[dict]:
    """What the study's box would have to be for each name's line to lie in it whole, cheapest first."""
    made = s.table("derivados", "road", "road")
    g, half = s.grid(), s.c.resolution / 2
    back = made.select(F.col("name"), (F.col("x") + g["west"] + half).alias("x"), (g["north"] - half - F.col("y")).alias("y"))
    return s.show(extent.growth(extent.bounds(back, "name"), s.c.box, s.c.corridor, s.c.epsg, s.c.resolution, len(s.c.components)), "box")


def road_network(s: Study, tolerances: tuple[float, ...] = (0.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)) -> list[dict]:
    """Whether the road's lines make a network to measure: sizes, corridors, and how centrality holds when gaps are closed."""
    seg = lines.segments(s.table("derivados", "road", "road"), ["name", "feature", "part"])
    seg = network.cut_lineage(seg.select("name", F.xxhash64("name", "feature", "part").alias("feature"), F.xxhash64("name", "feature", "part", "seq").alias("id"), "x", "y", "x1", "y1", "s", "s1"))
    pieces = lines.noded(seg, 1000.0)
    named = network.cut_lineage(pieces.join(lines.merged(pieces), "piece"))
    chains = network.cut_lineage(lines.chains(seg, 1000.0))
    half = seg.groupBy("feature").agg((F.max("s1") / 2).alias("h"))
    mid = seg.join(half, "feature").where("h > s and h <= s1")
    w = (F.col("h") - F.col("s")) / (F.col("s1") - F.col("s"))
    middles = mid.select("feature", (F.col("x") + (F.col("x1") - F.col("x")) * w).alias("x"), (F.col("y") + (F.col("y1") - F.col("y")) * w).alias("y"))
    edges = network.cut_lineage(network.graph(chains))
    shares = s.show(network.tree_share(network.corridors(edges)), "corridors")
    rows = s.show(network.tolerance_rows(chains, middles, named.select("chain", "x", "y", "x1", "y1"), list(tolerances), 1000.0), "tolerances")
    (s.c.folder("resultados") / "network_verdict.txt").write_text(network.verdict(rows, shares[0]["no_choice"]))
    return rows


def search(s: Study) -> list[dict]:
    """The likeliest layers of the registry's services; the best one's address goes into the settings."""
    kind, address = s.c.registry_service()
    found = services.capabilities(address) if kind == "wfs" else None
    return services.scored_layers(found[1]) if found else services.candidates([address.split("/")[2]])


#: In order; those after the first ten are asked for by name.
STEPS: dict[str, Callable[[Study], list[dict] | None]] = {"fetch": fetch, "road": road, "units": units, "prepare": prepare, "surfaces": surfaces, "graph": graph, "review": review, "nulls": null_model, "sweep": swept, "validate": validate, "results": results}
AIDS: dict[str, Callable[[Study], list[dict] | None]] = {"search": search, "layer": layer, "map": map_layer, "box": box, "field": field_plan, "network": road_network, "sensitivity": sector_sensitivity, "ratios": ratios, "tracks": tracks}


def run(study: Study, name: str) -> dict[str, float]:
    """A step, an aid, or `all` steps but fetching; seconds by step."""
    chosen = [n for n in STEPS if n != "fetch"] if name == "all" else [name]
    took = {}
    for n in chosen:
        began = time.perf_counter()
        (STEPS | AIDS)[n](study)
        took[n] = time.perf_counter() - began
    return took
