"""A whole study on a made-up valley: every step and aid that needs no network, in order."""

import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from trailmark import __main__, config, figures, jobs
from trailmark.functions.geo import lon_lat

SETTINGS = {
    "version": "2",
    "extension": {"crs": "EPSG:32719", "resolucion": 30, "bbox": {"oeste": -69.01, "sur": -13.51, "este": -69.0, "norte": -13.5}},
    "datos": {"tramos_excluidos": ["Fuera"]},
    "costo": {"g_max": 0.45, "epsilon": 0.01, "percentiles": [5, 95], "componentes_referencia": ["fisico"], "componentes_ampliado": ["fisico", "ceremonial"], "vecindad": 8},
    "ceremonial": {"distancia_saturacion": 800, "radio_extremos": 100},
    "visibilidad": {"radio": 120, "puntos": [[-69.006, -13.506], "-13.505,-69.005"]},
    "dominio": {"buffer_corredor": 100, "umbral_quebrada": 9000},
    "barrido": {"n_simplex": 2, "unidad": "tramo", "largo_min_unidad": 500, "n_sectores": 2, "n_bloques": 2, "largo_min_bloque": 200, "m_nulos": 3, "tau_max": 0.5, "semilla": 1},
}
GPX = """<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1" xmlns:osmand="https://osmand.net"><trk><trkseg>%s</trkseg></trk></gpx>"""


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    (root / "config.yaml").write_text(yaml.safe_dump(SETTINGS))
    c = config.Config.read(root / "config.yaml")
    s = jobs.Study(spark, c)
    datos, g = c.folder("datos"), s.grid()
    r, k = np.divmod(np.arange(g["rows"] * g["columns"]), g["columns"])
    z = 40 * np.sin(r / 9.0) * np.cos(k / 7.0) + 0.5 * r + np.random.default_rng(1).random(len(r))
    dem = spark.createDataFrame(list(zip(r.tolist(), k.tolist(), z.tolist(), strict=True)), "row long, col long, z double")
    dem.coalesce(2).write.parquet(str(datos / "dem.parquet"))
    dem.withColumn("z", F.col("z") + F.col("col") % 3).coalesce(2).write.parquet(str(datos / "dem2.parquet"))
    features = []
    for name, a, b in (("Alto", (0.15, 0.2), (0.85, 0.35)), ("Bajo", (0.2, 0.8), (0.8, 0.6)), ("Fuera", (0.1, 0.1), (0.9, 0.9)), ("Corto", (0.4, 0.5), (0.45, 0.5))):
        line = [(-69.01 + 0.01 * (a[0] + (b[0] - a[0]) * t), -13.51 + 0.01 * (a[1] + (b[1] - a[1]) * t + 0.06 * np.sin(9 * t))) for t in np.linspace(0, 1, 9)]
        features.append({"type": "Feature", "properties": {"tramnomb": name}, "geometry": {"type": "LineString", "coordinates": line}})
    (datos / "camino.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (datos / "sitios.csv").write_text("nombre,lon,lat\n" + "\n".join(f"s{i},{-69.009 + 0.002 * i},{-13.5075 + 0.001 * i}" for i in range(5)))
    (datos / "trayectorias").mkdir()
    x, y = lon_lat(F.col("x"), F.col("y"), 32719)
    spots = [(400000.0 + 1.2 * t if t < 1500 else 401800.0 + 0.05 * (t % 60), 8500000.0 + 0.1 * t, t) for t in range(0, 2400, 15)]
    places = spark.createDataFrame(spots, "x double, y double, t long").select("t", x.alias("lon"), y.alias("lat")).orderBy("t").collect()
    points = "".join(f'<trkpt lat="{p.lat:.7f}" lon="{p.lon:.7f}"><ele>{3000 + p.t / 30}</ele><time>2026-06-01T12:{p.t // 60:02d}:{p.t % 60:02d}Z</time><hdop>2</hdop><extensions><osmand:speed>{1.2 if p.t < 1500 else 0}</osmand:speed></extensions></trkpt>' for p in places)
    (datos / "trayectorias" / "2026-06-01_12-00_Mon loma.gpx").write_text(GPX % points)
    return s


def test_settings(tmp_path, study, monkeypatch):
    c = study.c
    assert c.components == ("fisico", "ceremonial") and c.cell_components == c.components[1:] and not c.same_models and len(c.offsets) == 8
    assert c.epsg == 32719 and c.criterion == "both" and c.parts == 2 and c.gap_s == 300.0 and c.view_places() == [(-69.006, -13.506), (-69.005, -13.505)]
    with pytest.raises(config.Missing):
        c.registry_service()
    (tmp_path / "c.yaml").write_text("# kept\ngeocam_servicio: old # gone\nother: 1\n")
    config.set_line(tmp_path / "c.yaml", "https://x/rest")
    assert (tmp_path / "c.yaml").read_text() == '# kept\ngeocam_servicio: "https://x/rest"\nother: 1\n'
    with pytest.raises(config.Missing):
        config.set_line(tmp_path / "c.yaml", "x", "nothing")
    lacking = {k: dict(v) if isinstance(v, dict) else v for k, v in SETTINGS.items()}
    del lacking["costo"]["g_max"]
    (tmp_path / "d.yaml").write_text(yaml.safe_dump(lacking))
    with pytest.raises(config.Missing, match="costo.g_max"):
        config.Config.read(tmp_path / "d.yaml")
    monkeypatch.setenv(config.KEY_VARIABLE, "k")
    (tmp_path / "e.yaml").write_text(yaml.safe_dump(SETTINGS | {"version": "9", "datos": {"geocam_wfs": "https://a/wfs?x=1", "geocam_servicio": "https://a/0/query"}}))
    with pytest.warns(UserWarning):
        e = config.Config.read(tmp_path / "e.yaml")
    assert e.need_key() == "k" and e.registry_service() == ("wfs", "https://a/wfs")


def test_steps_in_order(study):
    with pytest.raises(config.Missing, match="run road first"):
        jobs.units(study)
    assert jobs.road(study)[0]["features"] >= 1
    made = {r["unit"]: r for r in jobs.units(study)}
    assert made.keys() == {"Alto", "Bajo"} and not made["Alto"]["cut"]
    (far,) = jobs.prepare(study)
    assert abs(far["max_m"] - 2) < 1e-9 and abs(far["median_m"] - 1) < 1e-9
    jobs.surfaces(study)
    assert jobs.graph(study)[0]["edges"] > 1000
    rows = {r["unit"]: r for r in jobs.review(study)}
    for r in rows.values():
        assert r["first_ratio"] >= 1 - 1e-9 and r["frechet"] >= r["distance_m"] / 2 and r["modelled_m"] >= r["straight_m"] * 0.9 and r["touches"] in (True, False)
    bands = jobs.ratios(study)
    assert all(r["ratio_12"] is None or r["ratio_2"] is None or r["ratio_12"] <= r["ratio_2"] + 1e-9 for r in bands) and all(abs(r["first_ratio"] - rows[r["unit"]]["first_ratio"]) < 1e-9 for r in bands)
    nulls = jobs.null_model(study)
    assert all(r["n"] == 3 and r["p"] in (0.25, 0.5, 0.75, 1.0) and r["p25"] >= 1 - 1e-9 for r in nulls)
    found = jobs.swept(study)
    assert {r["model"] for r in found} == {"reference", "extended"} and all(r["gain_pct"] >= -1e-9 and abs(sum(r["w"]) - 1) < 1e-9 for r in found)
    assert jobs.validate(study)[0]["pairs"] == 4
    assert {(r["unit_a"], r["unit_b"]) for r in jobs.results(study)} == {("Alto", "Bajo")}
    assert (study.c.folder("resultados") / "jaccard_profile.svg").read_text().startswith("<svg")


def test_aids(study):
    (row,) = jobs.tracks(study)
    assert row["mode"] == "pie" and row["n_stops"] == 1 and 800 < row["stopped_s"] < 960 and 1500 < row["length_m"] < 2600
    assert len(json.loads((study.c.folder("resultados") / "stop_sensitivity.json").read_text())) == 21
    grown = jobs.box(study)
    assert [r["n"] for r in grown] == [1, 2, 3] and all(r["factor"] >= 1 for r in grown)
    stations = jobs.field_plan(study)
    assert all(r["kind"] in "ABC" for r in stations)
    tolerances = jobs.road_network(study, (0.0, 50.0))
    assert len(tolerances) == 2 and tolerances[0]["components"] >= 2 and tolerances[1]["features_all"] == tolerances[0]["features_all"]
    assert (study.c.folder("resultados") / "network_verdict.txt").read_text().startswith("fragments")
    with pytest.raises(config.Missing):
        jobs.sector_sensitivity(study)
    assert jobs.run(study, "units").keys() == {"units"}


def test_command(study, capsys):
    assert __main__.main(["units", "--config", str(study.c.root / "config.yaml")]) == 0
    assert "units:" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        __main__.main(["nothing"])


def test_figures():
    text = figures.sections_figure([{"cut": 3, "start": 0.0, "stop": 1.0, "dominant": "a<b"}], True)
    assert text.startswith("<svg") and "a&lt;b" in text
