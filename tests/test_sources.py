import zipfile

import pytest
from pyspark.sql import functions as F

from trailmark.sources import registry

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Folder><name>Tramos Observados</name>
<Placemark><name>a</name><description><![CDATA[<table><tr><td>tramnomb</td><td> Cuesta </td></tr><tr><td>ubigeo</td><td>0101</td></tr></table>]]></description>
<MultiGeometry><LineString><coordinates>-71.1,-13.5,0 -71.2,-13.6,0</coordinates></LineString><LineString><coordinates>-71.3,-13.5 -71.4,-13.6 -71.5,-13.7</coordinates></LineString></MultiGeometry></Placemark>
<Placemark><name>dot</name><Point><coordinates>-71,-13</coordinates></Point></Placemark></Folder>
<Folder><name>Tramo Proyectado</name><Placemark><name>b</name><LineString><coordinates>-71,-13 -72,-14</coordinates></LineString></Placemark></Folder>
</Document></kml>"""


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "kml").mkdir()
    (tmp_path / "kml" / "one.kml").write_text(KML)
    with zipfile.ZipFile(tmp_path / "kml" / "two.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    rows = registry.read_registry(spark, str(tmp_path / "kml"))
    assert sorted((r.name, r.part, r.tramnomb, r.ubigeo, len(r.lon), r.category) for r in rows.collect()) == [("a", 0, "Cuesta", "0101", 2, "observado")] * 2 + [("a", 1, "Cuesta", "0101", 3, "observado")] * 2
    everything = registry.read_registry(spark, str(tmp_path / "kml"), observed_only=False)
    assert everything.count() == 6 and registry.without_excluded(everything, ["Cuesta"]).count() == 2
    assert registry.read_registry(spark, str(tmp_path / "kml"), layers=["Tramo Proyectado"]).count() == 2


def test_overpass_and_lakes(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"elements": [{"id": 1, "tags": {"natural": "water"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 10, "lat": 0}, {"lon": 10, "lat": 10}, {"lon": 0, "lat": 0}]}, {"id": 2, "geometry": [{"lon": 0, "lat": 0}]}, {"id": 3, "tags": {"natural": "water"}, "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 1}]}]}')
    elements = registry.read_overpass(spark, str(tmp_path / "o.json"))
    assert sorted(r.id for r in elements.collect()) == [1, 3]
    metres = elements.withColumn("geometry", F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    assert [(r.id, r.area_m2) for r in registry.lakes(metres, 50.0).collect()] == [(1, 50.0)] and registry.lakes(metres, 51.0).count() == 0


def test_site_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sitio,longitud,latitud\nHuaca,-71.5,-13.5\nsin lugar,,\n")
    assert [tuple(r) for r in registry.read_sites(spark, str(tmp_path / "s.csv")).collect()] == [("Huaca", -71.5, -13.5)]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        registry.read_sites(spark, str(tmp_path / "t.csv"))


def test_layers_categories_and_sites(spark):
    rows = spark.createDataFrame([("Tramos Observados", 3000.0), ("Tramo Proyectado", 1000.0), ("Tramos Observados", 4000.0)], "layer string, length double")
    assert [tuple(r) for r in registry.layer_names(rows).collect()] == [("Tramo Proyectado", "proyectado", 1), ("Tramos Observados", "observado", 2)]
    named = rows.withColumn("category", F.when(F.col("length") > 3500, "observado").when(F.col("length") > 2000, "proyectado"))
    assert sorted((r.category, r.features, r.km, r.share) for r in registry.by_category(named).collect()) == [("observado", 1, 4.0, 0.5), ("otro", 1, 1.0, 0.125), ("proyectado", 1, 3.0, 0.375)]
    sites = spark.createDataFrame([(-71.5, -13.5), (0.0, 0.0)], "lon double, lat double")
    assert tuple(registry.sites_summary(sites, (-72.0, -14.0, -71.0, -13.0)).first()) == (2, 1)
