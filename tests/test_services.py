"""Web services over saved answers."""

import json

import pytest

from trailmark.sources import services

BOX = (-72.0, -14.0, -71.0, -13.0)
CAPABILITIES = """<wfs:WFS_Capabilities xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:ows="http://www.opengis.net/ows/1.1">
<ows:Operation name="GetFeature"><ows:Parameter name="outputFormat"><ows:AllowedValues><ows:Value>text/xml</ows:Value><ows:Value>application/json; subtype=geojson</ows:Value><ows:Value>application/json</ows:Value></ows:AllowedValues></ows:Parameter></ows:Operation>
<wfs:FeatureTypeList><wfs:FeatureType><wfs:Name>c:limites</wfs:Name><wfs:DefaultCRS>urn:4326</wfs:DefaultCRS></wfs:FeatureType>
<wfs:FeatureType><wfs:Name>c:qhapaq_nan</wfs:Name><wfs:Title>Camino Inca</wfs:Title></wfs:FeatureType><wfs:FeatureType/></wfs:FeatureTypeList></wfs:WFS_Capabilities>"""


def test_capabilities():
    rows = services.layers_of(CAPABILITIES)
    assert [r["title"] for r in rows] == ["c:limites", "Camino Inca"] and rows[0]["crs"] == "urn:4326" and services.layers_of("<a") == []
    assert services.formats_of(CAPABILITIES)[0] == "text/xml" and services.json_format(services.formats_of(CAPABILITIES)) == "application/json"
    assert services.json_format(["a/x+json"]) == "a/x+json" and services.json_format(["text/xml"]) is None
    assert services.scored_layers(CAPABILITIES)[0]["name"] == "c:qhapaq_nan"
    assert services.layer_score("Red vial", "esriGeometryPolyline") == 2 + 5 + 4 and services.layer_score("Limite distrito", "polygon") == -9


def test_queries():
    assert services.capabilities_query("2.0.0", True)["sections"] == "FeatureTypeList" and "sections" not in services.capabilities_query("1.1.0", True)
    q = services.feature_query("a", "1.1.0", "json", limit=5)
    assert q["typeName"] == "a" and q["maxFeatures"] == 5 and "bbox" not in q and services.feature_query("a")["typeNames"] == "a"
    assert services.page_query(BOX, 1000)["resultOffset"] == 1000 and services.page_query(BOX)["geometry"] == "-72.0,-14.0,-71.0,-13.0"
    assert services.map_box(BOX) == "-14.0,-72.0,-13.0,-71.0" and '"natural"="water"' in services.water_query(BOX) and services.road_query(BOX).endswith("out geom;")
    assert services.elevation_tiles((-72.5, -13.5, -71.5, -13.1)) == ["Copernicus_DSM_COG_10_S14_00_W073_00_DEM", "Copernicus_DSM_COG_10_S14_00_W072_00_DEM"]
    assert services.tile_address("x").endswith("/x/x.tif") and services.elevation_query(BOX, "COP30", "k")[1]["API_Key"] == "k"
    assert services.covers(BOX, (-71.9, -13.9, -71.1, -13.1)) and not services.covers(BOX, (-72.5, -13.9, -71.1, -13.1))


def test_first_service_that_answers():
    asked = []

    def fetch(url, params=None, data=None):
        asked.append((url, params["version"]))
        return (200, CAPABILITIES) if url == "b" and params["version"] == "1.1.0" else (500, "proxy")

    log: list[str] = []
    assert services.first_service(["a", "b"], fetch, wait=0, log=log)[:2] == ("b", "1.1.0") and ("b", "1.0.0") not in asked
    assert "status 500: proxy" in log and services.first_service(["a"], fetch, wait=0) is None
    answers = iter([(503, ""), (200, "x")])
    assert services.asked(lambda *a: next(answers), "u", wait=0) == (200, "x")
    assert services.asked(lambda *a: (404, "no"), "u", wait=0) == (404, "no")
    with pytest.raises(RuntimeError):
        services.layer_text("b", "l", "2.0.0", None, lambda *a: (200, "<ExceptionReport/>"))


def test_pages_and_directories():
    features = [{"id": i} for i in range(25)]
    fetch = lambda url, params=None, data=None: (200, json.dumps({"features": features[params["resultOffset"] :][: params["resultRecordCount"]]}))
    assert [f["id"] for f in services.paged_features("s", BOX, fetch, 10)] == list(range(25)) and len(list(services.paged_features("s", BOX, fetch, 25))) == 25
    pages = {
        "https://h/arcgis/rest/services": {"folders": ["f"], "services": [{"name": "base", "type": "ImageServer"}]},
        "https://h/arcgis/rest/services/f": {"services": [{"name": "f/camino", "type": "MapServer"}]},
        "https://h/arcgis/rest/services/f/camino/MapServer": {"layers": [{"id": 0, "name": "group", "subLayerIds": [1]}, {"id": 1, "name": "qhapaq", "geometryType": "esriGeometryPolyline"}, {"id": 2, "name": "distrito", "geometryType": "esriGeometryPolygon"}]},
    }
    found = services.candidates(["h"], lambda url, params=None, data=None: (200, json.dumps(pages.get(url, {"error": 1}))))
    assert [r["layer"] for r in found] == ["qhapaq", "distrito"] and found[0]["url"].endswith("/1") and found[0]["geometry"] == "Polyline"


def test_mirrors_and_files(tmp_path):
    answers = {"m1": (504, ""), "m2": (200, "no json"), "m3": (200, '{"elements": []}')}
    assert services.map_answer("q", list(answers), lambda url, params, data: answers[url]) == {"elements": []}
    with pytest.raises(RuntimeError, match="no mirror"):
        services.map_answer("q", ["m1"], lambda url, params, data: answers[url], wait=0)
    calls = []
    fetch = lambda url, params=None: calls.append(url) or (200, "body")
    for again in (False, False, True):
        assert services.saved("u", tmp_path / "f.txt", again=again, fetch=fetch).read_text() == "body"
    assert len(calls) == 2 and not list(tmp_path.glob("*.part"))


def test_map_features():
    answer = {"elements": [{"id": 1, "tags": {"name": "x"}, "geometry": [{"lon": 1, "lat": 2}, None, {"lon": 3, "lat": 4}]}, {"id": 2, "geometry": [{"lon": 1, "lat": 2}]}, {"id": 3}]}
    (one,) = services.map_features(answer)
    assert one["geometry"]["coordinates"] == [[1, 2], [3, 4]] and one["properties"]["name"] == "x"
