"""Registries and maps behind web services: what to ask, how to read the answers. Requests go through one function, so that all of this
works over saved answers as well; nothing here runs on executors."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

from .registry import _local

#: Statuses that may pass, the versions of a feature service in order, the names of its limit, formats of its answers in order.
PASSING = (408, 429, 500, 502, 503, 504)
MAP_PASSING = (406, 429, 500, 502, 503, 504)
VERSIONS = ("2.0.0", "1.1.0", "1.0.0")
LIMITS = {"2.0.0": "count", "1.1.0": "maxFeatures", "1.0.0": "maxFeatures"}
JSON_FORMATS = ("application/json", "json", "application/geo+json", "text/json")
PAGE = 1000
#: Servers of the open map's queries.
MIRRORS = ("https://overpass-api.de/api/interpreter", "https://overpass.kumi.systems/api/interpreter")
#: Kinds of services that hold layers, and where directories of services lie on a host.
LAYERED = ("MapServer", "FeatureServer")
DIRECTORIES = ("server/rest/services", "arcgis/rest/services", "rest/services", "geocam/rest/services", "gis/rest/services")
#: Elevation models, and where they are asked for.
ELEVATION = "https://portal.opentopography.org/API/globaldem"
ELEVATION_TILES = "https://copernicus-dem-30m.s3.amazonaws.com"
#: Words of a layer's name that speak for and against it.
SPEAKS_FOR = {"qhapaq": 10, "qapaq": 10, "capac": 8, "nan": 6, "ñan": 8, "camino": 8, "inca": 6, "inka": 6, "vial": 5, "tramo": 4, "red": 2, "arqueo": 3, "monument": 2, "patrimon": 2, "sitio": 1}
SPEAKS_AGAINST = {"limite": -4, "distrito": -4, "provincia": -4, "departamento": -4, "catastro": -3, "predio": -3, "curva": -3, "hidro": -2, "centro_poblado": -3, "via_nacional": -2, "red_vial_nacional": -3}

Answer = tuple[int, str]  # status and text; status 0 without an answer
Fetch = Callable[..., Answer]


def over_http(url: str, params: dict | None = None, data: dict | None = None, timeout: float = 60) -> Answer:
    """GET, or POST where there are data."""
    query = f"?{urllib.parse.urlencode(params)}" if params else ""
    request = urllib.request.Request(url + query, urllib.parse.urlencode(data).encode() if data else None, {"User-Agent": "Mozilla/5.0", "Accept": "application/json, text/xml;q=0.9, */*;q=0.8"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        return 0, str(e)


def fault(answer: Answer) -> str:
    """One line on an answer that is of no use."""
    status, text = answer
    return f"no answer: {text[:80]}" if not status else f"status {status}: {' '.join(text.split())[:80]}"


def asked(fetch: Fetch, url: str, params: dict | None = None, tries: int = 3, wait: float = 2.0, log: list[str] | None = None, passing: tuple[int, ...] = PASSING) -> Answer:
    """The answer, asked for again after a growing pause while the fault may pass. Faults are added to log."""
    answer: Answer = (0, "")
    for k in range(max(1, tries)):
        answer = fetch(url, params)
        if answer[0] and answer[0] not in passing:
            break
        if k + 1 < tries:
            time.sleep(wait * (k + 1))
    if answer[0] != 200 and log is not None:
        log.append(fault(answer))
    return answer


# ---------------------------------------------------------------- feature services


def capabilities_query(version: str = VERSIONS[0], layers_only: bool = False) -> dict:
    """layers_only asks for the list of layers alone, which newer versions can give."""
    only = {"sections": "FeatureTypeList"} if layers_only and version.startswith("2") else {}
    return {"service": "WFS", "version": version, "request": "GetCapabilities"} | only


def feature_query(layer: str, version: str = VERSIONS[0], form: str | None = None, srs: str | None = None, limit: int | None = None) -> dict:
    """Whole layers are asked for, without a box, as versions disagree on the order of its axes."""
    out = {"service": "WFS", "version": version, "request": "GetFeature", "typeNames" if version.startswith("2") else "typeName": layer}
    more = {"outputFormat": form, "srsName": srs, LIMITS.get(version, "count"): limit}
    return out | {k: v for k, v in more.items() if v}


def _elements(text: str, tag: str) -> Iterator[ElementTree.Element]:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return
    yield from (e for e in root.iter() if _local(e.tag) == tag)


def _child(e: ElementTree.Element, *tags: str) -> str:
    return next(((c.text or "").strip() for c in e if _local(c.tag) in tags and (c.text or "").strip()), "")


def layers_of(capabilities: str) -> list[dict[str, str]]:
    """name, title, abstract and crs of each layer."""
    rows = ({"name": _child(e, "Name"), "title": _child(e, "Title"), "abstract": _child(e, "Abstract"), "crs": _child(e, "DefaultCRS", "DefaultSRS", "SRS")} for e in _elements(capabilities, "FeatureType"))
    return [r | {"title": r["title"] or r["name"]} for r in rows if r["name"]]


def formats_of(capabilities: str) -> list[str]:
    """Formats that the service can answer in."""
    return [v.text.strip() for p in _elements(capabilities, "Parameter") if p.get("name") == "outputFormat" for v in p.iter() if _local(v.tag) == "Value" and v.text]


def json_format(formats: list[str]) -> str | None:
    """The format to ask for: the first of JSON_FORMATS that there is, else one with json in its name."""
    rank = lambda f: JSON_FORMATS.index(f.lower()) if f.lower() in JSON_FORMATS else len(JSON_FORMATS)
    return min((f for f in formats if "json" in f.lower()), key=rank, default=None)


def capabilities(base: str, fetch: Fetch = over_http, log: list[str] | None = None) -> tuple[str, str] | None:
    """(version, answer) of the first version that the service answers with layers."""
    for version in VERSIONS:
        for only in (True, False) if version.startswith("2") else (False,):
            answer = asked(fetch, base, capabilities_query(version, only), 1, 0, log)
            if answer[0] == 200 and layers_of(answer[1]):
                return version, answer[1]
    return None


def first_service(addresses: list[str], fetch: Fetch = over_http, rounds: int = 2, wait: float = 5.0, log: list[str] | None = None) -> tuple[str, str, str] | None:
    """(address, version, answer) of the first address that answers with layers; all are tried again after a pause."""
    for k in range(max(1, rounds)):
        for base in addresses:
            found = capabilities(base, fetch, log if k == 0 else None)
            if found:
                return base, *found
        if k + 1 < rounds:
            time.sleep(wait)
    return None


def layer_text(base: str, layer: str, version: str, form: str | None, fetch: Fetch = over_http, limit: int | None = None) -> str:
    """A layer's features as the service writes them; an error report is an error."""
    status, text = asked(fetch, base, feature_query(layer, version, form, limit=limit), 4)
    if status != 200 or (text.lstrip().startswith("<") and "ExceptionReport" in text[:2000]):
        raise RuntimeError(f"{layer}: {fault((status, text))}")
    return text


def layer_score(name: str, geometry: str | None = None) -> int:
    """How much a layer's name and geometry speak for its being the road: lines do, areas don't."""
    plain = "".join(c if c.isalpha() and (c.isascii() or c == "ñ") else " " for c in str(name).lower())
    words = " ".join(plain.split())
    score = sum(w for k, w in (SPEAKS_FOR | SPEAKS_AGAINST).items() if k in words)
    kind = str(geometry or "").lower()
    return score + (4 if "line" in kind else 1 if "point" in kind else -1 if "polygon" in kind else 0)


def scored_layers(capabilities: str) -> list[dict]:
    """Layers of a feature service, the likeliest first."""
    rows = [r | {"score": layer_score(f"{r['name']} {r['title']}")} for r in layers_of(capabilities)]
    return sorted(rows, key=lambda r: (-r["score"], r["name"]))


# ---------------------------------------------------------------- paged services


def page_query(box: tuple[float, float, float, float], offset: int = 0, page: int = PAGE) -> dict:
    """Features that meet a box, a page of them from offset on."""
    return {"where": "1=1", "geometry": ",".join(map(str, box)), "geometryType": "esriGeometryEnvelope", "inSR": 4326, "spatialRel": "esriSpatialRelIntersects", "outFields": "*", "returnGeometry": "true", "f": "geojson", "resultOffset": offset, "resultRecordCount": page}


def paged_features(service: str, box: tuple[float, float, float, float], fetch: Fetch = over_http, page: int = PAGE) -> Iterator[dict]:
    """All features, page after page, until one isn't full."""
    offset = 0
    while True:
        status, text = asked(fetch, f"{service}/query", page_query(box, offset, page))
        if status != 200:
            raise RuntimeError(f"{service}: {fault((status, text))}")
        features = json.loads(text).get("features") or []
        yield from features
        if len(features) < page:
            return
        offset += page


def _described(fetch: Fetch, url: str) -> dict | None:
    status, text = fetch(url, {"f": "json"})
    try:
        out = json.loads(text) if status == 200 else None
    except ValueError:
        return None
    return out if isinstance(out, dict) and "error" not in out else None


def directories(hosts: list[str]) -> list[str]:
    return [f"https://{h}/{d}" for h in hosts for d in DIRECTORIES]


def services_in(root: str, fetch: Fetch = over_http, most_folders: int = 40) -> list[dict[str, str]]:
    """url, name and kind of the layered services of a directory and its folders; none where it doesn't answer."""
    top = _described(fetch, root)
    pages = [] if top is None else [top, *(_described(fetch, f"{root}/{f}") for f in (top.get("folders") or [])[:most_folders])]
    found = [s for p in pages if p for s in p.get("services") or [] if s.get("type") in LAYERED]
    return [{"url": f"{root}/{s.get('name', '')}/{s['type']}", "name": str(s.get("name", "")).rpartition("/")[2], "kind": s["type"]} for s in found]


def service_layers(service: dict[str, str], fetch: Fetch = over_http) -> list[dict]:
    """Layers of a service with their score; groups of layers aren't layers."""
    page = _described(fetch, service["url"]) or {}
    rows = [x for x in page.get("layers") or [] if not x.get("subLayerIds")]
    return [{"url": f"{service['url']}/{x.get('id')}", "service": service["name"], "layer": str(x.get("name", "")), "geometry": str(x.get("geometryType") or "?").removeprefix("esriGeometry"), "score": layer_score(f"{service['name']} {x.get('name', '')}", x.get("geometryType"))} for x in rows]


def candidates(hosts: list[str], fetch: Fetch = over_http, limit: int = 12) -> list[dict]:
    """The likeliest layers of the first directory that answers with some."""
    for root in directories(hosts):
        rows = [x for s in services_in(root, fetch) for x in service_layers(s, fetch)]
        if rows:
            return sorted(rows, key=lambda r: (-r["score"], r["url"]))[:limit]
    return []


# ---------------------------------------------------------------- open maps


def map_box(box: tuple[float, float, float, float]) -> str:
    """South, west, north, east."""
    west, south, east, north = box
    return f"{south},{west},{north},{east}"


def _map_query(selectors: list[str], box: tuple[float, float, float, float]) -> str:
    return f"[out:json][timeout:180];({' '.join(f'{s}({map_box(box)});' for s in selectors)});out geom;"


def water_query(box: tuple[float, float, float, float]) -> str:
    """Rivers, streams and standing water."""
    return _map_query(['way["waterway"="river"]', 'way["waterway"="stream"]', 'way["natural"="water"]', 'relation["natural"="water"]'], box)


def road_query(box: tuple[float, float, float, float]) -> str:
    """Ways that may be the old road: historic ones, hiking routes, and those with its names."""
    return _map_query(['way["historic"]', 'way["name"~"[Ii]nca|[Qq]hapaq|[Cc]amino|[Ññ]an"]', 'relation["route"="hiking"]', 'way["highway"="path"]["name"~"[Ii]nca|[Qq]hapaq"]'], box)


def map_answer(query: str, mirrors: list[str], fetch: Fetch = over_http, rounds: int = 2, wait: float = 5.0) -> dict:
    """The answer of the first mirror that gives one; a fault that won't pass ends a round."""
    faults = []
    for k in range(max(1, rounds)):
        for url in mirrors:
            status, text = fetch(url, None, {"data": query})
            if status == 200:
                try:
                    return json.loads(text)
                except ValueError:
                    faults.append(f"{url}: no JSON")
                    continue
            faults.append(f"{url}: {fault((status, text))}")
            if status and status not in MAP_PASSING:
                break
        if k + 1 < rounds:
            time.sleep(wait)
    raise RuntimeError("no mirror answered: " + "; ".join(faults[-6:]))


def map_features(answer: dict) -> list[dict]:
    """GeoJSON lines of an answer's elements of two places or more, named by their tags."""
    out = []
    for e in answer.get("elements") or []:
        line = [[p["lon"], p["lat"]] for p in e.get("geometry") or [] if p]
        if len(line) > 1:
            tags = e.get("tags") or {}
            out.append({"type": "Feature", "properties": tags | {"id": str(e.get("id")), "source": "osm"}, "geometry": {"type": "LineString", "coordinates": line}})
    return out


# ---------------------------------------------------------------- elevation


def elevation_query(box: tuple[float, float, float, float], model: str, key: str) -> tuple[str, dict]:
    west, south, east, north = box
    return ELEVATION, {"demtype": model, "south": south, "north": north, "west": west, "east": east, "outputFormat": "GTiff", "API_Key": key}


def elevation_tiles(box: tuple[float, float, float, float]) -> list[str]:
    """Names of the tiles of a degree that cover a box, after their south-western corners."""
    west, south, east, north = map(math.floor, box)
    side = lambda v, plus, minus, n: f"{plus if v >= 0 else minus}{abs(v):0{n}d}"
    return [f"Copernicus_DSM_COG_10_{side(lat, 'N', 'S', 2)}_00_{side(lon, 'E', 'W', 3)}_00_DEM" for lat in range(south, north + 1) for lon in range(west, east + 1)]


def tile_address(name: str) -> str:
    return f"{ELEVATION_TILES}/{name}/{name}.tif"


def covers(have: tuple[float, float, float, float], want: tuple[float, float, float, float], margin: float = 0.005) -> bool:
    """Whether one box covers another, but for a margin: a raster of a smaller box must be fetched again."""
    return have[0] <= want[0] + margin and have[1] <= want[1] + margin and have[2] >= want[2] - margin and have[3] >= want[3] - margin


def saved(url: str, to: str | Path, params: dict | None = None, again: bool = False, fetch: Fetch = over_http) -> Path:
    """The answer as a file, which is there whole or not at all; one that is there stays, unless again."""
    to = Path(to)
    if again or not to.exists() or not to.stat().st_size:
        status, text = asked(fetch, url, params)
        if status != 200:
            raise RuntimeError(f"{url}: {fault((status, text))}")
        part = to.with_suffix(to.suffix + ".part")
        part.write_text(text, encoding="utf-8")
        part.replace(to)
    return to
