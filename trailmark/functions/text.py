"""Registry and search text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(s: Column) -> Column:
    """Lower case, trimmed, without Spanish accents."""
    return F.lower(F.trim(F.translate(F.coalesce(s, F.lit("")), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")))


def html_attributes(html: Column) -> Column:
    """Map of the key and value cells of an HTML table."""
    cell = r"(?is)<td[^>]*>\s*([^<]*?)\s*</td>\s*<td[^>]*>\s*([^<]*?)\s*</td>"
    keys, values = F.regexp_extract_all(html, F.lit(cell), F.lit(1)), F.regexp_extract_all(html, F.lit(cell), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


def category(name: Column) -> Column:
    """observado, proyectado or otro, by the layer's folded name."""
    n = folded(name)
    return F.when(n.contains("proyectad"), "proyectado").when(n.contains("observad") | n.contains("registrad"), "observado").otherwise("otro")


def plain_words(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-zñ]+", " ")


def keyword_score(name: Column, weights: dict[str, int], geometry: Column | None = None) -> Column:
    """Sum of the weights of the keywords in the name, with a bonus for lines."""
    text = plain_words(name)
    score = sum((F.when(text.contains(k), w).otherwise(0) for k, w in weights.items()), F.lit(0))
    if geometry is not None:
        g = F.lower(geometry)
        score = score + F.when(g.contains("line"), 4).when(g.contains("point"), 1).when(g.contains("polygon"), -1).otherwise(0)
    return score
