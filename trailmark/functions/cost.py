"""Cost and terrain scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polynomial of the metabolic cost of walking (J/kg/m) over the slope, highest power first; walking speed on the flat.
MINETTI = [280.5, -58.7, -76.8, 51.9, 19.6, 2.5]
TOBLER_SPEED, TOBLER_DECAY, TOBLER_SHIFT = 1.662, 3.5, 0.05
G_MAX = 0.45


def minetti(g: Column) -> Column:
    out = F.lit(MINETTI[0])
    for c in MINETTI[1:]:
        out = out * g + F.lit(c)
    return out


def slope_cost(g: Column, g_max: float = G_MAX) -> Column:
    """Relative to the flat; null beyond g_max."""
    return F.when(F.abs(g) <= g_max, minetti(g) / MINETTI[-1])


def tobler(g: Column) -> Column:
    return F.lit(TOBLER_SPEED) * F.exp(-TOBLER_DECAY * F.abs(g + TOBLER_SHIFT))


def tobler_cost(g: Column) -> Column:
    return tobler(F.lit(0.0)) / tobler(g)


def wetness(area: Column, slope: Column) -> Column:
    """Topographic wetness of a specific catchment area."""
    return F.log(F.greatest(area, F.lit(1e-6)) / (F.tan(slope) + 1e-3))


def drainage_cost(cells: Column) -> Column:
    return F.log10(1 + F.greatest(cells, F.lit(0.0)))


def visibility_cost(fraction: Column) -> Column:
    return 1 - F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))


def graph_gigabytes(cells: Column, components: int, passable: float = 0.35, edges_per_node: float = 12.9) -> Column:
    """Memory of the cost graph in 64-bit numbers."""
    return cells * passable * edges_per_node * (8 * components + 12) / float(1 << 30)
