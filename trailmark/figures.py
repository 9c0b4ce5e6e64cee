"""Figures of results as SVG text: a profile over tau, and dominant components by position. Rows are few; they come from the driver."""

from __future__ import annotations

from html import escape

#: Colours that are told apart by most readers, in order.
COLOURS = ["#0072b2", "#d55e00", "#009e73", "#cc79a7", "#e69f00", "#56b4e9", "#f0e442", "#000000"]
_W, _H, _LEFT, _RIGHT, _TOP, _LOW = 760, 420, 60, 190, 50, 50


def _frame(title: str, body: list[str], x_label: str, y_label: str) -> str:
    axes = [f'<line x1="{_LEFT}" y1="{_H - _LOW}" x2="{_W - _RIGHT}" y2="{_H - _LOW}" stroke="#444"/>', f'<line x1="{_LEFT}" y1="{_TOP}" x2="{_LEFT}" y2="{_H - _LOW}" stroke="#444"/>']
    text = [f'<text x="{_LEFT}" y="28" font-size="16">{escape(title)}</text>', f'<text x="{(_LEFT + _W - _RIGHT) / 2}" y="{_H - 12}" text-anchor="middle">{escape(x_label)}</text>', f'<text x="16" y="{_H / 2}" transform="rotate(-90 16 {_H / 2})" text-anchor="middle">{escape(y_label)}</text>']
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{_W}" height="{_H}" font-family="sans-serif" font-size="12">', f'<rect width="{_W}" height="{_H}" fill="white"/>', *axes, *text, *body, "</svg>"])


def _x(v: float, low: float, high: float) -> float:
    return _LEFT + (v - low) / ((high - low) or 1) * (_W - _RIGHT - _LEFT)


def _y(v: float) -> float:
    return _H - _LOW - v * (_H - _LOW - _TOP)


def jaccard_figure(rows: list[dict], title: str = "Overlap of near-optimal weights") -> str:
    """Lines of rows (unit_a, unit_b, tau, jaccard); the legend begins with the pair that overlaps most at the end."""
    pairs: dict[tuple, list[tuple[float, float]]] = {}
    for r in sorted(rows, key=lambda r: r["tau"]):
        if r["jaccard"] is not None:
            pairs.setdefault((r["unit_a"], r["unit_b"]), []).append((r["tau"], r["jaccard"]))
    taus = [t for p in pairs.values() for t, _ in p] or [0.0]
    body = [f'<line x1="{_LEFT}" x2="{_W - _RIGHT}" y1="{_y(v)}" y2="{_y(v)}" stroke="#ddd"/><text x="{_LEFT - 8}" y="{_y(v) + 4}" text-anchor="end">{v:g}</text>' for v in (0, 0.25, 0.5, 0.75, 1)]
    ordered = sorted(pairs.items(), key=lambda kv: (-max(j for _, j in kv[1][-3:]), str(kv[0])))
    for k, ((a, b), points) in enumerate(ordered):
        colour = COLOURS[k % len(COLOURS)]
        body.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{_x(t, min(taus), max(taus)):.1f},{_y(j):.1f}" for t, j in points)}"/>')
        body.append(f'<text x="{_W - _RIGHT + 12}" y="{_TOP + 16 * k + 12}" fill="{colour}">{escape(f"{a} / {b}")}</text>')
    return _frame(title, body, "tau", "Jaccard index")


def sections_figure(rows: list[dict], unstable: bool) -> str:
    """A band for each way to cut a line, in rows (cut, start, stop, dominant), coloured by the dominant component; the title says what the
    rows show."""
    names = sorted({r["dominant"] for r in rows})
    cuts = sorted({r["cut"] for r in rows})
    height = (_H - _LOW - _TOP) / max(len(cuts), 1)
    body = []
    for r in rows:
        x0, x1, y = _x(r["start"], 0, 1), _x(r["stop"], 0, 1), _TOP + cuts.index(r["cut"]) * height
        body.append(f'<rect x="{x0:.1f}" y="{y + 4:.1f}" width="{x1 - x0:.1f}" height="{height - 8:.1f}" fill="{COLOURS[names.index(r["dominant"]) % len(COLOURS)]}" stroke="white"/>')
    body += [f'<text x="{_LEFT - 8}" y="{_TOP + (k + 0.5) * height + 4:.1f}" text-anchor="end">{c}</text>' for k, c in enumerate(cuts)]
    body += [f'<text x="{_W - _RIGHT + 12}" y="{_TOP + 16 * k + 12}" fill="{COLOURS[k % len(COLOURS)]}">{escape(str(n))}</text>' for k, n in enumerate(names)]
    return _frame("What dominates depends on where the line is cut" if unstable else "What dominates holds wherever the line is cut", body, "position along the line", "parts")
