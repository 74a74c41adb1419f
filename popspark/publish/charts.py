"""Small SVG charts of tens of rows."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

COLOURS = ("#2f6f9f", "#d98032", "#4f9d69", "#b34d5c", "#7a68a6", "#8a7a5c", "#c77bb0", "#6f7f8f")


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" aria-label="{escape(title, quote=True)}" font-family="sans-serif" font-size="12">{"".join(body)}</svg>'


def _text(x: float, y: float, words: str, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(words)}</text>'


def _box(x: float, y: float, w: float, h: float, colour: str) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0):.1f}" height="{h:.1f}" fill="{colour}"/>'


def legend(options: Sequence[str], width: int = 640) -> str:
    step = width / max(1, len(options))
    marks = [_box(i * step, 4, 12, 12, COLOURS[i % len(COLOURS)]) + _text(i * step + 18, 14, o) for i, o in enumerate(options)]
    return _svg(width, 20, "legend", marks)


def stacked_bar(rows: Sequence[tuple[str, Sequence[float]]], options: Sequence[str], width: int = 640) -> str:
    """A bar a row (label, shares in the order of options)."""
    left, bar = 120, 22
    body = []
    for i, (label, shares) in enumerate(rows):
        x, y = float(left), 6 + i * (bar + 8)
        body.append(_text(left - 8, y + 15, label, "end"))
        for j, share in enumerate(shares):
            w = share * (width - left - 10)
            body.append(_box(x, y, w, bar, COLOURS[j % len(COLOURS)]))
            if w > 34:
                body.append(f'<g fill="#fff">{_text(x + w / 2, y + 15, f"{share:.0%}", "middle")}</g>')
            x += w
    return _svg(width, 12 + len(rows) * (bar + 8), "shares: " + ", ".join(options), body)


def interval_plot(rows: Sequence[tuple[str, float, float, float]], width: int = 640, low: float = 0.0, high: float = 1.0) -> str:
    """A line a row (label, value, low, high) on one axis; values outside it sit at its ends."""
    left, step = 200, 26
    place = lambda v: left + (min(max(v, low), high) - low) / ((high - low) or 1) * (width - left - 20)
    body = []
    if low < 0 < high:
        body.append(f'<line x1="{place(0):.1f}" x2="{place(0):.1f}" y1="0" y2="{len(rows) * step + 8}" stroke="#bbb" stroke-dasharray="3 3"/>')
    for i, (label, value, a, b) in enumerate(rows):
        y = 16 + i * step
        body.append(_text(left - 8, y + 4, label, "end"))
        body.append(f'<line x1="{place(a):.1f}" x2="{place(b):.1f}" y1="{y}" y2="{y}" stroke="{COLOURS[0]}" stroke-width="3"/>')
        body.append(f'<circle cx="{place(value):.1f}" cy="{y}" r="4.5" fill="{COLOURS[0]}"/>')
    body += [_text(left, len(rows) * step + 22, f"{low:g}"), _text(width - 20, len(rows) * step + 22, f"{high:g}", "end")]
    return _svg(width, len(rows) * step + 30, "intervals", body)
