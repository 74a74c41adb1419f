"""Simulation and accuracy reports as Markdown, HTML and JSON."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from html import escape
from pathlib import Path

from ..plans.simulate import Result
from . import charts


def number(value, places: int = 4) -> str:
    """A cell's text: '-' for nothing, whole thousands grouped, else fixed places."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    if isinstance(value, int) or abs(value) >= 100:
        return f"{value:,.0f}"
    return f"{value:.{places}f}"


def table(rows: Sequence[Mapping], columns: Sequence[str] | None = None) -> str:
    """A Markdown table; bars in cells are escaped."""
    if not rows:
        return "(none)\n"
    columns = list(columns or rows[0])
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |\n"
    return line(columns) + line("---" for _ in columns) + "".join(line(number(r.get(c)) for c in columns) for r in rows)


def html_table(rows: Sequence[Mapping]) -> str:
    if not rows:
        return "<p>(none)</p>"
    head = "".join(f"<th>{escape(c)}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(number(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def day(at: datetime | None = None) -> str:
    """The date of a report, UTC; today's unless given."""
    return (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%d")


def _provenance(result: Result) -> list[dict]:
    record = result.record()
    return [{"item": k, "value": record[k]} for k in ("name", "seed", "spec", "population", "key")] + [{"item": k, "value": v} for k, v in record["cost"].items()]


def _sections(result: Result) -> list[tuple[str, list[dict]]]:
    return [("Answers", result.rows), ("Contrasts", result.contrasts), ("Fit of the population", result.fidelity), ("Provenance", _provenance(result))]


def markdown(result: Result, at: datetime | None = None) -> str:
    parts = [f"# {result.spec.name}\n", f"{day(at)}\n"]
    parts += [f"**{arm}**: {text}\n" for arm, text in result.spec.scenario.questions().items()]
    parts += [f"## {title}\n\n{table(rows)}" for title, rows in _sections(result) if rows]
    return "\n".join(parts)


def html(result: Result, at: datetime | None = None) -> str:
    options = result.spec.scenario.options
    arms = list(result.spec.scenario.questions())
    bars = [(arm, [result.share(o, arm) for o in options]) for arm in arms]
    drawn = [charts.legend(options), charts.stacked_bar(bars, options)]
    drawn.append(charts.interval_plot([(f"{r['arm']}: {r['option']}", r["share"], r["low"], r["high"]) for r in result.rows]))
    if result.contrasts:
        reach = max(0.05, *(max(abs(r["low"]), abs(r["high"])) for r in result.contrasts))
        drawn.append(charts.interval_plot([(f"{r['arm']}: {r['option']}", r["difference"], r["low"], r["high"]) for r in result.contrasts], low=-reach, high=reach))
    asked = "".join(f"<p><b>{escape(a)}</b>: {escape(t)}</p>" for a, t in result.spec.scenario.questions().items())
    tables = "".join(f"<h2>{escape(t)}</h2>{html_table(rows)}" for t, rows in _sections(result) if rows)
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(result.spec.name)}</title><body><h1>{escape(result.spec.name)}</h1><p>{day(at)}</p>{asked}{"".join(drawn)}{tables}</body></html>'


def publish(result: Result, folder: str | Path | None = None) -> list[Path]:
    """Writes the formats that the spec asks for; returns the files."""
    folder = Path(folder or result.spec.output.dir)
    folder.mkdir(parents=True, exist_ok=True)
    makers = {"json": ("run.json", Result.to_json), "markdown": ("report.md", markdown), "html": ("report.html", html)}
    files = []
    for kind in result.spec.output.formats:
        name, make = makers[kind]
        files.append(folder / name)
        files[-1].write_text(make(result), encoding="utf-8")
    return files


def accuracy(board: Sequence[Mapping], gaps: Sequence[Mapping] = (), worst: Sequence[Mapping] = (), at: datetime | None = None) -> str:
    """The accuracy report: engines best first, wording experiments by size of their gap, the worst questions."""
    columns = [c for c in ("engine", "questions", "mae", "skill_mae", "total_variation", "brier", "ece", "interval_coverage", "gap_mae", "gap_sign", "gap_correlation", "calls") if board and c in board[0]]
    parts = ["# Accuracy\n", f"{day(at)}\n", table(sorted(board, key=lambda r: (r["mae"], r["engine"])), columns)]
    if gaps:
        parts += ["## Wording experiments\n", table(sorted(gaps, key=lambda r: (-abs(r["gap_t"]), r["id"])))]
    if worst:
        parts += ["## Worst questions\n", table(worst)]
    return "\n".join(parts)
