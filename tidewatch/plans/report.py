"""The HTML report: tables and curves of one analysis, in one file without scripts."""

from __future__ import annotations

import html
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import calibration, confusion, drift, ranking
from ..sources import records
from .analysis import MonitoringAnalysis

STYLE = "body{font-family:sans-serif;margin:2rem;max-width:70rem}table{border-collapse:collapse;margin:1rem 0}td,th{border:1px solid #bbb;padding:.25rem .6rem;text-align:left}svg{border:1px solid #ddd;margin:.5rem}.critical{color:#a00}"
#: Points of a curve that are drawn.
CURVE_POINTS = 500


@dataclass(frozen=True)
class ReportArtifacts:
    html: Path
    pdf: Path | None = None
    pdf_error: Path | None = None


def _cell(v: object) -> str:
    return "n/a" if v is None else f"{v:.4g}" if isinstance(v, float) else html.escape(str(v))


def _table(df: DataFrame, empty: str = "No rows.") -> str:
    rows = df.collect()
    if not rows:
        return f"<p>{empty}</p>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def _line(points: list[tuple[float, float]], title: str, x: str, y: str) -> str:
    """A small line chart over the unit square."""
    if not points:
        return f"<p>{html.escape(title)}: no points.</p>"
    path = " ".join(f"{20 + 260 * a:.1f},{280 - 260 * b:.1f}" for a, b in points)
    return (
        f'<svg width="300" height="320" role="img" aria-label="{html.escape(title)}"><rect x="20" y="20" width="260" height="260" fill="none" stroke="#999"/>'
        f'<polyline points="{path}" fill="none" stroke="#147" stroke-width="2"/><text x="20" y="14">{html.escape(title)}</text>'
        f'<text x="120" y="305">{html.escape(x)}</text><text x="4" y="160" transform="rotate(-90 12 160)">{html.escape(y)}</text></svg>'
    )


def _bars(bars: list[tuple[str, float]], title: str) -> str:
    """A bar for each label, as long as its share of the largest value."""
    if not bars:
        return f"<p>{html.escape(title)}: no values.</p>"
    most = max(v for _, v in bars) or 1.0
    rows = "".join(
        f'<text x="4" y="{36 + 18 * i}" font-size="11">{html.escape(label[:34])}</text><rect x="230" y="{26 + 18 * i}" width="{200 * value / most:.1f}" height="13" fill="#147"/>'
        f'<text x="{236 + 200 * value / most:.1f}" y="{37 + 18 * i}" font-size="11">{value:.4g}</text>'
        for i, (label, value) in enumerate(bars)
    )
    return f'<svg width="500" height="{40 + 18 * len(bars)}" role="img" aria-label="{html.escape(title)}"><text x="4" y="14">{html.escape(title)}</text>{rows}</svg>'


def bar_charts(analysis: MonitoringAnalysis) -> str:
    """The highest sensitivities by subgroup, and the score density of each version."""
    top = [(r["label"], r["value"]) for r in confusion.top_subgroups(analysis.stratified).collect()]
    by_version: dict[str, list[tuple[str, float]]] = {}
    for r in drift.score_histogram(analysis.table).filter("bin is not null").orderBy("model_version", "bin").collect():
        by_version.setdefault(r["model_version"], []).append((f"{r['bin'] / 30:.2f} to {(r['bin'] + 1) / 30:.2f}", r["density"]))
    return _bars(top, "Highest sensitivities") + "".join(_bars(v, f"Score density, {k}") for k, v in by_version.items())


def _thinned(rows: list, n: int = CURVE_POINTS) -> list:
    step = max(1, len(rows) // n)
    return rows[::step] + rows[-1:] if rows else []


def curves(analysis: MonitoringAnalysis) -> str:
    """ROC, precision-recall, reliability and rolling AUROC. Curves are rounded on the cluster to a grid of points."""
    t = analysis.table
    grid = lambda df, a, b: [tuple(r) for r in df.selectExpr(f"round({a}, 3) a", f"round({b}, 3) b").distinct().orderBy("a", "b").collect()]
    roc = _thinned(grid(ranking.roc_points(t), "fpr", "tpr"))
    pr = _thinned(grid(ranking.pr_points(t).filter("recall is not null"), "recall", "precision"))
    rel = [(r["prob_pred"], r["prob_true"]) for r in calibration.reliability_curve(t).orderBy("bin").collect()]
    roll = [r["auroc"] for r in analysis.rolling.orderBy("window").collect() if r["auroc"] is not None]
    rolled = [(i / max(1, len(roll) - 1), v) for i, v in enumerate(roll)]
    return _line(roc, "ROC", "false positive rate", "true positive rate") + _line(pr, "Precision and recall", "recall", "precision") + _line(rel, "Reliability", "predicted", "observed") + _line(rolled, "Rolling AUROC", "time", "AUROC")


def render(analysis: MonitoringAnalysis) -> str:
    s, frames = analysis.summary_dict, analysis.frames()
    key = "".join(f"<li>{html.escape(k)}: {_cell(s[k])}</li>" for k in ("n", "start_date", "end_date", "auroc", "sensitivity", "specificity", "psi", "psi_level", "critical_alerts", "warning_alerts"))
    parts = [f"<h1>Model monitoring report</h1><ul>{key}</ul>", "<h2>Alerts</h2>" + _table(frames["alerts"], "No alerts."), curves(analysis)]
    titles = {"summary": "Summary", "drift": "Drift", "stratified": "Subgroups", "missing": "Missing data", "site_calibration": "Calibration by site", "versions": "Versions"}
    parts += [f"<h2>{title}</h2>" + _table(frames[k]) for k, title in titles.items()]
    parts += ["<h2>Subgroups and scores</h2>" + bar_charts(analysis)]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Model monitoring report</title><style>{STYLE}</style></head><body>{"".join(parts)}</body></html>'


def write(analysis: MonitoringAnalysis, folder: str | Path, name: str = "monitoring_report", pdf: bool = True, audit_log: str | Path | None = None, actor: str = "tidewatch") -> ReportArtifacts:
    """The HTML file; a PDF beside it if a PDF library is installed, else a note that says why not."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    page = folder / f"{name}.html"
    page.write_text(render(analysis), encoding="utf-8")
    made = failed = None
    if pdf:
        try:
            from weasyprint import HTML

            made = folder / f"{name}.pdf"
            HTML(string=page.read_text(encoding="utf-8")).write_pdf(str(made))
        except ImportError as why:
            made, failed = None, folder / f"{name}_pdf_error.txt"
            failed.write_text(f"No PDF was made: {why}\n", encoding="utf-8")
    if audit_log:
        records.append_event(audit_log, records.artifact_event("report_written", actor, page))
    return ReportArtifacts(page, made, failed)
