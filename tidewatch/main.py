"""Command line: ``python -m tidewatch.main COMMAND``, or by spark-submit."""

from __future__ import annotations

import argparse
import http.server
import json
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import analysis, report
from .session import local_session
from .sources import adapters, records, synthetic, tables


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or local_session()


def _analysis(a: argparse.Namespace) -> analysis.MonitoringAnalysis:
    plan = records.load_plan(a.monitoring_plan) if a.monitoring_plan else None
    reviews = records.load_reviews(a.alert_reviews) if a.alert_reviews else ()
    df = tables.load(_session(), a.csv, a.schema_profile)
    return analysis.run(df, plan=plan, reviews=reviews, validated=True)


def _print_summary(found: analysis.MonitoringAnalysis) -> None:
    for r in found.summary:
        bounds = "" if r["ci_lower"] is None else f" ({r['ci_lower']:.4f} to {r['ci_upper']:.4f})"
        print(f"{r['metric']:<28}{'n/a' if r['estimate'] is None else format(r['estimate'], '.4f')}{bounds}")


def demo(a: argparse.Namespace) -> None:
    out = Path(a.output)
    out.mkdir(parents=True, exist_ok=True)
    df = synthetic.monitoring_table(_session(), a.n, a.seed)
    tables.write_small_csv(df, out / "synthetic_monitoring_data.csv")
    found = analysis.run(tables.load(_session(), str(out / "synthetic_monitoring_data.csv")), validated=True)
    analysis.write_outputs(found, out)
    print(report.write(found, out, pdf=a.pdf).html)


def compute(a: argparse.Namespace) -> None:
    found = _analysis(a)
    paths = analysis.write_outputs(found, a.output, a.audit_log)
    _print_summary(found)
    print(*paths.values(), sep="\n")


def compute_multiclass(a: argparse.Namespace) -> None:
    found = analysis.run_multiclass(tables.read_csv(_session(), a.csv), a.schema_profile)
    print(*analysis.write_multiclass(found, a.output, a.audit_log).values(), sep="\n")


def make_report(a: argparse.Namespace) -> None:
    print(report.write(_analysis(a), a.output, pdf=a.pdf, audit_log=a.audit_log).html)


def serve(a: argparse.Namespace) -> None:
    """Serves a folder of reports on this machine."""
    handler = partial(http.server.SimpleHTTPRequestHandler, directory=a.output)
    http.server.ThreadingHTTPServer((a.host, a.port), handler).serve_forever()


def adapt_detection(a: argparse.Namespace) -> None:
    spark = _session()
    read = lambda p: tables.read_csv(spark, p) if p else None
    tables.write_table(adapters.adapt_detection_labels(read(a.labels), read(a.predictions), read(a.metadata), a.threshold, a.model_version, a.seed), a.output)


def adapt_export(a: argparse.Namespace) -> None:
    spark = _session()
    meta = tables.read_csv(spark, a.metadata) if a.metadata else None
    tables.write_table(adapters.adapt_predictions(tables.read_csv(spark, a.export), meta, a.threshold, a.model_version, a.schema_profile), a.output)


def _templates(texts: dict[str, str]) -> Callable[[argparse.Namespace], None]:
    def run(a: argparse.Namespace) -> None:
        print(*(records.write_template(Path(a.output) / name, text, a.force) for name, text in texts.items()), sep="\n")

    return run


def _template(text: Callable[[], str]) -> Callable[[argparse.Namespace], None]:
    return lambda a: print(records.write_template(a.output, text(), a.force))


def inventory_validate(a: argparse.Namespace) -> None:
    print(f"{len(records.load_inventory(a.path))} models")


def protocol_validate(a: argparse.Namespace) -> None:
    print(json.dumps(records.load_protocol(a.path).to_dict(), indent=2))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    commands = top.add_subparsers(required=True, dest="command")

    def add(name: str, run: Callable[[argparse.Namespace], None], **options: object) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for key, default in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
            elif default is ...:
                p.add_argument(flag, required=True)
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else str)
        return p

    shared = {"csv": ..., "schema_profile": "public", "monitoring_plan": None, "alert_reviews": None, "audit_log": None}
    adapted = {"threshold": 0.5, "model_version": "external-model", "metadata": None, "output": ...}
    add("demo", demo, output="outputs/demo", n=1200, seed=42, pdf=True)
    add("compute", compute, output="outputs/analysis", **shared)
    add("compute-multiclass", compute_multiclass, csv=..., output="outputs/multiclass", schema_profile="public", audit_log=None)
    add("report", make_report, output="outputs/report", pdf=True, **shared)
    add("serve", serve, output="outputs", host="127.0.0.1", port=8501)
    add("adapt-detection", adapt_detection, labels=..., predictions=None, seed=42, **adapted)
    add("detection-templates", _templates(records.detection_templates()), output="templates", force=False)
    add("adapt-export", adapt_export, export=..., schema_profile="production", **adapted)
    add("connector-templates", _templates(records.connector_templates()), output="templates", force=False)
    add("monitoring-plan-template", _template(records.plan_template), output="monitoring_plan.json", force=False)
    add("inventory-template", _template(records.inventory_template), output="model_inventory.csv", force=False)
    add("inventory-validate", inventory_validate, path=...)
    add("study-protocol-template", _template(records.protocol_template), output="study_protocol.json", force=False)
    add("study-protocol-validate", protocol_validate, path=...)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
