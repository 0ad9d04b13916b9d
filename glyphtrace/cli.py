"""Command line: detect, decode, sanitize, watermark."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphtrace.functions.severity import exit_code
from glyphtrace.limits import ScanLimits
from glyphtrace.operators.provenance import ToolValidator
from glyphtrace.operators.sanitize import copy_sidecar, decode_assets, sanitize_assets, write_file
from glyphtrace.plans.scan import Hooks, examined, families, release, scan
from glyphtrace.report import FAMILIES, results, write_folder_reports, write_html, write_json, write_results
from glyphtrace.sources.assets import list_files, parse_suffixes, read_files, with_text
from glyphtrace.sources.remote import load_manifest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphtrace", description="Finds, decodes and removes hidden content.")
    sub = p.add_subparsers(dest="command", required=True)
    detect = sub.add_parser("detect", help="scan files and folders")
    detect.add_argument("paths", nargs="+")
    detect.add_argument("-r", "--recursive", action="store_true")
    detect.add_argument("--ext", default="ALL", help="suffixes, or ALL")
    detect.add_argument("--no-venv", action="store_true", help="leave out dependency folders")
    detect.add_argument("--json")
    detect.add_argument("--html")
    detect.add_argument("--html-per-folder")
    detect.add_argument("--results", help="folder for JSON lines, written in parallel")
    detect.add_argument("-v", "--verbose", action="store_true", help="sums by family, and why a file is flagged")
    detect.add_argument("-d", "--details", action="store_true", help="every finding of a file")
    decode = sub.add_parser("decode", help="read payloads of text channels")
    sanitize = sub.add_parser("sanitize", help="write a copy without hidden characters")
    watermark = sub.add_parser("watermark", help="findings and provenance of one file")
    for s in (decode, sanitize, watermark):
        s.add_argument("input")
    sanitize.add_argument("-o", "--output")
    sanitize.add_argument("--in-place", action="store_true")
    sanitize.add_argument("--confirm", action="store_true")
    for s in (watermark, sanitize):
        s.add_argument("--c2pa-tool", nargs="?", const="c2patool")
    watermark.add_argument("--allow-remote-manifests", action="store_true")
    watermark.add_argument("--json")
    watermark.add_argument("--html")
    for s in (detect, decode, sanitize, watermark):
        for f in fields(ScanLimits):
            s.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type=type(f.default), default=None)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "sanitize" and (a.in_place != a.confirm or a.in_place and a.output):
        p.error("--in-place goes with --confirm and without --output")
    try:
        limits = ScanLimits.of({f.name: getattr(a, f.name) for f in fields(ScanLimits) if getattr(a, f.name) is not None})
        spark = spark or SparkSession.builder.appName("glyphtrace").getOrCreate()
        return _run(a, spark, limits)
    except (OSError, TypeError, ValueError) as e:
        print(f"glyphtrace: {e}", file=sys.stderr)
        return 2


_COLOURS = {"critical": 31, "high": 31, "medium": 33, "low": 36, "clean": 32}  # ANSI


def coloured(text: str, severity: str) -> str:
    """The text in the colour of a severity, on terminals only."""
    return f"\x1b[{_COLOURS[severity.lower()]}m{text}\x1b[0m" if sys.stdout.isatty() else text


def _print(tables: dict, verbose: bool, details: bool) -> None:
    """A line per file in order of paths; verbose: what was counted in it, and sums by family; details: its findings."""
    verdicts = tables["verdicts"]
    if details:
        found = tables["findings"].groupBy(F.col("root_id").alias("asset_id")).agg(F.array_sort(F.collect_list(F.struct("depth", "place", "risk", "category", "description", "location"))).alias("found"))
        verdicts = verdicts.join(found, "asset_id", "left")
    for r in verdicts.orderBy("path").toLocalIterator():
        print(coloured(f"{r['severity']:>8}", r["severity"]) + f"  {r['path']}" + ("  incomplete" if r["incomplete"] else ""))
        if verbose and (r["flagged"] or r["incomplete"]):
            said = [f"{r['hidden']} hidden characters" * (r["hidden"] > 0), f"{r['trailing']} lines with trailing blanks" * (r["trailing"] > 0), "mixed line endings" * bool(r["mixed"]), f"{r['lsb_channels']} doubtful channels" * (r["lsb_channels"] > 0), f"provenance {r['provenance']}" * bool(r["attention"]), *([r["error"]] if r["error"] else []), *r["nested_errors"]]
            print("          " + "; ".join(x for x in said if x))
        for f in (r["found"] or []) if details else []:
            print("          " + coloured(f["risk"], "low" if f["risk"] == "informational" else f["risk"]) + f"  {f['category']}  {f['description']}" + f"  {f['location']}" * bool(f["location"]))
    if verbose:
        for r in families(tables).collect():  # a dozen rows
            print(f"{r['value']:>8}  {r['counter'].replace('_', ' ')}: {FAMILIES.get(r['counter'], 'all families')}")


def _sidecar(spark: SparkSession, a: argparse.Namespace, limits: ScanLimits) -> str | None:
    """The local sidecar that makes the input's provenance valid, if one does."""
    beside = [p for p in (a.input + ".c2pa.json", os.path.splitext(a.input)[0] + ".c2pa.json", a.input + ".c2pa") if os.path.isfile(p)]
    if not beside or not a.c2pa_tool:
        return None
    assets = with_text(read_files(spark, [a.input, *beside[:1]], limits))
    said = json.loads(examined(assets, Hooks(provenance_validator=ToolValidator(a.c2pa_tool)), limits).filter(F.col("asset_id") == a.input).first()["provenance"])
    return said["manifest_location"] if said["status"] == "VALID" and said["manifest_location"] == beside[0] else None


def _run(a: argparse.Namespace, spark: SparkSession, limits: ScanLimits) -> int:
    if a.command == "detect":
        files, skipped, missing = list_files(a.paths, parse_suffixes(a.ext), a.recursive, a.no_venv)
        for path in missing:
            print(f"not found: {path}", file=sys.stderr)
        tables = scan(read_files(spark, files, limits).persist(), limits=limits)
        if a.json:
            write_json(tables, a.json)
        if a.html:
            write_html(tables, a.html)
        if a.html_per_folder:
            write_folder_reports(tables, a.paths[0], a.html_per_folder)
        if a.results:
            write_results(tables, a.results)
        _print(tables, a.verbose, a.details)
        counters = tables["summary"].first()
        print(f"{counters['total']} files, {counters['flagged']} flagged, {counters['incomplete']} incomplete, {skipped} skipped")
        release(tables)
        return exit_code(counters)
    assets = read_files(spark, [a.input], limits).persist()
    error = assets.first()["read_error"]
    if error:
        raise OSError(error)
    if a.command == "decode":
        print(json.dumps(decode_assets(assets).first().asDict(True), ensure_ascii=False, indent=2))
        return 0
    if a.command == "sanitize":
        r = sanitize_assets(assets).first().asDict(True)
        to = a.input if a.in_place else a.output or r["sanitized_path"]
        side = None if a.in_place or r["changed"] else _sidecar(spark, a, limits)
        copy_sidecar(side, to, dry=True)
        write_file(to, bytes(r.pop("clean")), a.in_place, os.stat(a.input).st_mode & 0o7777)
        r["sidecar"] = copy_sidecar(side, to)
        print(json.dumps(r, ensure_ascii=False, indent=2))
        return 0
    hooks = Hooks(provenance_validator=ToolValidator(a.c2pa_tool) if a.c2pa_tool else None, remote_manifest_loader=load_manifest if a.allow_remote_manifests else None)
    tables = scan(assets, limits=limits, hooks=hooks)
    if a.json:
        write_json(tables, a.json)
    if a.html:
        write_html(tables, a.html)
    r = json.loads(results(tables).first()["result"])
    print(json.dumps(r, ensure_ascii=False, indent=2))
    return 2 if r["incomplete"] else 0


if __name__ == "__main__":
    sys.exit(main())
