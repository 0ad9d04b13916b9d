"""Reports of a scan: JSON and HTML files streamed by the driver, or result rows written in parallel."""

from __future__ import annotations

import html
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime
from itertools import groupby
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphtrace.operators.sanitize import write_file
from glyphtrace.plans.scan import critical_paths, families, folder_of, folders

ENGINE_VERSION = "0.1"


def results(tables: dict[str, DataFrame]) -> DataFrame:
    """asset_id, path and one JSON document per root asset."""
    chars = tables["characters"].groupBy(F.col("id").alias("asset_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "line", "col", "abs_i", "byte_off", "char", "name", "count"))).alias("characters"))
    hits = tables["hits"].groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("byte_off", "category", "char", "name", "context"))).alias("binary_hits"))
    found = tables["findings"].groupBy(F.col("root_id").alias("asset_id")).agg(F.array_sort(F.collect_list(F.struct("depth", "place", F.col("asset_id").alias("asset"), "category", "detector", "description", "confidence", "location", "evidence", "risk"))).alias("finding_rows"))
    lsb = tables["lsb"].groupBy("asset_id").agg(F.collect_list(F.struct("error", "format", "mode", "width", "height", "channel", "votes", "suspicious", "tests")).alias("lsb"))
    out = tables["verdicts"]
    for side in (chars, hits, found, lsb, tables["provenance"].select("asset_id", F.col("provenance").alias("provenance_record"), "robust", "ai")):
        out = out.join(side, "asset_id", "left")
    return out.select("asset_id", "path", "base_severity", F.to_json(F.struct("*")).alias("result"))


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Results as JSON lines, written by the tasks: the report for scans of any size."""
    results(tables).select(F.col("result").alias("value")).write.text(folder)


@contextmanager
def _whole_file(path: str) -> Iterator:
    """A text file that takes its place when all of it is written."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def counters(tables: dict[str, DataFrame]) -> dict:
    """What a report says about all files."""
    c = tables["summary"].first().asDict()
    return {"schema_version": "1.0", "engine_version": ENGINE_VERSION, "scan_time": datetime.now().strftime("%Y-%m-%d %H:%M:%S"), "total_files": c["total"], "flagged_files": c["flagged"], "incomplete_files": c["incomplete"], "completed_files": c["completed"], "clean_files": c["clean"]}


def _ordered(tables: dict[str, DataFrame]) -> Iterator[dict]:
    """Results by path, a partition of them on the driver at a time."""
    return (json.loads(r[0]) for r in results(tables).orderBy("path").select("result").toLocalIterator())


def write_json(tables: dict[str, DataFrame], path: str) -> dict:
    """One JSON document: counters and results in order of paths. Returns the counters."""
    said = counters(tables)
    with _whole_file(path) as f:
        f.write(json.dumps(said, indent=2, ensure_ascii=False)[:-2] + ',\n  "results": [')
        for k, r in enumerate(_ordered(tables)):
            f.write("," * (k > 0) + "\n    " + json.dumps(r, indent=2, ensure_ascii=False).replace("\n", "\n    "))
        f.write("\n  ]\n}")
    return said


_STYLE = "body{font:14px system-ui;margin:2rem;color:#222}table{border-collapse:collapse}td,th{padding:.3rem .6rem;border-bottom:1px solid #ddd;text-align:left}.critical,.high{color:#b00020}.medium{color:#8a6d00}.low{color:#00639b}ul.cards{display:flex;flex-wrap:wrap;gap:.6rem;list-style:none;padding:0}ul.cards li{border:1px solid #ddd;padding:.4rem .8rem}ol.timeline{border-left:3px solid #ccc}"
_SCRIPT = "document.querySelector('select').onchange=v=>document.querySelectorAll('section').forEach(s=>s.hidden=v.target.value!='all'&&s.dataset.severity!=v.target.value)"
#: What a family of findings means, for the reference at the end of a page.
FAMILIES = {
    "zero_width": "characters without width, which can carry a payload or split words",
    "homoglyphs": "letters of other scripts that look like Latin ones",
    "suspicious": "direction controls, fillers and odd blanks",
    "trailing": "blanks at the ends of lines, which can carry bits",
    "binary_hits": "invisible characters among the bytes of a binary",
    "mixed_line_endings": "files whose lines end in several ways",
    "lsb": "images whose lowest bits look like a payload",
    "provenance_valid": "records of origin that were validated",
    "provenance_failures": "records of origin that are broken, not trusted or not validated",
}


def _e(x) -> str:
    return html.escape(str(x if x is not None else ""))


def _origin(r: dict) -> str:
    """The panel and the timeline of a file's provenance; empty without a manifest."""
    said = json.loads(r.get("provenance_record") or "{}")
    if said.get("status") in (None, "MISSING", "UNSUPPORTED"):
        return ""
    rows = "".join(f"<tr><th>{_e(k.replace('_', ' '))}</th><td>{_e(said[k])}</td></tr>" for k in ("status", "provider", "claim_generator", "signer_identity", "certificate_trust", "digital_source_type", "manifest_location", "manifest_label") if said.get(k))
    errors = "".join(f"<li>{_e(x)}</li>" for x in said.get("validation_errors", []))
    steps = [*said.get("timestamps", []), *((a.get("when") or "") + " " + str(a.get("action", "action")) if isinstance(a, dict) else a for a in said.get("actions", [])), *("ingredient " + str(i.get("title", "")) if isinstance(i, dict) else i for i in said.get("ingredients", []))]
    line = "".join(f"<li>{_e(str(x).strip())}</li>" for x in steps)
    return f"<h3>Provenance</h3><table>{rows}</table>" + f"<ul>{errors}</ul>" * bool(errors) + f"<ol class='timeline'>{line}</ol>" * bool(line)


def _section(r: dict) -> str:
    rows = "".join(f"<tr><td>{_e(f['category'])}</td><td class='{_e(f['risk'])}'>{_e(f['risk'])}</td><td>{_e(f['description'])}</td><td>{_e(f['location'])}</td><td>{_e(f['evidence'])}</td></tr>" for f in r.get("finding_rows") or [])
    marks = "".join(f"<tr><td>{_e(c['kind'])}</td><td>{_e(c['line'])}:{_e(c['col'])}</td><td>{_e(c['name'])}</td></tr>" for c in (r.get("characters") or [])[:30])
    return f"<section data-severity='{_e(r['severity'])}'><h2 class='{_e(r['severity'])}'>{_e(r['path'])}</h2><p>{_e(r['severity'])}, {_e(r['hidden'])} hidden, {_e(r['trailing'])} lines with trailing blanks, provenance {_e(r['provenance'])} {_e(r.get('error'))}</p><table>{rows}{marks}</table>{_origin(r)}</section>"


def page(said: dict, sums: dict, rows: Iterable[dict], title: str = "Hidden-content scan") -> Iterator[str]:
    """A page in pieces: counters, sums by family, a filter by severity, a section per file; every value is escaped."""
    cards = {**{k: said[k] for k in ("total_files", "flagged_files", "incomplete_files", "clean_files")}, **sums}
    items = "".join(f"<li>{_e(k.replace('_', ' '))}: <b>{_e(v)}</b></li>" for k, v in cards.items())
    choices = "".join(f"<option>{s}</option>" for s in ("all", "critical", "high", "medium", "low", "clean"))
    yield f"<!doctype html><meta charset=utf-8><title>{_e(title)}</title><style>{_STYLE}</style><h1>{_e(title)}</h1><ul class='cards'>{items}</ul><select>{choices}</select>"
    for r in rows:
        yield _section(r)
    known = "".join(f"<dt>{_e(k.replace('_', ' '))}</dt><dd>{_e(v)}</dd>" for k, v in FAMILIES.items() if k in sums)
    yield f"<dl>{known}</dl>" * bool(known) + f"<script>{_SCRIPT}</script>"


def render_html(payload: dict, title: str = "Hidden-content scan") -> str:
    """The page of a report that is in memory."""
    return "".join(page(payload, payload.get("families", {}), payload["results"], title))


def write_html(tables: dict[str, DataFrame], path: str, title: str = "Hidden-content scan") -> None:
    """The page of a scan, file by file."""
    sums = {r["counter"]: r["value"] for r in families(tables).collect()}  # a dozen rows
    with _whole_file(path) as f:
        for piece in page(counters(tables), sums, _ordered(tables), title):
            f.write(piece)


def report_name(relative: str) -> str:
    """A file name out of a folder's path."""
    name = "_".join(p for p in relative.replace("\\", "/").replace(":", "/").replace(" ", "/").split("/") if p)
    while "__" in name:
        name = name.replace("__", "_")
    return (name.strip("_") or "report") + ".html"


def write_folder_reports(tables: dict[str, DataFrame], root: str, out: str) -> None:
    """A page and a list of critical files per folder below a root, and the list of all."""
    write_json(tables, str(Path(out) / "all.json"))
    rows = results(tables).select(folder_of(F.col("path"), root).alias("folder"), "path", "result").orderBy("folder", "path").toLocalIterator()
    counts = {r["folder"]: r for r in folders(tables["verdicts"], root).collect()}  # a row for each folder that gets a page
    for folder, part in groupby(rows, key=lambda r: r["folder"]):
        c = counts[folder]
        said = {"total_files": c["files"], "flagged_files": c["flagged"], "incomplete_files": c["incomplete"], "clean_files": c["clean"]}
        with _whole_file(str(Path(out) / report_name(folder))) as f:
            for piece in page(said, {}, (json.loads(r["result"]) for r in part), folder):
                f.write(piece)
    critical = critical_paths(tables["verdicts"], root)
    for folder, part in groupby(critical.orderBy("folder", "path").toLocalIterator(), key=lambda r: r["folder"]):
        write_file(str(Path(out) / report_name(folder).replace(".html", ".critical.txt")), "\n".join(r["path"] for r in part).encode(), replace=True)
    with _whole_file(str(Path(out) / "critical_all.txt")) as f:
        f.writelines(f"{r['path']}\n" for r in critical.orderBy("path").toLocalIterator())
