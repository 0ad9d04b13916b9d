"""The scan: assets to findings, verdicts and a summary, all as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.functions import severity, text
from glyphtrace.functions.lsb import verdict as lsb_verdict
from glyphtrace.limits import LimitExceeded, ScanLimits
from glyphtrace.operators import pixels, provenance
from glyphtrace.operators.binary import byte_hits, capped_hits
from glyphtrace.operators.containers import expand
from glyphtrace.operators.robust import analyze_media
from glyphtrace.operators.structure import FINDING, structure_findings
from glyphtrace.sources.assets import with_text

#: Suffixes that a provenance record or a media analyzer can concern; what else there is needs no Python.
EXAMINED = sorted({*dims.PROVENANCE_SUFFIXES, *(s for suffixes in dims.ROBUST_SUFFIXES.values() for s in suffixes)})
#: Bytes of sidecars that are broadcast; more are shuffled to their assets.
SIDECAR_BYTES = 32 << 20
#: Remote manifests of one scan, loaded by the driver.
REMOTE_MANIFESTS = 1000
_FOUND = "array<struct<seq:int,category:string,detector:string,description:string,confidence:double,location:string,evidence:string,risk:string>>"
_LOOKED = f"asset_id string, findings {_FOUND}, provenance string, robust string, ai string"


@dataclass(frozen=True)
class Hooks:
    """Plug-ins, sent to the tasks: all are optional."""

    ai_text_verifier: Callable | object | None = None
    provenance_validator: Callable | object | None = None
    remote_manifest_loader: Callable | None = None
    media_analyzers: Mapping[str, Callable] | None = None


def verify_text(verifier, content: str, path: str) -> dict:
    """What a text verifier says, as status, provider, confidence, evidence, errors."""
    blank = {"status": "NOT_CHECKED", "provider": "", "confidence": 0.0, "evidence": {}, "errors": []}
    if verifier is None:
        return blank | {"errors": ["no text verifier is configured"]}
    try:
        said = (verifier.verify if hasattr(verifier, "verify") else verifier)(content, path=path)
        if not isinstance(said, Mapping):
            raise TypeError("a text verifier returns a mapping")
        confidence = float(said.get("confidence", 0.0))
        if not 0 <= confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")
        out = blank | {"status": "DETECTED" if said.get("detected") else "NOT_DETECTED", "provider": str(said.get("provider", "")), "confidence": confidence, "evidence": dict(said.get("evidence", {}))}
        json.dumps(out)
        return out
    except Exception as e:  # a plug-in's failure is a result
        return blank | {"status": "ERROR", "errors": [str(e)]}


def sidecars(assets: DataFrame) -> DataFrame:
    """asset_id and the sidecar (name, content) that goes first: name.c2pa.json, stem.c2pa.json, name.c2pa, in the same folder."""
    side = assets.filter(_is_sidecar()).select(F.col("path").alias("side_path"), F.col("content").alias("side_content"))
    own = assets.filter(F.col("suffix").isin(*dims.PROVENANCE_SUFFIXES))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    tries = F.array(F.concat("path", F.lit(".c2pa.json")), F.concat(stem, F.lit(".c2pa.json")), F.concat("path", F.lit(".c2pa")))
    pairs = own.select("asset_id", F.posexplode(tries).alias("k", "side_path")).join(side, "side_path")
    return pairs.groupBy("asset_id").agg(F.min_by(F.struct("side_path", "side_content"), "k").alias("side"))


def _is_sidecar() -> Column:
    return F.lower("path").rlike(r"\.c2pa(\.json)?$")


def _with_sidecars(assets: DataFrame, live: DataFrame) -> DataFrame:
    """Assets with their sidecar, or null. Content is shuffled only where there are sidecars too large to broadcast."""
    n, size = assets.filter(_is_sidecar()).agg(F.count("*"), F.sum("length")).first()
    none = F.lit(None).cast("struct<side_path:string,side_content:binary>").alias("side")
    if not n:
        return live.select("*", none)
    found = sidecars(assets)
    own = F.col("suffix").isin(*dims.PROVENANCE_SUFFIXES)
    joined = live.filter(own).join(F.broadcast(found) if size <= SIDECAR_BYTES else found, "asset_id", "left")
    return joined.select(*live.columns, "side").unionAll(live.filter(~own).select("*", none))


def _manifests(near: DataFrame, loader: Callable | None) -> dict[str, object]:
    """What remote manifests say, by address: loaded here on the driver, at most REMOTE_MANIFESTS of them."""
    if loader is None:
        return {}

    def run(batches):
        for b in batches:
            found = [provenance.embedded_manifest(suffix, raw) for suffix, raw, side in zip(b["suffix"].to_pylist(), b["content"].to_pylist(), b["side"].to_pylist(), strict=True) if side is None and suffix in dims.PROVENANCE_SUFFIXES]
            urls = [str(m["remote_url"]) for m in found if isinstance(m, dict) and m.get("remote_url")]
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string())], names=["url"])

    urls = [r[0] for r in near.select("suffix", "content", "side").mapInArrow(run, "url string").distinct().orderBy("url").limit(REMOTE_MANIFESTS + 1).collect()]
    if len(urls) > REMOTE_MANIFESTS:
        raise ValueError(f"more than {REMOTE_MANIFESTS} remote manifests")
    out: dict[str, object] = {}
    for url in urls:
        try:
            out[url] = loader(url)
        except Exception as e:  # told where the manifest is asked for
            out[url] = e
    return out


def examined(assets: DataFrame, hooks: Hooks, limits: ScanLimits) -> DataFrame:
    """asset_id, findings, provenance, robust, ai (JSON) of every asset with content: the parts that plug-ins may decide.

    Assets that no provenance format, media analyzer or text verifier concerns get theirs as constants, without Python.
    """
    kind = pa.list_(pa.struct([("seq", pa.int32()), ("category", pa.string()), ("detector", pa.string()), ("description", pa.string()), ("confidence", pa.float64()), ("location", pa.string()), ("evidence", pa.string()), ("risk", pa.string())]))
    live = assets.filter("content is not null").select("asset_id", "path", "suffix", "content", "utf8_text")
    concerns = F.lit(True) if hooks.ai_text_verifier is not None else F.col("suffix").isin(*EXAMINED)
    near = _with_sidecars(assets, live.filter(concerns))
    manifests = _manifests(near, hooks.remote_manifest_loader)

    def loaded(url: str):
        said = manifests[url]
        if isinstance(said, Exception):
            raise said
        return said

    loader, validator, analyzers, verifier = loaded if hooks.remote_manifest_loader else None, hooks.provenance_validator, hooks.media_analyzers, hooks.ai_text_verifier

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                side = (r["side"]["side_path"], r["side"]["side_content"] or b"") if r["side"] else None
                said = provenance.examine(r["path"], r["suffix"], r["content"], side, validator, loader)
                found = [(20, *f) for f in provenance.findings(said)]
                robust = analyze_media(r["suffix"], r["content"], analyzers, limits)
                found += [(25, k, "robust_media_analyzer", "an analyzer found signs of a robust watermark", v["confidence"], "", {"signal_families": v["detected_families"] or v["families"], "metrics": v["metrics"]}, "medium") for k, v in robust.items() if v["status"] == "DETECTED"]
                ai = verify_text(verifier, r["utf8_text"] or "", r["path"])
                if ai["status"] == "DETECTED":
                    found.append((40, "AI_TEXT_WATERMARK", "pluggable_ai_text_verifier", "the configured verifier found a text watermark", ai["confidence"], "", {"provider": ai["provider"], **ai["evidence"]}, "informational"))
                rows = [dict(zip(("seq", "category", "detector", "description", "confidence", "location", "evidence", "risk"), (*f[:6], json.dumps(f[6]), f[7]), strict=True)) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([r["asset_id"]]), pa.array([rows], kind), *(pa.array([json.dumps(x)]) for x in (said, robust, ai))], names=["asset_id", "findings", "provenance", "robust", "ai"])

    looked = near.mapInArrow(run, _LOOKED)
    plain = [json.dumps(x) for x in (provenance.record("UNSUPPORTED"), {}, verify_text(None, "", ""))]
    rest = live.filter(~concerns).select("asset_id", F.array().cast(_FOUND).alias("findings"), *[F.lit(x).alias(n) for x, n in zip(plain, ("provenance", "robust", "ai"), strict=True)])
    return looked.unionAll(rest)


def lsb_channels(assets: DataFrame, limits: ScanLimits, corrected: bool = False) -> DataFrame:
    """asset_id, error, format, mode, width, height, channel, votes, suspicious, tests (JSON) of lossless images."""
    schema = "asset_id string, error string, format string, mode string, width int, height int, channel string, votes int, suspicious boolean, tests string"

    def run(batches):
        for b in batches:
            for asset, suffix, raw in zip(b["asset_id"].to_pylist(), b["suffix"].to_pylist(), b["content"].to_pylist(), strict=True):
                error, image = None, None
                try:
                    image = pixels.read_image(raw or b"", suffix, limits)
                    error = None if image else "the pixels cannot be decoded"
                except LimitExceeded as e:
                    error = str(e)
                head = {"asset_id": asset, "error": error, **({"format": image.format, "mode": image.mode, "width": image.width, "height": image.height} if image else {})}
                rows = [head | {"channel": c["channel"], "votes": c["votes"], "suspicious": c["suspicious"], "tests": json.dumps(c["tests"])} for c in (pixels.plane_statistics(image, corrected) if image else [])] or [head]
                fields = [("asset_id", pa.string()), ("error", pa.string()), ("format", pa.string()), ("mode", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channel", pa.string()), ("votes", pa.int32()), ("suspicious", pa.bool_()), ("tests", pa.string())]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n, _ in fields} for r in rows], schema=pa.schema(fields))

    return assets.filter(F.col("suffix").isin(*dims.LSB_SUFFIXES) & F.col("content").isNotNull()).select("asset_id", "suffix", "content").mapInArrow(run, schema)


def scan(assets: DataFrame, *, limits: ScanLimits | Mapping | None = None, hooks: Hooks = Hooks(), corrected_rs: bool = False, persist: bool = True) -> dict[str, DataFrame]:
    """All tables of a scan: assets, characters, hits, lsb, findings, provenance, verdicts, summary.

    assets are root assets; members of their containers are added. Each table is lazy; assets are best persisted by the
    caller, as several tables read their content. Members and the records of plug-ins are persisted here, so that no
    container is opened twice and no plug-in asked twice; release() frees them.

    max_findings bounds the findings that are listed, and what hidden, trailing and the severity count; every_hidden and
    every_trailing of the verdicts count all.
    """
    limits = ScanLimits.of(limits)
    roots = with_text(assets)
    opened = expand(assets, limits)
    members = with_text(opened.persist() if persist else opened)
    every = roots.unionAll(members)
    read = roots.filter("read_error is null")
    marks, bytes_found = text.character_findings(read.filter("mode = 'text'"), "asset_id", "text", "encoding"), byte_hits(read.filter("mode = 'binary'"))
    characters, hits = text.capped(marks, limits.max_findings), capped_hits(bytes_found, limits.max_findings)
    lsb = lsb_channels(read, limits, corrected_rs)
    live = every.filter("content is not null")
    looked = examined(live, hooks, limits)
    looked = looked.persist() if persist else looked
    plugged = looked.select("asset_id", F.posexplode("findings").alias("ord", "f")).select("asset_id", "ord", "f.*").select(*FINDING)
    found = structure_findings(live).unionAll(plugged).join(every.select("asset_id", "root_id", "depth"), "asset_id")
    place = Window.partitionBy("asset_id").orderBy("seq", "ord", "category")
    findings = found.withColumn("place", F.row_number().over(place)).withColumn("over_limit", F.count("*").over(Window.partitionBy("asset_id")) > limits.max_findings).filter(F.col("place") <= limits.max_findings)

    blank, within = F.col("kind") == "trailing", F.col("ord") <= limits.max_findings
    chars = marks.groupBy(F.col("id").alias("root_id")).agg(F.count_if(~blank & within).alias("hidden"), F.count_if(blank & within).alias("trailing"), F.count_if(~blank).alias("every_hidden"), F.count_if(blank).alias("every_trailing"), F.bool_or(~within).alias("cut"))
    bytes_ = bytes_found.groupBy(F.col("asset_id").alias("root_id")).agg(F.count("*").alias("every_hit")).select("root_id", "every_hit", F.least("every_hit", F.lit(limits.max_findings)).alias("hit"), (F.col("every_hit") > limits.max_findings).alias("hit_cut"))
    stego = lsb_verdict(lsb.withColumn("suspicious", F.coalesce("suspicious", F.lit(False))), ["asset_id"]).withColumnRenamed("asset_id", "root_id").withColumnRenamed("verdict", "lsb_verdict").withColumnRenamed("confidence", "lsb_confidence")
    status = looked.select("asset_id", F.get_json_object("provenance", "$.status").alias("provenance"))
    own = findings.filter("depth = 0").groupBy("root_id").agg(F.bool_or(F.col("risk") != "informational").alias("risky"), F.bool_or("over_limit").alias("found_cut"), F.count("*").alias("findings"))
    failed = members.filter("read_error is not null").groupBy("root_id").agg(F.array_sort(F.collect_set("read_error")).alias("nested_errors"))
    base = roots.select("root_id", "path", "name", "mode", "length", "read_error", F.sha2("content", 256).alias("sha256"), ((F.col("mode") == "text") & text.mixed_line_endings("text")).alias("mixed"))
    v = base
    for side in (chars, bytes_, stego, own, failed, status.withColumnRenamed("asset_id", "root_id")):
        v = v.join(side, "root_id", "left")
    no, zero = F.lit(False), F.lit(0)
    v = v.withColumns({"hidden": F.coalesce("hidden", zero) + F.coalesce("hit", zero), "trailing": F.coalesce("trailing", zero), "every_hidden": F.coalesce("every_hidden", zero) + F.coalesce("every_hit", zero), "every_trailing": F.coalesce("every_trailing", zero), "lsb_channels": F.coalesce("suspicious_channels", zero), "attention": F.coalesce("risky", no) | F.coalesce(F.col("provenance").isin("TAMPERED", "UNTRUSTED_SIGNER"), no), "provenance": F.coalesce("provenance", F.lit("NOT_CHECKED"))})
    v = v.withColumn("base_severity", severity.base_severity(F.col("hidden"), F.col("trailing"), F.col("mixed"), F.col("lsb_channels") > 0))
    cut = F.coalesce("cut", no) | F.coalesce("hit_cut", no)
    verdicts = v.select(
        F.col("root_id").alias("asset_id"), "path", "name", "mode", "length", "sha256", "hidden", "trailing", "mixed", "lsb_verdict", "lsb_channels", "provenance", F.coalesce("findings", zero).alias("findings"), "attention", "base_severity",
        severity.severity(F.col("base_severity"), F.col("attention")).alias("severity"),
        ((F.col("hidden") > 0) | (F.col("trailing") > 0) | F.col("mixed") | (F.col("lsb_channels") > 0) | F.col("attention")).alias("flagged"),
        (F.col("read_error").isNotNull() | cut | F.coalesce("found_cut", no) | F.col("nested_errors").isNotNull()).alias("incomplete"),
        F.coalesce("read_error", F.when(cut, F.lit(f"max_findings exceeded: limit is {limits.max_findings}"))).alias("error"), F.coalesce("nested_errors", F.array().cast("array<string>")).alias("nested_errors"),
        "every_hidden", "every_trailing",
    )
    return {"members": opened, "assets": every, "characters": characters, "hits": hits, "lsb": lsb, "findings": findings, "provenance": looked, "verdicts": verdicts, "summary": severity.summary(verdicts)}


def release(tables: dict[str, DataFrame]) -> None:
    """Frees what a scan has persisted."""
    for name in ("members", "provenance"):
        tables[name].unpersist()


def folder_of(path: Column, root: str) -> Column:
    """The folder just below a root, or a dot."""
    below = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    return F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise(".")


def folders(verdicts: DataFrame, root: str) -> DataFrame:
    """Counts per folder just below a root, and over all (folder null); critical goes by the base severity."""
    critical = F.col("base_severity") == "critical"
    return verdicts.withColumn("folder", folder_of(F.col("path"), root)).rollup("folder").agg(F.count("*").alias("files"), F.count_if("flagged").alias("flagged"), F.count_if("incomplete").alias("incomplete"), F.count_if(critical).alias("critical"), F.count_if(~F.col("flagged") & ~F.col("incomplete")).alias("clean"))


def critical_paths(verdicts: DataFrame, root: str) -> DataFrame:
    """folder, path of every critical file, a row each."""
    return verdicts.filter("base_severity = 'critical'").select(folder_of(F.col("path"), root).alias("folder"), "path")


def families(tables: dict[str, DataFrame]) -> DataFrame:
    """counter, value: sums of findings per family of characters, files with mixed line endings or doubtful pixels, and provenance records.

    Members of containers count among the records; a record fails if it is tampered, its signer is not trusted, or it has
    any validation error, so one that was not validated counts, too.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    chars = tables["characters"].agg(kind("zero_width").alias("zero_width"), kind("homoglyph").alias("homoglyphs"), kind("suspicious").alias("suspicious"), kind("trailing").alias("trailing"))
    hits = tables["hits"].agg(F.count("*").alias("binary_hits"))
    files = tables["verdicts"].agg(F.count_if("mixed").alias("mixed_line_endings"), F.count_if(F.col("lsb_channels") > 0).alias("lsb"), F.coalesce(F.sum("hidden"), F.lit(0)).cast("long").alias("hidden"))
    said = F.from_json("provenance", "status string, validation_errors array<string>")
    records = tables["provenance"].select(said.alias("p")).agg(F.count_if(F.col("p.status") == "VALID").alias("provenance_valid"), F.count_if(F.col("p.status").isin("TAMPERED", "UNTRUSTED_SIGNER") | (F.size("p.validation_errors") > 0)).alias("provenance_failures"))
    out = None
    for sums in (chars, hits, files, records):
        rows = sums.unpivot([], sums.columns, "counter", "value")
        out = rows if out is None else out.unionAll(rows)
    return out
