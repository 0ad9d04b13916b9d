"""Findings about structure, metadata, declared markers, layout and text patterns, as rows over assets."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.functions import text
from glyphtrace.operators.formats import PNG, bmff_parts, png_parts, riff_parts

FINDING = ["asset_id", "ord", "seq", "category", "detector", "description", "confidence", "location", "evidence", "risk"]


def parts(assets: DataFrame) -> DataFrame:
    """asset_id, length, parts of every asset that may have some: chunks, boxes, tails and archive entries as (ord, format, kind, name, start, stop)."""

    def of(suffix: str, raw: bytes):
        if raw.startswith(PNG):
            yield from (("png", *p) for p in png_parts(raw))
        yield from (("riff", *p) for p in riff_parts(raw))
        if suffix in dims.BMFF_SUFFIXES and len(raw) >= 8:
            yield from (("bmff", *p) for p in bmff_parts(raw))
        if suffix in dims.ZIP_SUFFIXES:
            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for e in archive.infolist():
                        if not e.is_dir():
                            yield "zip", "member", e.filename, 0, e.file_size
                        if e.flag_bits & 1:
                            yield "zip", "encrypted", e.filename, 0, e.file_size
                    if archive.comment:
                        yield "zip", "comment", "", 0, len(archive.comment)
            except (OSError, zipfile.BadZipFile):
                pass

    kind = pa.list_(pa.struct([("ord", pa.int32()), ("format", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("ord", "format", "kind", "name", "start", "stop"), (k, *p), strict=True)) for k, p in enumerate(of(suffix, raw or b""))] for suffix, raw in zip(b["suffix"].to_pylist(), b["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["asset_id"], pa.array([len(x or b"") for x in b["content"].to_pylist()], pa.int64()), pa.array(found, kind)], names=["asset_id", "length", "parts"])

    near = assets.filter(F.col("suffix").isin(*dims.BMFF_SUFFIXES, *dims.ZIP_SUFFIXES) | F.substring("content", 1, 4).isin(bytearray(PNG[:4]), bytearray(b"RIFF"), bytearray(b"RIFX"), bytearray(b"RF64")))
    return near.select("asset_id", "suffix", "content").mapInArrow(run, "asset_id string, length long, parts array<struct<ord:int,format:string,kind:string,name:string,start:long,stop:long>>")


def _finding(seq: int, category: str, detector: str, description: str, confidence, location: Column | None = None, evidence: Column | None = None, risk="informational", ord_: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = {"ord": (F.lit(0) if ord_ is None else ord_).cast("int"), "seq": F.lit(seq), "category": F.lit(category), "detector": F.lit(detector), "description": F.lit(description), "confidence": lit(confidence).cast("double"), "location": F.lit("") if location is None else location, "evidence": F.lit("{}") if evidence is None else evidence, "risk": lit(risk)}
    return F.struct(*[c.alias(n) for n, c in values.items()])


def _json(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def _rows(df: DataFrame, findings: list[Column]) -> DataFrame:
    """A row per finding; each entry is a struct (null: none) or an array of structs."""
    return df.select("asset_id", F.explode(F.array_compact(F.concat(*findings))).alias("f")).select("asset_id", "f.*").select(*FINDING)


def _of_parts(p: DataFrame) -> DataFrame:
    """Findings about the parts of an asset, in one pass over them."""
    pick = lambda test: F.filter("parts", test)
    chunk = lambda x: (x["format"] == "png") & (x["kind"] == "chunk")
    at = lambda k: F.concat(F.lit("byte:"), k.cast("string"))
    names = lambda test: F.transform(pick(test), lambda x: x["name"])
    when = lambda found, f: F.array(F.when(F.size(found) > 0, f))
    private = names(lambda x: chunk(x) & F.substring(x["name"], 2, 1).rlike("[a-z]"))
    members, locked = names(lambda x: (x["format"] == "zip") & (x["kind"] == "member")), names(lambda x: (x["format"] == "zip") & (x["kind"] == "encrypted"))
    nested = F.filter(members, lambda n: F.lower(F.regexp_extract(n, r"(\.[^./]+)$", 1)).isin(*dims.NESTED_ARCHIVES))
    risky = (F.size(nested) > 0) | (F.size(locked) > 0)
    boxes = names(lambda x: (x["format"] == "bmff") & x["name"].isin("uuid", "free", "skip"))
    noted = F.exists("parts", lambda x: (x["format"] == "zip") & (x["kind"] == "comment"))
    office = F.exists(members, lambda n: n.startswith("docProps/"))
    packed = F.array_compact(F.array(F.when(noted & (F.size(members) > 0), F.lit("archive_comment")), F.when(office, F.lit("office_properties"))))
    size = lambda x: x["stop"] - x["start"]
    return _rows(p, [
        F.transform(pick(lambda x: (x["format"] == "png") & (x["kind"] == "overrun")), lambda x: _finding(1, "STRUCTURAL", "png_malformed_chunk", "a PNG chunk runs past the end of the file", 0.95, at(x["start"]), risk="high", ord_=x["ord"])),
        F.transform(pick(lambda x: chunk(x) & x["name"].isin("tEXt", "zTXt", "iTXt", "eXIf")), lambda x: _finding(1, "METADATA", "png_metadata_chunk", "a PNG chunk holds text or camera metadata", 0.7, x["name"], _json(chunk_type=x["name"], length=size(x) - 12), ord_=x["ord"])),
        F.transform(pick(lambda x: chunk(x) & (x["name"] == "IEND") & (x["stop"] < F.col("length"))), lambda x: _finding(2, "STRUCTURAL", "png_appended_data", "data follows the end of the PNG", 0.98, at(x["stop"]), _json(appended_bytes=F.col("length") - x["stop"]), "high")),
        when(private, _finding(4, "STRUCTURAL", "png_private_chunk", "the PNG has private chunks", 0.75, None, _json(chunk_types=private), "medium")),
        when(members, _finding(5, "STRUCTURAL", "archive_embedded_files", "the container embeds files", F.when(risky, 0.9).otherwise(0.65), None, _json(file_count=F.size(members), nested_archives=nested, encrypted_members=locked, sample_members=F.slice(members, 1, 20)), F.when(risky, "high").otherwise("informational"))),
        F.transform(pick(lambda x: x["format"] == "riff"), lambda x: _finding(6, "STRUCTURAL", "riff_appended_data", "bytes follow the declared RIFF container", 0.95, at(x["start"]), _json(appended_bytes=size(x)), "high")),
        when(boxes, _finding(7, "STRUCTURAL", "bmff_private_box", "the media file has private or padding boxes", 0.75, None, _json(box_types=boxes), "medium")),
        F.transform(pick(lambda x: (x["format"] == "bmff") & (x["kind"] == "tail")), lambda x: _finding(8, "STRUCTURAL", "bmff_appended_data", "bytes lie outside the boxes of the media file", 0.9, at(x["start"]), _json(appended_bytes=size(x)), "high")),
        when(packed, _finding(10, "METADATA", "format_metadata_fields", "the file has metadata or comment fields of its format", 0.65, None, _json(fields=packed))),
    ])


def _of_content(assets: DataFrame) -> DataFrame:
    """Findings about bytes and text, in one pass over the assets."""
    latin, suffix = F.col("latin"), F.col("suffix")
    low = F.col("low")
    rows = assets.select("asset_id", "suffix", "content", "utf8_text", F.decode("content", "ISO-8859-1").alias("latin")).withColumn("low", F.lower("latin"))
    starts = lambda mark: F.substring("content", 1, len(mark)) == F.lit(mark)
    has = lambda *marks: F.exists(F.array(*[F.contains(low, F.lit(m)) for m in marks]), lambda x: x)
    jpeg, tagged = suffix.isin(".jpg", ".jpeg"), suffix.isin(".flac", ".ogg", ".opus")
    fields = [
        (jpeg & has("exif\x00\x00"), "exif"), (jpeg & has("http://ns.adobe.com/xap/1.0/", "<x:xmpmeta"), "xmp"), (jpeg & has("photoshop 3.0"), "iptc"),
        (suffix.isin(".mp3", ".aac") & starts(b"ID3"), "id3"), (tagged & has("title=", "artist=", "comment="), "vorbis_comment"),
        *[((suffix == ".pdf") & has(k), k[1:]) for k in dims.PDF_METADATA], (suffix.isin(".svg", ".html", ".htm") & latin.rlike("(?s)<!--.*?-->"), "text_comment"),
    ]
    readable = F.col("utf8_text").isNotNull() & (F.col("utf8_text") != "")
    columns = {
        "pdf": F.when(starts(b"%PDF"), F.array_compact(F.array(*[F.when(F.contains(latin, F.lit(m)), F.lit(n)) for m, n in dims.PDF_MARKERS.items()]))),
        "psd": F.when((suffix == ".psd") & starts(b"8BPS"), F.regexp_count(latin, F.lit("8BIM"))),
        "fields": F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in fields]))),
        **{k: F.when(suffix.isin(*dims.ROBUST_SUFFIXES[k]), text.markers(low, table)) for k, table in dims.ROBUST_MARKERS.items()},
        "prints": text.markers(low, dims.FINGERPRINT_MARKERS),
        "d": F.when(readable, text.double_spaces("utf8_text")), "i": F.when(readable, text.punctuation_intervals("utf8_text")), "l": F.when(readable, text.layout_patterns("utf8_text")), "u": F.when(readable, text.external_urls("utf8_text")),
    }
    rows = rows.select("asset_id", *[c.alias(n) for n, c in columns.items()])
    when = lambda test, f: F.array(F.when(test, f))
    some = lambda c: F.size(c) > 0
    return _rows(rows, [
        when(some("pdf"), _finding(3, "STRUCTURAL", "pdf_hidden_structure", "the PDF has structures that can hide or run content", 0.9, None, _json(structures=F.col("pdf")), "high")),
        when(F.col("psd") > 0, _finding(9, "STRUCTURAL", "psd_layer_structure", "the document has layer or resource records", 0.7, None, _json(resource_markers=F.col("psd")))),
        when(some("fields"), _finding(10, "METADATA", "format_metadata_fields", "the file has metadata or comment fields of its format", 0.65, None, _json(fields=F.col("fields")))),
        *[when(some(k), _finding(11 + n, k, "declared_robust_watermark_signal", "the media declares a robust watermark", 0.65, None, _json(signal_families=F.col(k), proof=F.lit(False)))) for n, k in enumerate(dims.ROBUST_MARKERS)],
        when(some("prints"), _finding(14, "FINGERPRINT", "device_codec_fingerprint", "the file names a device, printer, camera or codec", 0.6, None, _json(markers=F.col("prints")))),
        when((F.col("d") >= 3) | (F.col("i") >= 2), _finding(30, "TEXT_PATTERN", "typography_interval_pattern", "repeated intervals between words or sentences", F.least(F.lit(0.95), F.lit(0.45) + F.col("d") * 0.1), None, _json(double_space_intervals=F.col("d"), punctuation_intervals=F.col("i")))),
        when(some("l"), _finding(31, "LAYOUT", "hidden_layout_style", "styles hide content or move it out of view", 0.92, None, _json(patterns=F.col("l")), "high")),
        when(some("u"), _finding(32, "NETWORK_OR_EXTERNAL", "external_payload_reference", "content refers to external resources", 0.55, None, _json(urls=F.col("u")))),
    ])


def structure_findings(assets: DataFrame) -> DataFrame:
    """Findings of assets (asset_id, suffix, content, utf8_text); seq and ord give their order within an asset."""
    return _of_parts(parts(assets)).unionAll(_of_content(assets))
