"""Registered queries over files that are built from the driver's tables: containers, images, search ranges, limits, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.functions import lsb
from glyphtrace.limits import ScanLimits
from glyphtrace.operators.binary import byte_hits, capped_hits
from glyphtrace.operators.containers import expand
from glyphtrace.operators.formats import PNG
from glyphtrace.operators.sanitize import provenance_impact, sanitize_assets
from glyphtrace.operators.structure import structure_findings
from glyphtrace.plans.scan import Hooks, examined, lsb_channels, scan
from glyphtrace.queries import _COUNTED, _LEN, _PIX, _binary, _carriers, _chunk, _number, _pixels, _raw
from glyphtrace.sources.assets import from_column, with_text

CAP = 40


def _found(assets: DataFrame, *detectors: str) -> DataFrame:
    rows = structure_findings(assets).filter(F.col("detector").isin(*detectors))
    return rows.select(F.col("asset_id").cast("long").alias("doc_id"), "detector", "location", "evidence", "risk")


def _little(n: Column, size: int = 2) -> Column:
    h = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in range(2 * size - 1, 0, -2)]))


def _zip(members: list[tuple[Column, Column]], comment: Column, locked: Column) -> Column:
    """A ZIP file of stored members (name, data); all are marked as encrypted where `locked` says so."""
    flags = F.when(locked, _raw("\x01\0")).otherwise(_raw("\0\0"))
    items = F.array(*[F.struct(F.encode(name, "UTF-8").alias("name"), data.alias("data")) for name, data in members])

    def add(file: Column, m: Column) -> Column:
        size = _little(F.octet_length(m["data"]), 4)
        head = F.concat(_raw("\x14\0"), flags, _raw("\0" * 6), _little(F.crc32(m["data"]), 4), size, size, _little(F.octet_length(m["name"])), _raw("\0\0"))
        entry = F.concat(file["directory"], _raw("PK\x01\x02\x14\0"), head, _raw("\0" * 10), _little(F.octet_length(file["body"]), 4), m["name"])
        return F.struct(F.concat(file["body"], _raw("PK\x03\x04"), head, m["name"], m["data"]).alias("body"), entry.alias("directory"))

    n = _little(F.lit(len(members)))
    end = lambda file: F.concat(file["body"], file["directory"], _raw("PK\x05\x06\0\0\0\0"), n, n, _little(F.octet_length(file["directory"]), 4), _little(F.octet_length(file["body"]), 4), _little(F.octet_length(comment)), comment)
    return F.aggregate(items, F.struct(_raw("").alias("body"), _raw("").alias("directory")), add, end)


def _archives(spark: SparkSession, sf_dir: str, locked: Column) -> DataFrame:
    """Every document as two members of an archive: a page, and a note, a nested archive or office properties."""
    kind = F.pmod("doc_id", F.lit(4))
    second = F.when(kind == 0, "note.txt").when(kind == 1, "inner.zip").when(kind == 2, "docProps/core.xml").otherwise("b/note.md")
    comment = F.when(F.col("doc_id") % 3 == 0, _raw("noted")).otherwise(_raw(""))
    content = _zip([(F.lit("a/page.html"), F.col("b")), (second, _raw("second"))], comment, locked)
    return _binary(spark, sf_dir, content, F.when(F.col("doc_id") % 2 == 0, ".zip").otherwise(".docx"))


def archive_structure(spark, sf_dir):
    """Members, nested and encrypted ones, comments and office properties of archives."""
    return _found(_archives(spark, sf_dir, F.col("doc_id") % 5 == 0), "archive_embedded_files", "format_metadata_fields")


def archive_members(spark, sf_dir):
    """What of those archives is opened: pages, and nested archives, which are broken here."""
    opened = expand(_archives(spark, sf_dir, F.lit(False)).select("asset_id", "parent_id", "root_id", "depth", "path", "name", "suffix", "length", "content", "read_error"))
    return opened.select(F.col("root_id").cast("long").alias("doc_id"), "depth", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"), F.col("read_error").isNotNull().alias("failed"))


def pdf_members(spark, sf_dir):
    """Pictures that are carved out of PDF files: an SVG around each document, and a JPEG."""
    content = F.concat(_raw("%PDF <svg>"), F.col("b"), _raw("</svg> "), F.lit(bytearray(b"\xff\xd8jpeg\xff\xd9")))
    assets = _binary(spark, sf_dir, content, F.lit(".pdf"))
    opened = expand(assets.select("asset_id", "parent_id", "root_id", "depth", "path", "name", "suffix", "length", "content", "read_error"))
    return opened.select(F.col("root_id").cast("long").alias("doc_id"), "depth", "name", "length", F.sha2("content", 256).alias("sha256"))


def png_malformed(spark, sf_dir):
    """PNG files whose second chunk says more than there is, in every fourth document."""
    over = F.concat(_number(F.lit(4096)), _raw("iTXtshort"))
    content = F.concat(F.lit(bytearray(PNG)), _chunk("tEXt", F.col("b")), F.when(F.col("doc_id") % 4 == 1, over).otherwise(_chunk("IEND", _raw(""))))
    return _found(_binary(spark, sf_dir, content, F.lit(".png")), "png_malformed_chunk", "png_metadata_chunk", "png_appended_data", "png_private_chunk")


_FIELDS = {
    0: (".jpg", b"\xff\xd8Exif\0\0 http://ns.adobe.com/xap/1.0/ ", ["exif", "xmp"]),
    1: (".mp3", b"ID3 ", ["id3"]),
    2: (".flac", b"fLaC TITLE=a ", ["vorbis_comment"]),
    3: (".pdf", b"%PDF /Producer /Title ", ["producer", "title"]),
    4: (".svg", b"<!-- x --><svg/>", ["text_comment"]),
    5: (".jpeg", b"\xff\xd8Photoshop 3.0 ", ["iptc"]),
}


def metadata_fields(spark, sf_dir):
    """Metadata fields of six formats, which name a field each or two."""
    kind = F.pmod("doc_id", F.lit(len(_FIELDS)))
    pick = lambda of: F.coalesce(*[F.when(kind == k, of(x)) for k, x in _FIELDS.items()])
    content = F.concat(pick(lambda x: F.lit(bytearray(x[1]))), _number(F.col("doc_id")))
    return _found(_binary(spark, sf_dir, content, pick(lambda x: F.lit(x[0]))), "format_metadata_fields")


def search_ranges(spark, sf_dir):
    """Invisible characters in text chunks and segments are found, those in pixels are not; PNG and JPEG in turn."""
    space = F.encode(F.repeat(F.lit("\u200b"), (F.col("doc_id") % 3).cast("int")), "UTF-8")
    pixels = F.lit(bytearray("\u200b\u200c".encode()))
    picture = F.concat(F.lit(bytearray(PNG)), _chunk("tEXt", F.concat(_raw("k"), space)), _chunk("IDAT", pixels), _chunk("IEND", _raw("")))
    size = F.unhex(F.lpad(F.hex(F.octet_length(space) + 2), 4, "0"))
    photo = F.concat(F.lit(bytearray(b"\xff\xd8\xff\xe1")), size, space, F.lit(bytearray(b"\xff\xda")), pixels)
    even = F.col("doc_id") % 2 == 0
    hits = byte_hits(_binary(spark, sf_dir, F.when(even, picture).otherwise(photo), F.when(even, ".png").otherwise(".jpg")))
    return hits.select(F.col("asset_id").cast("long").alias("doc_id"), "byte_off", "category", "name")


def hit_cap(spark, sf_dir):
    """Which hits a cap of five keeps: by sequence first, then by place."""
    times = (F.col("doc_id") % 6).cast("int")
    content = F.encode(F.concat(F.repeat(F.lit("\u200d\u200b"), times), F.lit("x")), "UTF-8")
    kept = capped_hits(byte_hits(_binary(spark, sf_dir, content, F.lit(".bin"))), 5)
    return kept.groupBy(F.col("asset_id").cast("long").alias("doc_id")).agg(F.count("*").alias("kept"), F.count_if(F.col("char") == "\u200b").alias("spaces"), F.max("byte_off").alias("last"), F.bool_or("over_limit").alias("over_limit"))


def incomplete_verdicts(spark, sf_dir):
    """A scan of all carriers with a limit of forty findings: what exceeds it is incomplete and cut."""
    v = scan(from_column(_carriers(spark, sf_dir), "doc_id", "t"), limits={"max_findings": CAP}, persist=False)["verdicts"]
    return v.select(F.col("asset_id").cast("long").alias("doc_id"), "incomplete", F.col("error").isNotNull().alias("told"), (F.col("hidden") + F.col("trailing")).cast("long").alias("kept"))


def text_diff(spark, sf_dir):
    """The unified diff of a line that loses a blank and a zero-width space, beside a line that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.concat(F.lit("kept\nword "), F.col("doc_id").cast("string"), F.lit("\u200b \n"))
    made = sanitize_assets(from_column(docs.select("doc_id", lines.alias("c")), "doc_id", "c"))
    return made.select(F.col("asset_id").cast("long").alias("doc_id"), "diff", "changed", F.col("changes.zero_width_removed").alias("zero_width_removed"))


def lsb_regular_singular(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    out = None
    for corrected in (False, True):
        rows = lsb.regular_singular(p, corrected=corrected).select("channel", F.lit(corrected).alias("corrected"), *[F.round(c, 6).alias(c) for c in ("r_m", "s_m", "r_n", "s_n", "estimate")], "suspicious")
        out = rows if out is None else out.unionAll(rows)
    return out


def lsb_block_entropy(spark, sf_dir):
    return lsb.block_entropy(_pixels(spark, sf_dir)).select("channel", "blocks", F.round("block_mean", 6).alias("block_mean"), F.round("block_variance", 6).alias("block_variance"))


def _palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette of 256 greys for every channel: in order for the even ones, shuffled by a step of 37 for the others."""
    channels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("channel")).distinct()
    grey = F.when(F.col("channel") % 2 == 0, F.col("entry")).otherwise(F.col("entry") * 37 % 256).cast("long")
    return channels.select("channel", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("entry")).select("channel", "entry", grey.alias("r"), grey.alias("g"), grey.alias("b"))


def lsb_palette(spark, sf_dir):
    return lsb.palette_bits(_pixels(spark, sf_dir), _palettes(spark, sf_dir)).select("channel", "colours", F.round("entropy", 6).alias("entropy"), "sorted", F.round("usage_cv", 6).alias("usage_cv"), "suspicious")


def lsb_full_vote(spark, sf_dir):
    """All five tests of indexed images, with the shifted second flip."""
    return lsb.vote(_pixels(spark, sf_dir), _palettes(spark, sf_dir), corrected=True).select("channel", F.col("votes").cast("long").alias("votes"), "suspicious")


def lsb_verdicts(spark, sf_dir):
    """Labels as images of ten, three, two and one channels: the verdict of each."""
    v = lsb.vote(_pixels(spark, sf_dir), _palettes(spark, sf_dir), corrected=True)
    images = v.select(F.explode(F.array(F.lit("all"), F.concat(F.lit("mod3_"), (F.col("channel") % 3).cast("string")), F.concat(F.lit("only_"), F.col("channel").cast("string")))).alias("image"), (F.col("votes") >= 1).alias("suspicious"))
    return lsb.verdict(images, ["image"]).select("image", "suspicious_channels", "verdict", F.round("confidence", 6).alias("confidence"))


def text_decoding(spark, sf_dir):
    """Routing by suffix and decoding: every second document has a byte that is no UTF-8."""
    tail = F.when(F.col("doc_id") % 2 == 1, _raw("\xe9")).otherwise(_raw(""))
    kind = F.pmod("doc_id", F.lit(4))
    rows = _binary(spark, sf_dir, F.concat(F.col("b"), tail), F.when(kind == 0, ".txt").when(kind == 1, ".MD").when(kind == 2, ".wasm").otherwise(".odd"))
    return rows.select(F.col("asset_id").cast("long").alias("doc_id"), "suffix", "mode", "encoding", F.length("text").cast("long").alias("characters"), F.col("utf8_text").isNull().alias("no_utf8"))


def robust_suffix_gate(spark, sf_dir):
    """Declared watermarks count only in media of their kind: all three kinds' markers in five formats."""
    kind = F.pmod("doc_id", F.lit(5))
    suffix = F.when(kind == 0, ".webp").when(kind == 1, ".mp3").when(kind == 2, ".avi").when(kind == 3, ".txt").otherwise(".tiff")
    rows = structure_findings(_binary(spark, sf_dir, _raw("DCT-watermark Echo-Hiding chroma-watermark"), suffix)).filter("detector = 'declared_robust_watermark_signal'")
    return rows.select(F.col("asset_id").cast("long").alias("doc_id"), "category", "evidence", "risk")


def nested_archives(spark, sf_dir):
    """Pages in archives in archives, opened down to the limit of two levels; the third is told as too deep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    no = F.lit(False)
    one = _zip([(F.lit("page.html"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))], _raw(""), no)
    rows = docs.select("doc_id", one.alias("z"))
    two = _zip([(F.lit("one.zip"), F.col("z")), (F.lit("side.svg"), _raw("<svg/>"))], _raw(""), no)
    rows = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, two).otherwise(F.col("z")).alias("z"))
    opened = expand(from_column(rows.select("doc_id", _zip([(F.lit("two.zip"), F.col("z"))], _raw(""), no).alias("c")), "doc_id", "c", suffix=".zip"), ScanLimits(max_nesting_depth=2))
    name, path = F.coalesce("name", F.lit("")), F.regexp_replace("path", r"^\d+", "d")
    return opened.select(F.col("root_id").cast("long").alias("doc_id"), "depth", name.alias("name"), path.alias("path"), F.coalesce("read_error", F.lit("")).alias("error"))


def sidecar_status(spark, sf_dir):
    """Pictures with a manifest beside them, by full name or by stem, whole or broken; and pictures without."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n, kind = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(4))
    said = F.when(kind == 2, F.concat(F.lit('{"provider": "p'), n, F.lit('"}'))).when(kind == 1, F.lit("{broken")).otherwise(F.lit('{"provider": "full"}'))
    rows = docs.select(n.alias("id"), _raw("<svg/>").alias("c"), F.concat(F.lit("a/"), n, F.lit(".svg")).alias("name"))
    side = docs.filter("doc_id % 4 > 0").select(F.concat(F.lit("s"), n).alias("id"), F.encode(said, "UTF-8").alias("c"), F.concat(F.lit("a/"), n, F.when(kind == 2, ".c2pa.json").otherwise(".svg.c2pa.json")).alias("name"))
    looked = examined(with_text(from_column(rows.unionAll(side), "id", "c", "name")), Hooks(), ScanLimits()).filter("asset_id not like 's%'")
    told = lambda k: F.get_json_object("provenance", f"$.{k}").alias(k)
    return looked.select(F.col("asset_id").cast("long").alias("doc_id"), told("status"), told("provider"), told("manifest_location"), F.size("findings").cast("long").alias("findings"))


def image_headers(spark, sf_dir):
    """BMP and TIFF files of as many rows as doc_id says, in a single colour: format, mode, size and channels."""
    down, even = (F.col("doc_id") % 7 + 8).cast("int"), F.col("doc_id") % 2 == 0
    body = F.encode(F.repeat(F.lit("a"), down * 8 * 3), "UTF-8")
    bmp = F.concat(_raw("BM"), _little(F.lit(54) + F.octet_length(body), 4), _raw("\0" * 4), _little(F.lit(54), 4), _little(F.lit(40), 4), _little(F.lit(8), 4), _little(down, 4), _raw("\x01\0\x18\0"), _raw("\0" * 24), body)
    tag = lambda t, v: F.concat(_little(F.lit(t)), _raw("\x04\0\x01\0\0\0"), _little(v, 4))
    tags = [tag(256, F.lit(8)), tag(257, down), tag(258, F.lit(8)), tag(259, F.lit(1)), tag(262, F.lit(2)), tag(273, F.lit(94)), tag(277, F.lit(3))]
    tiff = F.concat(_raw("II*\0\x08\0\0\0\x07\0"), *tags, body)
    rows = lsb_channels(_binary(spark, sf_dir, F.when(even, bmp).otherwise(tiff), F.when(even, ".bmp").otherwise(".tif")), ScanLimits())
    return rows.select(F.col("asset_id").cast("long").alias("doc_id"), "format", "mode", "width", "height", "channel", F.col("error").isNotNull().alias("failed"))


def provenance_impacts(spark, sf_dir):
    """What a sanitizer does to provenance, for every mix of status before, status after and change."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    status = lambda k: F.when(F.pmod(F.floor(F.col("doc_id") / k), F.lit(3)) == 0, "VALID").when(F.pmod(F.floor(F.col("doc_id") / k), F.lit(3)) == 1, "TAMPERED").otherwise("MISSING")
    before, after = (docs.select(F.col("doc_id").alias("asset_id"), status(k).alias("status")) for k in (1, 3))
    changed = docs.select(F.col("doc_id").alias("asset_id"), (F.floor(F.col("doc_id") / 9) % 2 == 1).alias("changed"))
    return provenance_impact(before, after, changed).withColumnRenamed("asset_id", "doc_id")


QUERIES = {
    "text_decoding": text_decoding, "robust_suffix_gate": robust_suffix_gate, "nested_archives": nested_archives, "sidecar_status": sidecar_status, "image_headers": image_headers, "provenance_impacts": provenance_impacts,
    "archive_structure": archive_structure, "archive_members": archive_members, "pdf_members": pdf_members, "png_malformed": png_malformed, "metadata_fields": metadata_fields,
    "search_ranges": search_ranges, "hit_cap": hit_cap, "incomplete_verdicts": incomplete_verdicts, "text_diff": text_diff,
    "lsb_regular_singular": lsb_regular_singular, "lsb_block_entropy": lsb_block_entropy, "lsb_palette": lsb_palette, "lsb_full_vote": lsb_full_vote, "lsb_verdicts": lsb_verdicts,
}


# DuckDB

_SECOND = "CASE doc_id % 4 WHEN 0 THEN 'note.txt' WHEN 1 THEN 'inner.zip' WHEN 2 THEN 'docProps/core.xml' ELSE 'b/note.md' END"
_RS = _PIX.rstrip() + """,
nx AS (SELECT channel, col, v AS a, lead(v) OVER (PARTITION BY channel, row ORDER BY col) AS b FROM px),
gr AS (SELECT channel, a, b, c FROM nx, (VALUES (false), (true)) t(c) WHERE col % 2 = 0 AND b IS NOT NULL),
fl AS (SELECT channel, c, abs(xor(a, 1) - b) - abs(a - b) AS m, abs(CASE WHEN NOT c THEN xor(a, 1) WHEN a % 2 = 0 THEN a - 1 ELSE a + 1 END - b) - abs(a - b) AS n FROM gr),
sh AS (SELECT channel, c AS corrected, count(*) FILTER (m > 0) / count(*)::DOUBLE AS r_m, count(*) FILTER (m < 0) / count(*)::DOUBLE AS s_m, count(*) FILTER (n > 0) / count(*)::DOUBLE AS r_n, count(*) FILTER (n < 0) / count(*)::DOUBLE AS s_n FROM fl GROUP BY ALL),
rs AS (SELECT *, CASE WHEN abs(2e0 * ((r_m - s_m) + (r_n - s_n))) > 1e-10 THEN least(1e0, greatest(0e0, ((r_m - r_n) + (s_n - s_m)) / (2e0 * ((r_m - s_m) + (r_n - s_n))))) ELSE 0e0 END AS estimate FROM sh)
"""
_PAL = _RS.rstrip() + """,
ix AS (SELECT channel, sum(v % 2)::DOUBLE / count(*) AS p, count(*) AS size FROM px GROUP BY channel),
ih AS (SELECT channel, size, CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0e0 END AS entropy FROM ix),
us AS (SELECT channel, count(*) AS kinds, avg(n) AS mean, stddev_pop(n) AS dev FROM h GROUP BY channel),
pl AS (SELECT channel, 256::BIGINT AS colours, entropy, size, CASE WHEN channel % 2 = 0 THEN 0 ELSE (SELECT count(*) FROM range(255) r(k) WHERE k * 37 % 256 > (k + 1) * 37 % 256) END < 12.8 AS sorted, CASE WHEN kinds > 1 THEN dev / greatest(mean, 1e0) ELSE 1e0 END AS usage_cv FROM ih JOIN us USING (channel)),
pb AS (SELECT *, size >= 16 AND entropy > 0.92 AND (sorted OR usage_cv < 0.3) AS suspicious FROM pl),
vt AS (SELECT channel, chi.suspicious::BIGINT + sp.suspicious::BIGINT + enf.suspicious::BIGINT + pb.suspicious::BIGINT + (rs.estimate > 0.15)::BIGINT AS votes FROM chi JOIN sp USING (channel) JOIN enf USING (channel) JOIN pb USING (channel) JOIN rs USING (channel) WHERE rs.corrected)
"""
ORACLES = {
    "text_decoding": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_LEN} AS n, doc_id % 2 = 1 AS odd FROM documents)
SELECT doc_id, ['.txt', '.md', '.wasm', '.odd'][doc_id % 4 + 1] AS suffix, CASE WHEN doc_id % 4 = 2 THEN 'binary' ELSE 'text' END AS mode, CASE WHEN odd THEN 'latin-1' ELSE 'utf-8' END AS encoding, CASE WHEN odd THEN n + 1 ELSE length(t) END AS characters, odd AS no_utf8 FROM d""",
    "robust_suffix_gate": """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 4) THEN 'IMAGE_ROBUST' WHEN doc_id % 5 = 1 THEN 'AUDIO_ROBUST' ELSE 'VIDEO_ROBUST' END AS category, '{"signal_families":["' || CASE WHEN doc_id % 5 IN (0, 4) THEN 'transform_domain' WHEN doc_id % 5 = 1 THEN 'echo' ELSE 'chroma' END || '"],"proof":false}' AS evidence, 'informational' AS risk FROM documents WHERE doc_id % 5 <> 3""",
    "nested_archives": """SELECT doc_id, 1 AS depth, 'two.zip' AS name, 'd.zip!two.zip' AS path, '' AS error FROM documents
UNION ALL SELECT doc_id, 2, 'one.zip', 'd.zip!two.zip!one.zip', '' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 2, 'side.svg', 'd.zip!two.zip!side.svg', '' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 3, '', 'd.zip!two.zip!one.zip', 'nesting depth limit reached' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 2, 'page.html', 'd.zip!two.zip!page.html', '' FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 3, '', 'd.zip!two.zip!page.html', 'nesting depth limit reached' FROM documents WHERE doc_id % 2 = 1""",
    "sidecar_status": """SELECT doc_id, ['MISSING', 'TAMPERED', 'NOT_CHECKED', 'NOT_CHECKED'][doc_id % 4 + 1] AS status, ['', '', 'p' || doc_id, 'full'][doc_id % 4 + 1] AS provider, CASE doc_id % 4 WHEN 0 THEN '' WHEN 2 THEN 'a/' || doc_id || '.c2pa.json' ELSE 'a/' || doc_id || '.svg.c2pa.json' END AS manifest_location, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS findings FROM documents""",
    "image_headers": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'BMP' ELSE 'TIFF' END AS format, 'RGB' AS mode, 8 AS width, (doc_id % 7 + 8)::INT AS height, unnest(['R', 'G', 'B']) AS channel, false AS failed FROM documents""",
    "provenance_impacts": """WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS b, (doc_id // 3) % 3 = 0 AS a, (doc_id // 9) % 2 = 1 AS changed FROM documents)
SELECT doc_id, CASE WHEN b AND a AND NOT changed THEN 'preserved' WHEN b THEN 'invalidated' WHEN changed THEN 'not_applicable' ELSE 'unchanged' END AS provenance_impact FROM d""",
    "archive_structure": f"""WITH d AS (SELECT doc_id, {_SECOND} AS second, doc_id % 5 = 0 AS locked FROM documents)
SELECT doc_id, 'archive_embedded_files' AS detector, '' AS location, '{{"file_count":2,"nested_archives":[' || CASE WHEN second = 'inner.zip' THEN '"inner.zip"' ELSE '' END || '],"encrypted_members":[' || CASE WHEN locked THEN '"a/page.html","' || second || '"' ELSE '' END || '],"sample_members":["a/page.html","' || second || '"]}}' AS evidence, CASE WHEN locked OR second = 'inner.zip' THEN 'high' ELSE 'informational' END AS risk FROM d
UNION ALL SELECT doc_id, 'format_metadata_fields', '', '{{"fields":[' || array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN '"archive_comment"' END, CASE WHEN doc_id % 4 = 2 THEN '"office_properties"' END], lambda x: x IS NOT NULL), ',') || ']}}', 'informational' FROM d WHERE doc_id % 3 = 0 OR doc_id % 4 = 2""",
    "archive_members": f"""SELECT doc_id, 1 AS depth, 'a/page.html' AS name, {_LEN} AS length, sha256(coalesce(text, '')) AS sha256, false AS failed FROM documents
UNION ALL SELECT doc_id, 1, 'inner.zip', 6, sha256('second'), false FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 2, '', 0, '', true FROM documents WHERE doc_id % 4 = 1""",
    "pdf_members": f"""SELECT doc_id, 1 AS depth, 'embedded-1.jpg' AS name, 8 AS length, sha256('\\xFF\\xD8jpeg\\xFF\\xD9'::BLOB) AS sha256 FROM documents
UNION ALL SELECT doc_id, 1, 'embedded-2.svg', {_LEN} + 11, sha256('<svg>' || coalesce(text, '') || '</svg>') FROM documents""",
    "png_malformed": f"""WITH d AS (SELECT doc_id, {_LEN} AS n FROM documents)
SELECT doc_id, 'png_metadata_chunk' AS detector, 'tEXt' AS location, '{{"chunk_type":"tEXt","length":' || n || '}}' AS evidence, 'informational' AS risk FROM d
UNION ALL SELECT doc_id, 'png_malformed_chunk', 'byte:' || (20 + n), '{{}}', 'high' FROM d WHERE doc_id % 4 = 1""",
    "metadata_fields": "SELECT doc_id, 'format_metadata_fields' AS detector, '' AS location, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{{\"fields\":[" + ",".join(f'"{f}"' for f in fields) + "]}'" for k, (_, _, fields) in _FIELDS.items()) + " END AS evidence, 'informational' AS risk FROM documents",
    "search_ranges": """WITH d AS (SELECT doc_id, unnest(range(doc_id % 3)) AS k FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 17 ELSE 6 END + 3 * k AS byte_off, 'ZWC' AS category, 'zero width space' AS name FROM d""",
    "hit_cap": "SELECT doc_id, least(5, 2 * (doc_id % 6)) AS kept, doc_id % 6 AS spaces, greatest(6 * (doc_id % 6) - 3, CASE WHEN doc_id % 6 > 2 THEN 0 ELSE 6 * (doc_id % 6) - 6 END) AS last, doc_id % 6 > 2 AS over_limit FROM documents WHERE doc_id % 6 > 0",
    "incomplete_verdicts": f"{_COUNTED} SELECT doc_id, hidden + \"trailing\" > {CAP} AS incomplete, hidden + \"trailing\" > {CAP} AS told, least({CAP}, hidden + \"trailing\")::BIGINT AS kept FROM sev",
    "text_diff": """SELECT doc_id, '--- ' || doc_id || '.txt' || chr(10) || '+++ ' || doc_id || '.sanitized.txt' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' kept' || chr(10) || '-word ' || doc_id || chr(8203) || ' ' || chr(10) || '+word ' || doc_id || chr(10) AS diff, true AS changed, 1 AS zero_width_removed FROM documents""",
    "lsb_regular_singular": f"{_RS} SELECT channel, corrected, round(r_m, 6) AS r_m, round(s_m, 6) AS s_m, round(r_n, 6) AS r_n, round(s_n, 6) AS s_n, round(estimate, 6) AS estimate, estimate > 0.15 AS suspicious FROM rs",
    "lsb_block_entropy": _PIX.rstrip() + """,
no AS (SELECT channel, row, row_number() OVER (PARTITION BY channel ORDER BY row) - 1 AS r FROM (SELECT DISTINCT channel, row FROM px)),
sz AS (SELECT channel, max(col) + 1 AS width, count(DISTINCT row) AS rows, greatest(4, least(16, (max(col) + 1) // 2)) AS side FROM px GROUP BY channel),
bk AS (SELECT px.channel, r // side AS x, col // side AS y, avg(v % 2) AS p FROM px JOIN no ON px.channel = no.channel AND px.row = no.row JOIN sz ON px.channel = sz.channel WHERE r < rows // side * side AND col < width // side * side GROUP BY ALL),
be AS (SELECT channel, CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0e0 END AS e FROM bk)
SELECT channel, count(*) AS blocks, round(avg(e), 6) AS block_mean, round(var_pop(e), 6) AS block_variance FROM be GROUP BY channel""",
    "lsb_palette": f"{_PAL} SELECT channel, colours, round(entropy, 6) AS entropy, sorted, round(usage_cv, 6) AS usage_cv, suspicious FROM pb",
    "lsb_full_vote": f"{_PAL} SELECT channel, votes, votes >= 2 AS suspicious FROM vt",
    "lsb_verdicts": f"""{_PAL}, im AS (SELECT unnest(['all', 'mod3_' || channel % 3, 'only_' || channel]) AS image, votes >= 1 AS s FROM vt),
nm AS (SELECT image, count(*) FILTER (s) AS n FROM im GROUP BY image)
SELECT image, n AS suspicious_channels, CASE WHEN n = 0 THEN 'CLEAN' WHEN n <= 2 THEN 'SUSPICIOUS' ELSE 'LIKELY_STEGO' END AS verdict, round(CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 0.45 WHEN n = 2 THEN 0.65 ELSE least(0.99, 0.80 + (n - 3) * 0.06) END, 6)::DOUBLE AS confidence FROM nm""",
}
