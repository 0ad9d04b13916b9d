"""Registered queries over the driver's tables: each applies the library's functions to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.functions import lsb, severity, text
from glyphtrace.limits import ScanLimits
from glyphtrace.operators.containers import expand
from glyphtrace.operators.formats import PNG
from glyphtrace.operators.structure import structure_findings
from glyphtrace.plans.carriers import carriers, carriers_sql
from glyphtrace.plans.scan import Hooks, examined, scan
from glyphtrace.sources.assets import from_column, with_text


def _carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _counts(spark, sf_dir) -> DataFrame:
    return _carriers(spark, sf_dir).select(
        "doc_id", "source", "injected", "t", text.zero_width_count("t").alias("zero_width"), text.homoglyph_count("t").alias("homoglyphs"), text.suspicious_count("t").alias("suspicious"),
        text.trailing_lines("t").alias("trailing"), text.mixed_line_endings("t").alias("mixed"), (F.size(text.layout_patterns("t")) > 0).alias("attention"),
    ).withColumn("hidden", F.col("zero_width") + F.col("homoglyphs") + F.col("suspicious"))


def zero_width_counts(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", text.zero_width_count("t").alias("zero_width"))


def homoglyph_counts(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", text.homoglyph_count("t").alias("homoglyphs"))


def suspicious_counts(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", text.suspicious_count("t").alias("suspicious"))


def character_positions(spark, sf_dir):
    return text.character_findings(_carriers(spark, sf_dir), "doc_id", "t").filter("kind <> 'trailing'").select(F.col("id").alias("doc_id"), "kind", "line", "col", "abs_i", "byte_off", "char", "name")


def trailing_whitespace_lines(spark, sf_dir):
    return text.character_findings(_carriers(spark, sf_dir), "doc_id", "t").filter("kind = 'trailing'").select(F.col("id").alias("doc_id"), "line", F.col("count").cast("long").alias("trailing_count"), "byte_off")


def mixed_line_endings(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", text.line_endings("t").alias("e"), text.mixed_line_endings("t").alias("mixed")).select("doc_id", *[F.col(f"e.{k}").cast("long").alias(k) for k in ("crlf", "lf", "cr")], "mixed")


CAP = 40


def finding_cap(spark, sf_dir):
    found = text.capped(text.character_findings(_carriers(spark, sf_dir), "doc_id", "t"), CAP)
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("kept"), F.max("ord").cast("long").alias("last_ord"), F.max("abs_i").alias("last_abs_i"), F.bool_or("over_limit").alias("over_limit"))


def typography_intervals(spark, sf_dir):
    d, p = text.double_spaces("t").alias("double_spaces"), text.punctuation_intervals("t").alias("intervals")
    return _carriers(spark, sf_dir).select("doc_id", d, p).withColumn("found", (F.col("double_spaces") >= 3) | (F.col("intervals") >= 2))


def hidden_layout(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", F.array_join(text.layout_patterns("t"), ",").alias("patterns"))


def external_urls(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", F.array_join(text.external_urls("t"), " ").alias("urls"))


def fingerprint_markers(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", F.array_join(text.fingerprint_markers("t"), ",").alias("markers"))


def robust_markers(spark, sf_dir):
    names = sorted({m for table in dims.ROBUST_MARKERS.values() for m in table})
    marked = _carriers(spark, sf_dir).select("doc_id", F.lower(F.concat("t", F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("doc_id", F.lit(len(names))) + 1).cast("int")))).alias("t"))
    return marked.select("doc_id", *[F.array_join(text.markers(F.col("t"), table), ",").alias(kind.lower()) for kind, table in dims.ROBUST_MARKERS.items()])


def html_comment_metadata(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.coalesce(F.col("html").rlike(r"(?s)<!--.*?-->"), F.lit(False)).alias("text_comment"), F.array_join(text.layout_patterns("html"), ",").alias("patterns"), F.size(text.external_urls("html")).cast("long").alias("urls"))


def decode_zero_width(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", text.zero_width_bits("t").alias("bits"), text.decode_zero_width("t").alias("decoded"))


def decode_trailing(spark, sf_dir):
    rows = _carriers(spark, sf_dir).select("doc_id", text.trailing_bits("t").alias("bits"))
    return rows.select("doc_id", "bits", text.decode_bits(F.col("bits"))["text"].alias("decoded"))


def decode_line_endings(spark, sf_dir):
    rows = _carriers(spark, sf_dir).select("doc_id", text.line_ending_bits("t").alias("bits"))
    return rows.select("doc_id", "bits", text.decode_bits(F.col("bits"))["text"].alias("decoded"))


def normalize_homoglyphs(spark, sf_dir):
    return _carriers(spark, sf_dir).select("doc_id", F.sha2(text.normalize_homoglyphs("t"), 256).alias("sha256"), text.homoglyph_count("t").alias("replaced"))


def sanitize_text(spark, sf_dir):
    rows = _carriers(spark, sf_dir).select("doc_id", "t", text.sanitize("t").alias("s"))
    kept = ["zero_width_removed", "bidi_removed", "homoglyphs_replaced", "trailing_whitespace_removed", "line_endings_normalized"]
    return rows.select("doc_id", F.sha2("t", 256).alias("sha256_before"), F.sha2("s.text", 256).alias("sha256_after"), *[F.col(f"s.{k}").alias(k) for k in kept])


def severity_(spark, sf_dir, *keep):
    rows = _counts(spark, sf_dir)
    base = severity.base_severity(F.col("hidden"), F.col("trailing"), F.col("mixed"))
    flagged = (F.col("hidden") > 0) | (F.col("trailing") > 0) | F.col("mixed") | F.col("attention")
    return rows.select("doc_id", "hidden", "trailing", "mixed", "attention", severity.severity(base, F.col("attention")).alias("severity"), flagged.alias("flagged"), *keep)


def family_severity(spark, sf_dir):
    found = text.character_findings(_carriers(spark, sf_dir), "doc_id", "t")
    per = found.groupBy(F.col("id").alias("doc_id"), "kind").agg(
        F.count("*").alias("n"), F.count_distinct("char").alias("kinds"), F.count_distinct(F.split("name", " ")[0]).alias("scripts"), F.count_distinct("count").alias("lengths"), F.max("count").alias("longest"), F.sum("count").alias("total"),
        F.bool_or(F.col("char") == "\u202e").alias("override"), F.bool_or(F.col("char").between("\u202a", "\u202e")).alias("direction"),
    )
    s = F.when(F.col("kind") == "zero_width", severity.zero_width_severity(F.col("n"), F.col("kinds"))).when(F.col("kind") == "homoglyph", severity.homoglyph_severity(F.col("n"), F.col("scripts")))
    s = s.when(F.col("kind") == "suspicious", severity.suspicious_severity(F.col("n"), F.col("override"), F.col("direction"))).otherwise(severity.trailing_severity(F.col("lengths"), F.col("longest"), F.col("total")))
    return per.select("doc_id", "kind", "n", s.alias("severity"))


def corpus_summary(spark, sf_dir):
    return severity.summary(severity_(spark, sf_dir).withColumn("incomplete", F.col("doc_id") % 97 == 96))


def folder_rollup(spark, sf_dir):
    rows = severity_(spark, sf_dir, F.col("source").alias("folder"))
    return rows.rollup("folder").agg(F.count("*").alias("files"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("severity") == "critical").alias("critical"), F.sum("hidden").alias("hidden"))


def evaluation_metrics(spark, sf_dir):
    rows = _counts(spark, sf_dir).select(F.col("injected").alias("family"), (F.col("injected") != "clean").alias("expected"), ((F.col("hidden") > 0) | (F.col("trailing") > 0) | F.col("mixed")).alias("observed"))
    return severity.metrics(rows)


def _pixels(spark, sf_dir) -> DataFrame:
    """Embeddings as grey images: a row of pixels per vector, a channel per label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.least(F.greatest(F.floor(F.col("x").cast("double") * 128.0 + 128.0), F.lit(0)), F.lit(255)).cast("long")
    return vectors.select(F.col("label").alias("channel"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x")).select("channel", "row", "col", v.alias("v"))


def lsb_chi_square(spark, sf_dir):
    return lsb.chi_square(_pixels(spark, sf_dir)).select("channel", F.round("chi_sq", 4).alias("chi_sq"), F.col("df").cast("long").alias("df"), "suspicious")


def lsb_sample_pairs(spark, sf_dir):
    return lsb.sample_pairs(_pixels(spark, sf_dir)).select("channel", "w", "x", "y", "z", F.round("estimate", 6).alias("estimate"), "suspicious")


def lsb_entropy(spark, sf_dir):
    return lsb.entropy(_pixels(spark, sf_dir)).select("channel", "n", F.round("balance", 6).alias("balance"), F.round("entropy", 6).alias("entropy"), "suspicious")


def lsb_vote(spark, sf_dir):
    return lsb.vote(_pixels(spark, sf_dir)).select("channel", F.col("votes").cast("long").alias("votes"), "suspicious")


def binary_hits(spark, sf_dir):
    from glyphtrace.operators.binary import byte_hits

    assets = _carriers(spark, sf_dir).select(F.col("doc_id").cast("string").alias("asset_id"), F.lit(".bin").alias("suffix"), F.encode("t", "UTF-8").alias("content"))
    return byte_hits(assets).select(F.col("asset_id").cast("long").alias("doc_id"), "byte_off", "category", "char", "context")


def _number(n, little: bool = False):
    """Four bytes of a column of numbers."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]) if little else h)


def _raw(text_: str):
    return F.lit(bytearray(text_.encode("latin-1")))


def _chunk(name: str, data):
    return F.concat(_number(F.octet_length(data)), _raw(name), data, _raw("\0\0\0\0"))


def _binary(spark, sf_dir, content, suffix) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    return with_text(from_column(docs.select("doc_id", content.alias("c"), F.concat(F.lit("f"), suffix).alias("name")), "doc_id", "c", "name"))


def png_structure(spark, sf_dir):
    """Documents as text chunks of PNG files, some with a private chunk, some with bytes after the end."""
    nothing = F.lit(bytearray())
    private = F.when(F.col("doc_id") % 5 == 0, _chunk("vpAg", nothing)).otherwise(nothing)
    tail = F.when(F.col("doc_id") % 3 == 0, _raw("tail")).otherwise(nothing)
    content = F.concat(F.lit(bytearray(PNG)), _chunk("tEXt", F.col("b")), private, _chunk("IEND", nothing), tail)
    return structure_findings(_binary(spark, sf_dir, content, F.lit(".png"))).select(F.col("asset_id").cast("long").alias("doc_id"), "detector", "location", "evidence", "risk")


def media_structure(spark, sf_dir):
    """Documents inside RIFF, ISO media, PDF and layered image files."""
    kind, b, n = F.pmod("doc_id", F.lit(4)), F.col("b"), F.octet_length("b")
    riff = F.concat(_raw("RIFF"), _number(F.lit(4), True), _raw("WAVE"), b)
    media = F.concat(_number(F.lit(12)), _raw("ftypisom"), _number(n + 8), _raw("free"), b, _raw("rest"))
    pdf = F.concat(_raw("%PDF /Author /EmbeddedFile "), b)
    layers = F.concat(_raw("8BPS"), F.encode(F.repeat(F.lit("8BIM"), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), "UTF-8"), b)
    content = F.when(kind == 0, riff).when(kind == 1, media).when(kind == 2, pdf).otherwise(layers)
    found = structure_findings(_binary(spark, sf_dir, content, F.when(kind == 0, ".wav").when(kind == 1, ".mp4").when(kind == 2, ".pdf").otherwise(".psd")))
    return found.filter(F.col("detector").isin(*_MEDIA_DETECTORS)).select(F.col("asset_id").cast("long").alias("doc_id"), "detector", "location", "evidence", "risk")


_MEDIA_DETECTORS = ["riff_appended_data", "bmff_private_box", "bmff_appended_data", "pdf_hidden_structure", "psd_layer_structure"]


def data_uri_members(spark, sf_dir):
    """Pages with their own address as an embedded image, opened as members."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    body = F.concat(F.coalesce("html", F.lit("")), F.lit('<img src="data:image/png;base64,'), F.base64(F.encode("url", "UTF-8")), F.lit('">'))
    assets = from_column(pages.select("page_id", body.alias("c")), "page_id", "c", suffix=".html")
    return expand(assets).select(F.col("root_id").cast("long").alias("page_id"), "name", "length", F.sha2("content", 256).alias("sha256"))


def provenance_status(spark, sf_dir):
    """Documents as PNG files, every second one with a claim chunk: status and risk of what is found."""
    nothing = F.lit(bytearray())
    claim = F.when(F.col("doc_id") % 2 == 0, _chunk("caBX", _raw('{"provider": "p"}'))).otherwise(nothing)
    assets = _binary(spark, sf_dir, F.concat(F.lit(bytearray(PNG)), claim, _chunk("tEXt", F.col("b")), _chunk("IEND", nothing)), F.lit(".png"))
    looked = examined(assets, Hooks(), ScanLimits())
    said = lambda k: F.get_json_object("provenance", f"$.{k}").alias(k)
    return looked.select(F.col("asset_id").cast("long").alias("doc_id"), said("status"), said("provider"), said("manifest_location"), F.size("findings").cast("long").alias("findings"), F.get_json_object("robust", "$.IMAGE_ROBUST.status").alias("image_robust"))


def asset_verdicts(spark, sf_dir):
    """The whole scan over documents with injected content, by the column source."""
    v = scan(from_column(_carriers(spark, sf_dir), "doc_id", "t"))["verdicts"]
    return v.select(F.col("asset_id").cast("long").alias("doc_id"), F.col("every_hidden").cast("long").alias("hidden"), F.col("every_trailing").cast("long").alias("trailing"), "mixed", "attention", "severity", "flagged")


QUERIES = {
    "png_structure": png_structure, "media_structure": media_structure, "data_uri_members": data_uri_members, "provenance_status": provenance_status, "asset_verdicts": asset_verdicts,
    "zero_width_counts": zero_width_counts, "homoglyph_counts": homoglyph_counts, "suspicious_counts": suspicious_counts, "character_positions": character_positions,
    "trailing_whitespace_lines": trailing_whitespace_lines, "mixed_line_endings": mixed_line_endings, "finding_cap": finding_cap, "typography_intervals": typography_intervals,
    "hidden_layout": hidden_layout, "external_urls": external_urls, "fingerprint_markers": fingerprint_markers, "robust_markers": robust_markers, "html_comment_metadata": html_comment_metadata,
    "decode_zero_width": decode_zero_width, "decode_trailing": decode_trailing, "decode_line_endings": decode_line_endings, "normalize_homoglyphs": normalize_homoglyphs, "sanitize_text": sanitize_text,
    "severity": severity_, "family_severity": family_severity, "corpus_summary": corpus_summary, "folder_rollup": folder_rollup, "evaluation_metrics": evaluation_metrics,
    "lsb_chi_square": lsb_chi_square, "lsb_sample_pairs": lsb_sample_pairs, "lsb_entropy": lsb_entropy, "lsb_vote": lsb_vote, "binary_hits": binary_hits,
}


# DuckDB

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_C = "WITH " + carriers_sql()
_CLASS = lambda cs: "[" + "".join(f"\\x{{{ord(c):X}}}" for c in cs) + "]"
_N = lambda pattern, t="t": f"len(regexp_extract_all({t}, '{pattern}'))::BIGINT"
_B = dims.BREAKS.replace(r"\x0B", r"\v").replace(r"\x0C", r"\f")
_ZW3, _DOT = "\u200b\u200c\u200d", "\u00b7"
_ZW, _HG, _OT = (_CLASS(x) for x in (text.ZERO_WIDTH, text.HOMOGLYPHS, text.SUSPICIOUS))
_TRAIL = rf"([ \t]+)(?:\r\n|[{_B}]|$)"
_LAYOUT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{t}}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in dims.LAYOUT_PATTERNS.items()) + "], lambda x: x IS NOT NULL)"
_URL = f"list_sort(list_distinct(list_transform(regexp_extract_all({{t}}, '(?i){dims.URL_PATTERN.replace(chr(39), chr(39) * 2)}'), lambda u: rtrim(u, '{dims.URL_TAIL}'))))[1:20]"
_MARK = lambda table, t: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains({t}, {_Q(m)}) THEN '{n}' END" for m, n in table.items()) + "], lambda x: x IS NOT NULL))), ',')"
_TRAILING = rf"len(regexp_extract_all(t, '[ \t]+(?:\r|\n|$)'))::BIGINT"  # carriers hold no other breaks
_MIX = r"(((len(regexp_extract_all(t, '\r\n')) > 0)::INT + (len(regexp_extract_all(t, '\n')) > len(regexp_extract_all(t, '\r\n')))::INT + (len(regexp_extract_all(t, '\r')) > len(regexp_extract_all(t, '\r\n')))::INT) > 1)"
_BYTES = lambda bits: f"(CASE WHEN length({bits}) >= 8 THEN array_to_string(list_transform(range(0, length({bits}) // 8), lambda i: chr(list_sum(list_transform(range(0, 8), lambda k: (substr({bits}, (i * 8 + k + 1)::BIGINT, 1)::INT * (1 << (7 - k)::INT))))::INT)), '') ELSE '' END)"
_NAMES = "MAP {" + ", ".join(f"{_Q(c)}: {_Q(n)}" for c, n in {**dims.ZERO_WIDTH, **{c: n for c, (_, n) in dims.HOMOGLYPHS.items()}, **dims.SUSPICIOUS}.items()) + "}"
_EVERY = _Q(text.ZERO_WIDTH + text.HOMOGLYPHS + text.SUSPICIOUS)
_FOUND = rf"""{_C},
hit AS (SELECT doc_id, t FROM carriers WHERE regexp_matches(t, '{_CLASS(text.ZERO_WIDTH + text.HOMOGLYPHS + text.SUSPICIOUS)}') OR regexp_matches(t, '[ \t](?:\r|\n|$)')),
ln AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$')) AS s, generate_subscripts(regexp_extract_all(t, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$'), 1) AS line FROM hit),
lo AS (SELECT *, coalesce(sum(length(s)) OVER w, 0)::BIGINT AS c0, coalesce(sum(octet_length(encode(s))) OVER w, 0)::BIGINT AS b0 FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bd AS (SELECT *, rtrim(s, chr(13) || chr(10)) AS body FROM lo),
ch AS (SELECT doc_id, line, c0, b0, s, unnest(string_split(s, '')) AS char, generate_subscripts(string_split(s, ''), 1) AS col FROM bd WHERE regexp_matches(s, '{_CLASS(text.ZERO_WIDTH + text.HOMOGLYPHS + text.SUSPICIOUS)}')),
found AS (
  SELECT doc_id, CASE WHEN contains({_Q(text.ZERO_WIDTH)}, char) THEN 'zero_width' WHEN contains({_Q(text.HOMOGLYPHS)}, char) THEN 'homoglyph' ELSE 'suspicious' END AS kind, line, col, c0 + col - 1 AS abs_i,
         b0 + octet_length(encode(left(s, (col - 1)::BIGINT))) AS byte_off, char, ({_NAMES})[char] AS name, 1 AS count, 1 AS k FROM ch WHERE char <> '' AND contains({_EVERY}, char)
  UNION ALL
  SELECT doc_id, 'trailing', line, length(rtrim(body, ' ' || chr(9))) + 1, c0 + length(rtrim(body, ' ' || chr(9))), b0 + octet_length(encode(rtrim(body, ' ' || chr(9)))), '', 'trailing whitespace', length(body) - length(rtrim(body, ' ' || chr(9))), 0
  FROM bd WHERE length(body) > length(rtrim(body, ' ' || chr(9)))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k, col) AS ord FROM found)
"""
_COUNTED = rf"""{_C}, n AS (SELECT doc_id, source, injected, {_N(_ZW)} + {_N(_HG)} + {_N(_OT)} AS hidden, {_TRAILING} AS "trailing", {_MIX} AS mixed, len({_LAYOUT.replace("{t}", "t")}) > 0 AS attention FROM carriers),
b AS (SELECT *, hidden + "trailing" * 0.5 + CASE WHEN mixed THEN 5 ELSE 0 END AS score FROM n),
v AS (SELECT *, CASE WHEN score = 0 THEN 'clean' WHEN score >= 20 THEN 'critical' WHEN score >= 8 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS base FROM b),
sev AS (SELECT doc_id, source, injected, hidden, "trailing", mixed, attention, CASE WHEN attention AND base IN ('clean', 'low', 'medium') THEN 'high' ELSE base END AS severity, hidden > 0 OR "trailing" > 0 OR mixed OR attention AS flagged FROM v)
"""
_PIX = """WITH e AS (SELECT label AS channel, vec_id AS row, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings),
px AS (SELECT channel, row, col, least(greatest(floor(x * 128e0 + 128e0), 0), 255)::BIGINT AS v FROM e),
h AS (SELECT channel, v, count(*) AS n FROM px GROUP BY ALL),
pr AS (SELECT channel, v // 2 AS k, sum(CASE WHEN v % 2 = 0 THEN n ELSE 0 END)::DOUBLE AS e, sum(CASE WHEN v % 2 = 1 THEN n ELSE 0 END)::DOUBLE AS o FROM h GROUP BY ALL),
cs AS (SELECT channel, coalesce(sum(CASE WHEN (e + o) / 2 >= 1 THEN (e - (e + o) / 2) * (e - (e + o) / 2) / ((e + o) / 2) + (o - (e + o) / 2) * (o - (e + o) / 2) / ((e + o) / 2) END), 0e0) AS chi_sq,
       greatest(count(CASE WHEN (e + o) / 2 >= 1 THEN 1 END) - 1, 1)::BIGINT AS df FROM pr GROUP BY channel),
chi AS (SELECT *, (pow(chi_sq / df, 1e0 / 3e0) - (1e0 - 2e0 / (9e0 * df))) / sqrt(2e0 / (9e0 * df)) < 0.5244005127080407 AS suspicious FROM cs),
ld AS (SELECT channel, v AS u, lead(v) OVER (PARTITION BY channel, row ORDER BY col) AS v FROM px),
kd AS (SELECT channel, CASE WHEN u - u % 2 = v - v % 2 THEN 'w' WHEN abs(u - v) = 1 THEN 'x' WHEN u - u % 2 = v - v % 2 - 2 THEN 'y' WHEN v - v % 2 = u - u % 2 - 2 THEN 'z' END AS kind FROM ld WHERE v IS NOT NULL),
ct AS (SELECT channel, count(*) FILTER (kind = 'w') AS w, count(*) FILTER (kind = 'x') AS x, count(*) FILTER (kind = 'y') AS y, count(*) FILTER (kind = 'z') AS z FROM kd GROUP BY channel),
rt AS (SELECT *, (w + x + y + z)::DOUBLE AS total FROM ct),
es AS (SELECT *, CASE WHEN total > 0 AND abs(2e0 * (w / total - y / total - z / total + x / total)) >= 1e-10 THEN (x / total) / (2e0 * (w / total - y / total - z / total + x / total)) END AS raw FROM rt),
sp AS (SELECT channel, w, x, y, z, CASE WHEN raw BETWEEN 0 AND 1 THEN raw END AS estimate, coalesce(raw BETWEEN 0 AND 1 AND raw > 0.15, false) AS suspicious FROM es),
en AS (SELECT channel, count(*) AS n, sum(v % 2)::DOUBLE / count(*) AS balance FROM px GROUP BY channel),
ent AS (SELECT *, CASE WHEN balance > 0 AND balance < 1 THEN -(balance * log2(balance) + (1 - balance) * log2(1 - balance)) ELSE 0e0 END AS entropy FROM en),
enf AS (SELECT *, n >= 64 AND entropy >= 0.9999 AND balance > 0.49 AND balance < 0.51 AS suspicious FROM ent)
"""
_ROBUST = sorted({m for table in dims.ROBUST_MARKERS.values() for m in table})
_BIN = {c: "ZWC" if c in dims.ZERO_WIDTH else "BIDI" for c in dims.BINARY_ORDER}

_LEN = "octet_length(encode(coalesce(text, '')))"
ORACLES = {
    "png_structure": f"""WITH d AS (SELECT doc_id, {_LEN} AS n FROM documents)
SELECT doc_id, 'png_metadata_chunk' AS detector, 'tEXt' AS location, '{{"chunk_type":"tEXt","length":' || n || '}}' AS evidence, 'informational' AS risk FROM d
UNION ALL SELECT doc_id, 'png_private_chunk', '', '{{"chunk_types":["vpAg"]}}', 'medium' FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'png_appended_data', 'byte:' || (8 + 12 + n + CASE WHEN doc_id % 5 = 0 THEN 12 ELSE 0 END + 12), '{{"appended_bytes":4}}', 'high' FROM d WHERE doc_id % 3 = 0""",
    "media_structure": f"""WITH d AS (SELECT doc_id, {_LEN} AS n, (doc_id % 4) AS kind FROM documents)
SELECT doc_id, 'riff_appended_data' AS detector, 'byte:12' AS location, '{{"appended_bytes":' || n || '}}' AS evidence, 'high' AS risk FROM d WHERE kind = 0 AND n > 0
UNION ALL SELECT doc_id, 'bmff_private_box', '', '{{"box_types":["free"]}}', 'medium' FROM d WHERE kind = 1
UNION ALL SELECT doc_id, 'bmff_appended_data', 'byte:' || (20 + n), '{{"appended_bytes":4}}', 'high' FROM d WHERE kind = 1
UNION ALL SELECT doc_id, 'pdf_hidden_structure', '', '{{"structures":["embedded file"]}}', 'high' FROM d WHERE kind = 2
UNION ALL SELECT doc_id, 'psd_layer_structure', '', '{{"resource_markers":' || (doc_id % 3 + 1) || '}}', 'informational' FROM d WHERE kind = 3""",
    "data_uri_members": "SELECT page_id, 'data-uri-1.png' AS name, octet_length(encode(url)) AS length, sha256(url) AS sha256 FROM pages",
    "provenance_status": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'NOT_CHECKED' ELSE 'MISSING' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE '' END AS provider, CASE WHEN doc_id % 2 = 0 THEN 'embedded' ELSE '' END AS manifest_location,
CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS findings, 'NOT_CHECKED' AS image_robust FROM documents""",
    "asset_verdicts": f"{_COUNTED} SELECT doc_id, hidden, \"trailing\", mixed, attention, severity, flagged FROM sev",
    "zero_width_counts": f"{_C} SELECT doc_id, {_N(_ZW)} AS zero_width FROM carriers",
    "homoglyph_counts": f"{_C} SELECT doc_id, {_N(_HG)} AS homoglyphs FROM carriers",
    "suspicious_counts": f"{_C} SELECT doc_id, {_N(_OT)} AS suspicious FROM carriers",
    "character_positions": f"{_FOUND} SELECT doc_id, kind, line::INT AS line, col::INT AS col, abs_i, byte_off, char, name FROM ordered WHERE kind <> 'trailing'",
    "trailing_whitespace_lines": f"{_FOUND} SELECT doc_id, line::INT AS line, count::BIGINT AS trailing_count, byte_off FROM ordered WHERE kind = 'trailing'",
    "mixed_line_endings": rf"{_C} SELECT doc_id, {_N(chr(92) + 'r' + chr(92) + 'n')} AS crlf, {_N(chr(92) + 'n')} - {_N(chr(92) + 'r' + chr(92) + 'n')} AS lf, {_N(chr(92) + 'r')} - {_N(chr(92) + 'r' + chr(92) + 'n')} AS cr, {_MIX} AS mixed FROM carriers",
    "finding_cap": f"{_FOUND} SELECT doc_id, count(*) FILTER (ord <= {CAP}) AS kept, max(ord) FILTER (ord <= {CAP}) AS last_ord, max(abs_i) FILTER (ord <= {CAP}) AS last_abs_i, max(ord) > {CAP} AS over_limit FROM ordered GROUP BY doc_id",
    "typography_intervals": f"{_C}, a AS (SELECT doc_id, len(list_filter(regexp_extract_all(t, ' +'), lambda x: length(x) = 2))::BIGINT AS double_spaces, {_N(dims.TYPOGRAPHY_PATTERN)} AS intervals FROM carriers) SELECT *, double_spaces >= 3 OR intervals >= 2 AS found FROM a",
    "hidden_layout": f"{_C} SELECT doc_id, array_to_string({_LAYOUT.replace("{t}", "t")}, ',') AS patterns FROM carriers",
    "external_urls": f"{_C} SELECT doc_id, array_to_string({_URL.replace("{t}", "t")}, ' ') AS urls FROM carriers",
    "fingerprint_markers": f"{_C} SELECT doc_id, {_MARK(dims.FINGERPRINT_MARKERS, 'lower(t)')} AS markers FROM carriers",
    "robust_markers": f"{_C}, m AS (SELECT doc_id, lower(t || [{', '.join(_Q(x) for x in _ROBUST)}][doc_id % {len(_ROBUST)} + 1]) AS t FROM carriers) SELECT doc_id, " + ", ".join(f"{_MARK(table, 't')} AS {kind.lower()}" for kind, table in dims.ROBUST_MARKERS.items()) + " FROM m",
    "html_comment_metadata": f"SELECT page_id, coalesce(regexp_matches(html, '(?s)<!--.*?-->'), false) AS text_comment, coalesce(array_to_string({_LAYOUT.replace("{t}", "html")}, ','), '') AS patterns, coalesce(len({_URL.replace("{t}", "html")}), 0)::BIGINT AS urls FROM pages",
    "decode_zero_width": rf"{_C}, z AS (SELECT doc_id, translate(regexp_replace(t, '[^\x{{200B}}\x{{200C}}\x{{200D}}]', '', 'g'), '{_ZW3}', '011') AS bits FROM carriers), d AS (SELECT doc_id, bits, {_BYTES('bits')} AS s FROM z) SELECT doc_id, bits, CASE WHEN regexp_full_match(s, '[\x20-\x7E\x{{A1}}-\x{{AC}}\x{{AE}}-\x{{FF}}]*') THEN s ELSE '' END AS decoded FROM d",
    "decode_trailing": rf"{_C}, z AS (SELECT doc_id, translate(array_to_string(regexp_extract_all(t, '([ \t]+)(?:\r|\n|$)', 1), ''), ' ' || chr(9), '01') AS bits FROM carriers) SELECT doc_id, bits, {_BYTES('bits')} AS decoded FROM z",
    "decode_line_endings": rf"{_C}, z AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '\r\n|\n|\r'), lambda e: CASE WHEN length(e) = 2 THEN '1' ELSE '0' END), '') AS bits FROM carriers), d AS (SELECT doc_id, bits, {_BYTES('bits')} AS s FROM z) SELECT doc_id, bits, CASE WHEN length(bits) >= 8 AND len(regexp_extract_all(s, '[ -~\x{{A1}}-\x{{AC}}\x{{AE}}-\x{{FF}}\r\n\t]')) * 9 >= length(s) * 6 THEN s ELSE '' END AS decoded FROM d",
    "normalize_homoglyphs": f"{_C} SELECT doc_id, sha256(translate(t, '{text.HOMOGLYPHS}', '{text.LATIN}')) AS sha256, {_N(_HG)} AS replaced FROM carriers",
    "sanitize_text": rf"{_C}, a AS (SELECT doc_id, t, translate(t, '{text.HOMOGLYPHS}{text.ZERO_WIDTH}{dims.BIDI}', '{text.LATIN}') AS u FROM carriers), b AS (SELECT *, regexp_replace(u, '[ \t]+(\r\n|\r|\n|$)', '\1', 'g') AS w FROM a) SELECT doc_id, sha256(t) AS sha256_before, sha256(regexp_replace(w, '\r\n|\r', chr(10), 'g')) AS sha256_after, {_N(_ZW)} AS zero_width_removed, {_N(_CLASS(dims.BIDI))} AS bidi_removed, {_N(_HG)} AS homoglyphs_replaced, length(u) - length(w) AS trailing_whitespace_removed, {_N(chr(92) + 'r' + chr(92) + 'n|' + chr(92) + 'r', 'w')} AS line_endings_normalized FROM b",
    "severity": f"{_COUNTED} SELECT doc_id, hidden, \"trailing\", mixed, attention, severity, flagged FROM sev",
    "family_severity": f"""{_FOUND}, p AS (SELECT doc_id, kind, count(*) AS n, count(DISTINCT char) AS kinds, count(DISTINCT string_split(name, ' ')[1]) AS scripts, count(DISTINCT count) AS lengths, max(count) AS longest, sum(count) AS total, bool_or(char = '\u202e') AS ov, bool_or(char BETWEEN '\u202a' AND '\u202e') AS dr FROM ordered GROUP BY ALL)
SELECT doc_id, kind, n, CASE kind WHEN 'zero_width' THEN CASE WHEN n >= 20 OR kinds >= 3 THEN 'HIGH' WHEN n >= 5 OR kinds >= 2 THEN 'MEDIUM' ELSE 'LOW' END WHEN 'homoglyph' THEN CASE WHEN n >= 5 OR scripts >= 2 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END
WHEN 'suspicious' THEN CASE WHEN ov THEN 'CRITICAL' WHEN dr OR n >= 5 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END ELSE CASE WHEN lengths <= 3 OR longest >= 8 OR total >= 30 THEN 'HIGH' WHEN longest >= 4 OR total >= 12 THEN 'MEDIUM' ELSE 'LOW' END END AS severity FROM p""",
    "corpus_summary": f"{_COUNTED}, i AS (SELECT *, doc_id % 97 = 96 AS incomplete FROM sev) SELECT count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (incomplete) AS incomplete, count(*) FILTER (NOT incomplete) AS completed, count(*) FILTER (NOT flagged AND NOT incomplete) AS clean FROM i",
    "folder_rollup": f"{_COUNTED} SELECT source AS folder, count(*) AS files, count(*) FILTER (flagged) AS flagged, count(*) FILTER (severity = 'critical') AS critical, sum(hidden)::BIGINT AS hidden FROM sev GROUP BY ROLLUP (source)",
    "evaluation_metrics": f"""{_COUNTED}, r AS (SELECT injected AS family, injected <> 'clean' AS e, hidden > 0 OR "trailing" > 0 OR mixed AS o FROM sev),
m AS (SELECT family, count(*) AS samples, count(*) FILTER (e AND o) AS tp, count(*) FILTER (NOT e AND NOT o) AS tn, count(*) FILTER (NOT e AND o) AS fp, count(*) FILTER (e AND NOT o) AS fn FROM r GROUP BY GROUPING SETS ((family), ()))
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate, round(fn / nullif(fn + tp, 0), 6) AS false_negative_rate FROM m""",
    "lsb_chi_square": f"{_PIX} SELECT channel, round(chi_sq, 4) AS chi_sq, df, suspicious FROM chi",
    "lsb_sample_pairs": f"{_PIX} SELECT channel, w, x, y, z, round(estimate, 6) AS estimate, suspicious FROM sp",
    "lsb_entropy": f"{_PIX} SELECT channel, n, round(balance, 6) AS balance, round(entropy, 6) AS entropy, suspicious FROM enf",
    "lsb_vote": f"{_PIX} SELECT channel, chi.suspicious::BIGINT + sp.suspicious::BIGINT + enf.suspicious::BIGINT AS votes, chi.suspicious::INT + sp.suspicious::INT + enf.suspicious::INT >= 2 AS suspicious FROM chi JOIN sp USING (channel) JOIN enf USING (channel)",
    "binary_hits": rf"""{_C}, c AS (SELECT doc_id, t, unnest(string_split(t, '')) AS char, generate_subscripts(string_split(t, ''), 1) AS i FROM carriers WHERE regexp_matches(t, '{_CLASS(dims.BINARY_ORDER)}')),
k AS (SELECT *, octet_length(encode(left(t, (i - 1)::BIGINT))) AS byte_off, octet_length(encode(char)) AS w, hex(encode(t)) AS hx FROM c WHERE char <> '' AND contains('{"".join(dims.BINARY_ORDER)}', char)),
x AS (SELECT *, greatest(0, byte_off - 25) AS a, least(length(hx) // 2, byte_off + w + 25) AS z FROM k)
SELECT doc_id, byte_off, CASE WHEN contains('{"".join(dims.ZERO_WIDTH)}', char) THEN 'ZWC' ELSE 'BIDI' END AS category, char,
array_to_string(list_transform(range(a, z), lambda j: CASE WHEN ('0x' || substr(hx, (j * 2 + 1)::BIGINT, 2))::INT BETWEEN 32 AND 126 THEN chr(('0x' || substr(hx, (j * 2 + 1)::BIGINT, 2))::INT) ELSE '{_DOT}' END), '') AS context FROM x""",
}
