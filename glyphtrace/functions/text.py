"""Hidden signals of text as Column expressions: counts, positions, patterns, decoding, sanitizing. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtrace import dims

ZERO_WIDTH, HOMOGLYPHS, SUSPICIOUS = "".join(dims.ZERO_WIDTH), "".join(dims.HOMOGLYPHS), "".join(dims.SUSPICIOUS)
LATIN = "".join(latin for latin, _ in dims.HOMOGLYPHS.values())
#: A line with its break; the last one may have none.
LINE = rf"[^{dims.BREAKS}]*(?:\r\n|[{dims.BREAKS}])|[^{dims.BREAKS}]+\z"
PRINTABLE_LATIN1 = r"^[\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{FF}]*$"


def _text(t) -> Column:
    return F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(""))


def count_of(t, characters: str) -> Column:
    """How many characters of a set a text has."""
    t = _text(t)
    return (F.length(t) - F.length(F.translate(t, characters, ""))).cast("long")


def zero_width_count(t) -> Column:
    return count_of(t, ZERO_WIDTH)


def homoglyph_count(t) -> Column:
    return count_of(t, HOMOGLYPHS)


def suspicious_count(t, extended_bidi: bool = False) -> Column:
    return count_of(t, SUSPICIOUS + (dims.FIRST_STRONG_ISOLATE if extended_bidi else ""))


def lines(t) -> Column:
    """Lines with their breaks, as Python's splitlines(keepends=True) gives them."""
    return F.regexp_extract_all(_text(t), F.lit(LINE), F.lit(0))


def trailing_length(line: Column) -> Column:
    """Spaces and tabs before the CR and LF that end a line."""
    body = F.rtrim(line, F.lit("\r\n"))
    return F.length(body) - F.length(F.rtrim(body, F.lit(" \t")))


def trailing_lines(t) -> Column:
    """How many lines end in spaces or tabs; only texts with such an end are cut into lines."""
    some = _text(t).rlike(rf"[ \t](?:[{dims.BREAKS}]|\z)")
    return F.when(some, F.size(F.filter(lines(t), lambda x: trailing_length(x) > 0))).otherwise(0).cast("long")


def line_endings(t) -> Column:
    """struct(crlf, lf, cr) of counts."""
    t = _text(t)
    both = F.regexp_count(t, F.lit(r"\r\n"))
    return F.struct(both.alias("crlf"), (F.regexp_count(t, F.lit(r"\n")) - both).alias("lf"), (F.regexp_count(t, F.lit(r"\r")) - both).alias("cr"))


def mixed_line_endings(t) -> Column:
    e = line_endings(t)
    return (e["crlf"] > 0).cast("int") + (e["lf"] > 0).cast("int") + (e["cr"] > 0).cast("int") > 1


def double_spaces(t) -> Column:
    """Runs of exactly two spaces."""
    return F.regexp_count(_text(t), F.lit("(?<! ) {2}(?! )")).cast("long")


def punctuation_intervals(t) -> Column:
    return F.regexp_count(_text(t), F.lit(dims.TYPOGRAPHY_PATTERN)).cast("long")


def layout_patterns(t) -> Column:
    """Names of the hiding styles that a text has, in table order."""
    return F.array_compact(F.array(*[F.when(_text(t).rlike(f"(?iu){p}"), F.lit(n)) for n, p in dims.LAYOUT_PATTERNS.items()]))


def external_urls(t, most: int = 20) -> Column:
    """Distinct URLs in order, without the punctuation that follows them."""
    found = F.regexp_extract_all(_text(t), F.lit(f"(?iu){dims.URL_PATTERN}"), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(dims.URL_TAIL))))), 1, most)


def markers(lowered: Column, table: dict[str, str]) -> Column:
    """Sorted distinct labels of the markers that a lower-cased text contains."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(m)), F.lit(n)) for m, n in table.items()]))))


def fingerprint_markers(t) -> Column:
    return markers(F.lower(_text(t)), dims.FINGERPRINT_MARKERS)


# decoding


def _bytes_of_bits(bits: Column) -> Column:
    """Whole bytes of a string of 0 and 1, most significant bit first."""
    n = F.floor(F.length(bits) / 8).cast("int")
    byte = lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    return F.when(n > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), byte), ""))).otherwise(F.lit(b""))


def zero_width_bits(t) -> Column:
    kept = F.regexp_replace(_text(t), "[^\u200b\u200c\u200d]", "")
    return F.translate(kept, "\u200b\u200c\u200d", "011")


def decode_zero_width(t) -> Column:
    """The payload of zero-width characters, if all of it is printable; else empty."""
    text = F.decode(_bytes_of_bits(zero_width_bits(t)), "ISO-8859-1")
    return F.when(text.rlike(PRINTABLE_LATIN1), text).otherwise("")


def trailing_bits(t) -> Column:
    """Tabs as 1 and spaces as 0 at the ends of lines."""
    runs = F.regexp_extract_all(_text(t), F.lit(rf"([ \t]+)(?:[{dims.BREAKS}]|\z)"), F.lit(1))
    return F.translate(F.array_join(runs, ""), " \t", "01")


def line_ending_bits(t) -> Column:
    """CR LF as 1, LF or CR alone as 0."""
    return F.array_join(F.transform(F.regexp_extract_all(_text(t), F.lit(r"\r\n|\n|\r"), F.lit(0)), lambda e: F.when(e == "\r\n", "1").otherwise("0")), "")


def decode_bits(bits: Column) -> Column:
    """struct(text, confidence): UTF-8 or else Latin-1; the text is kept from a confidence of 0.6 on."""
    raw = _bytes_of_bits(bits)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    printable = F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]|[ \r\n\t]"))
    confidence = F.when(F.length(bits) < 8, F.lit(0.0)).otherwise(printable / F.greatest(F.length(text), F.lit(1)) * F.lit(0.9))
    return F.struct(F.when(confidence >= 0.6, text).otherwise("").alias("text"), confidence.alias("confidence"))


def normalize_homoglyphs(t) -> Column:
    return F.translate(_text(t), HOMOGLYPHS, LATIN)


# sanitizing


def sanitize(t, extended_bidi: bool = False) -> Column:
    """struct(text, zero_width_removed, bidi_removed, homoglyphs_replaced, trailing_whitespace_removed, line_endings_normalized)."""
    t = _text(t)
    bidi = dims.BIDI + (dims.FIRST_STRONG_ISOLATE if extended_bidi else "")
    visible = F.translate(t, HOMOGLYPHS + ZERO_WIDTH + bidi, LATIN)
    trimmed = F.regexp_replace(visible, r"[ \t]+(\r\n|\r|\n|\z)", "$1")
    return F.struct(
        F.regexp_replace(trimmed, r"\r\n|\r", "\n").alias("text"),
        zero_width_count(t).alias("zero_width_removed"),
        count_of(t, bidi).alias("bidi_removed"),
        homoglyph_count(t).alias("homoglyphs_replaced"),
        (F.length(visible) - F.length(trimmed)).cast("long").alias("trailing_whitespace_removed"),
        F.regexp_count(trimmed, F.lit(r"\r\n|\r")).cast("long").alias("line_endings_normalized"),
    )


# positions


def character_findings(df: DataFrame, id_col: str, text_col: str, encoding_col: str | None = None) -> DataFrame:
    """Every finding of a text: id, ord, kind (zero_width, homoglyph, suspicious, trailing), line, col, abs_i, byte_off, char, name, count.

    Texts without findings leave before their lines are laid out; only flagged texts are shuffled, for the running offsets
    of lines. ord counts a text's findings in scan order: on each line the trailing run first, then characters.
    """
    names = {**dims.ZERO_WIDTH, **{c: n for c, (_, n) in dims.HOMOGLYPHS.items()}, **dims.SUSPICIOUS}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    every = ZERO_WIDTH + HOMOGLYPHS + SUSPICIOUS
    width = lambda s: F.octet_length(s) if encoding_col is None else F.when(F.col("_enc") == "latin-1", F.length(s)).otherwise(F.octet_length(s))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), *([F.col(encoding_col).alias("_enc")] if encoding_col else []))
    rows = rows.filter((count_of("_t", every) > 0) | F.col("_t").rlike(rf"[ \t](?:[{dims.BREAKS}]|\z)"))
    keep = ["id", *(["_enc"] if encoding_col else [])]
    laid = rows.select(*keep, F.posexplode(lines("_t")).alias("_k", "_line"))
    before = Window.partitionBy("id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    laid = laid.withColumn("_c", F.coalesce(F.sum(F.length("_line")).over(before), zero)).withColumn("_b", F.coalesce(F.sum(width(F.col("_line"))).over(before), zero))
    body = F.rtrim(F.col("_line"), F.lit("\r\n"))
    first = F.rtrim(body, F.lit(" \t"))
    item = lambda kind, i, ch, name, n: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), i.alias("i"), ch.alias("char"), name.alias("name"), n.alias("count"))
    kind = lambda c: F.when(F.contains(F.lit(ZERO_WIDTH), c), "zero_width").when(F.contains(F.lit(HOMOGLYPHS), c), "homoglyph").otherwise("suspicious")
    chars = F.filter(F.transform(F.split("_line", ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.contains(F.lit(every), x["c"]) & (x["c"] != ""))
    found = F.concat(
        F.when(F.length(body) > F.length(first), F.array(item("trailing", F.length(first), F.lit(""), F.lit("trailing whitespace"), F.length(body) - F.length(first)))).otherwise(F.array().cast("array<struct<kind:string,i:int,char:string,name:string,count:int>>")),
        F.transform(chars, lambda x: item(kind(x["c"]), x["i"], x["c"], F.element_at(table, x["c"]), F.lit(1))),
    )
    out = laid.filter((count_of("_line", every) > 0) | (F.length(body) > F.length(first))).select(*keep, "_k", "_line", "_c", "_b", F.posexplode(found).alias("_j", "x"))
    prefix = F.substring(F.col("_line"), F.lit(1), F.col("x.i"))
    out = out.select(
        "id", "_k", "_j", F.col("x.kind").alias("kind"), (F.col("_k") + 1).alias("line"), (F.col("x.i") + 1).alias("col"),
        (F.col("_c") + F.col("x.i")).alias("abs_i"), (F.col("_b") + width(prefix)).alias("byte_off"), F.col("x.char").alias("char"), F.col("x.name").alias("name"), F.col("x.count").alias("count"),
    )
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy("_k", "_j"))).drop("_k", "_j")


def capped(findings: DataFrame, most: int) -> DataFrame:
    """The first findings of each id, and whether there were more."""
    return findings.withColumn("over_limit", F.max("ord").over(Window.partitionBy("id")) > most).filter(F.col("ord") <= most)
