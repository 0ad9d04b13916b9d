import pytest
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.functions import severity, text

ZW = dims.ZERO_WIDTH


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


def bits(payload: str, zero: str, one_: str) -> str:
    return "".join({"0": zero, "1": one_}[b] for c in payload for b in f"{ord(c):08b}")


@pytest.mark.parametrize("zero,one_", [("\u200b", "\u200c"), ("\u200b", "\u200d")])
def test_zero_width_payload(spark, zero, one_):
    assert one(spark, bits("Hi", zero, one_) + "\u200b\u200b", text.decode_zero_width("t")) == "Hi"


def test_zero_width_payload_must_be_printable(spark):
    assert one(spark, bits("\x01A", "\u200b", "\u200c"), text.decode_zero_width("t")) == ""


@pytest.mark.parametrize("value", [None, "", "no bits"])
def test_nothing_to_decode(spark, value):
    assert one(spark, value, text.decode_zero_width("t")) == ""
    assert one(spark, value, text.decode_bits(text.trailing_bits("t"))["confidence"]) == 0.0


def test_trailing_and_line_ending_payloads(spark):
    trailing = "".join(f"visible{' ' if b == '0' else chr(9)}\n" for b in f"{ord('H'):08b}")
    assert one(spark, trailing, text.decode_bits(text.trailing_bits("t"))["text"]) == "H"
    endings = "".join("x" + ("\r\n" if b == "1" else "\n") for b in f"{ord('A'):08b}")
    assert one(spark, endings, text.decode_bits(text.line_ending_bits("t"))["text"]) == "A"


def test_homoglyphs(spark):
    assert one(spark, "p\u0430yment", text.normalize_homoglyphs("t")) == "payment"
    assert one(spark, "p\u0430yment", text.homoglyph_count("t")) == 1


def test_sanitize(spark):
    s = one(spark, "hello\u200bworld  \n", text.sanitize("t"))
    assert (s["text"], s["zero_width_removed"], s["trailing_whitespace_removed"]) == ("helloworld\n", 1, 2)
    s = one(spark, "a \u200b\r\nb\x0bc\rd\t", text.sanitize("t"))
    assert (s["text"], s["trailing_whitespace_removed"], s["line_endings_normalized"]) == ("a\nb\x0bc\nd", 2, 2)
    assert one(spark, "a\u2068b\u00a0", text.sanitize("t"))["text"] == "a\u2068b\u00a0"
    assert one(spark, "a\u2068b", text.sanitize("t", extended_bidi=True))["text"] == "ab"


@pytest.mark.parametrize("value", ["a\nb", "a\r\nb\x0bc\x85d\u2028e", "", "\n", "x\r", "a\x1cb\x1d\x1e\n\n", "a\x1fb"])
def test_lines_are_pythons(spark, value):
    assert one(spark, value, text.lines("t")) == value.splitlines(keepends=True)


def test_positions(spark):
    df = spark.createDataFrame([(1, "\u00e9\u200b"), (2, "ab \t\nx\u0430\u202ey"), (3, "clean")], "i long, t string")
    rows = [tuple(r) for r in text.character_findings(df, "i", "t").orderBy("id", "ord").select("id", "kind", "line", "col", "abs_i", "byte_off", "count").collect()]
    assert rows == [(1, "zero_width", 1, 2, 1, 2, 1), (2, "trailing", 1, 3, 2, 2, 2), (2, "homoglyph", 2, 2, 6, 6, 1), (2, "suspicious", 2, 3, 7, 8, 1)]


def test_positions_latin1(spark):
    df = spark.createDataFrame([(1, "caf\u00e9\u00ad", "latin-1")], "i long, t string, e string")
    assert text.character_findings(df, "i", "t", "e").first()["byte_off"] == 4


def test_cap(spark):
    df = spark.createDataFrame([(1, "\u200b" * 10), (2, "\u200b")], "i long, t string")
    rows = text.capped(text.character_findings(df, "i", "t"), 3).groupBy("id").agg(F.count("*").alias("n"), F.bool_or("over_limit").alias("o")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 3, True), (2, 1, False)]


def test_layout_urls_typography(spark):
    t = 'x <b style="DISPLAY : none;opacity:0;font-size:0.9em;margin-left:-100px">see (http://a.example/x).  One two.  Three four.  HTTP://b.example"'
    assert one(spark, t, text.layout_patterns("t")) == ["display_none", "zero_opacity", "zero_font", "off_canvas"]
    assert one(spark, t, text.external_urls("t")) == ["HTTP://b.example", "http://a.example/x"]
    assert one(spark, t, text.double_spaces("t")) == 3
    assert one(spark, "a   b  c    d  e", text.double_spaces("t")) == 2


@pytest.mark.parametrize("hidden,trailing,mixed,want", [(0, 0, False, "clean"), (1, 0, False, "low"), (2, 0, False, "medium"), (8, 0, False, "high"), (20, 0, False, "critical"), (0, 4, False, "medium"), (0, 0, True, "medium"), (15, 0, True, "critical"), (0, 1, False, "low")])
def test_severity(spark, hidden, trailing, mixed, want):
    row = spark.range(1).select(severity.base_severity(F.lit(hidden), F.lit(trailing), F.lit(mixed)).alias("s"), severity.severity(F.lit("low"), F.lit(True)).alias("u"))
    assert tuple(row.first()) == (want, "high")


def test_null_text(spark):
    df = spark.createDataFrame([(1, None)], "i long, t string")
    assert df.select(text.zero_width_count("t"), text.trailing_lines("t"), text.mixed_line_endings("t")).first()[0:3] == (0, 0, False)
    assert text.character_findings(df, "i", "t").count() == 0


def test_exit_code():
    assert severity.exit_code({"total": 0, "incomplete": 0, "flagged": 0}) == 2
    assert severity.exit_code({"total": 2, "incomplete": 1, "flagged": 1}) == 2
    assert severity.exit_code({"total": 2, "incomplete": 0, "flagged": 1}) == 1
    assert severity.exit_code({"total": 2, "incomplete": 0, "flagged": 0}) == 0
