"""Deterministic injection of hidden content into the clean documents table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["clean", "zw_payload", "homoglyph", "bidi", "filler", "trailing_bits", "eol_bits", "typography", "hidden_style", "url", "fingerprint", "mixed"]
TYPOGRAPHY = "One two.  Three four  five.  Six seven  eight.  "
STYLE = '<p style="Display : none; opacity:0;">'
URLS = " see http://example.org/a). and HTTPS://example.com/b?x=1, http://example.org/a"
FINGERPRINT = "Make=ACME Model=X "


def _bits() -> Column:
    """The bits of the letters H, i and a third one by doc_id."""
    return F.concat(F.lit("0100100001101001"), F.lpad(F.bin(65 + F.pmod("doc_id", F.lit(26))), 8, "0"))


def carriers(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, injected, t: documents with the content of their kind, which doc_id decides."""
    t = F.coalesce("text", F.lit(""))
    bits = _bits()
    texts = [
        t,
        F.concat(F.translate(bits, "01", "\u200b\u200d"), t),
        F.translate(t, "eo", "\u0435\u043e"),
        F.concat(F.lit("\u202e"), t, F.lit("\u202c")),
        F.concat(F.lit("\u00a0"), t, F.lit("\u3164\u115f")),
        F.concat(t, F.lit("\n"), F.replace(F.replace(bits, F.lit("0"), F.lit("w \n")), F.lit("1"), F.lit("w\t\n"))),
        F.concat(F.replace(t, F.lit("\n"), F.lit(" ")), F.replace(F.replace(bits, F.lit("0"), F.lit("w\n")), F.lit("1"), F.lit("w\r\n"))),
        F.concat(F.lit(TYPOGRAPHY), t),
        F.concat(F.lit(STYLE), t, F.lit("</p>")),
        F.concat(t, F.lit(URLS)),
        F.concat(F.lit(FINGERPRINT), t),
        F.concat(F.replace(t, F.lit("\n"), F.lit("\r\n")), F.lit("\n"), F.repeat(F.lit("\u2060\u00ad"), F.pmod("doc_id", F.lit(15)).cast("int")), F.lit("\u0445 \t")),
    ]
    kind = F.pmod("doc_id", F.lit(len(KINDS)))
    pick = lambda options: F.coalesce(*[F.when(kind == k, o) for k, o in enumerate(options)])
    return docs.select("doc_id", "lang", "source", pick([F.lit(k) for k in KINDS]).alias("injected"), pick(texts).alias("t"))


def carriers_sql() -> str:
    """The same relation for DuckDB, as a common table expression."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t, nl, crlf = "coalesce(text, '')", "chr(10)", "chr(13) || chr(10)"
    bits = "('0100100001101001' || lpad(bin(65 + doc_id % 26), 8, '0'))"
    texts = [
        t,
        f"translate({bits}, '01', '\u200b\u200d') || {t}",
        f"translate({t}, 'eo', '\u0435\u043e')",
        f"'\u202e' || {t} || '\u202c'",
        f"'\u00a0' || {t} || '\u3164\u115f'",
        f"{t} || {nl} || replace(replace({bits}, '0', 'w ' || {nl}), '1', 'w' || chr(9) || {nl})",
        f"replace({t}, {nl}, ' ') || replace(replace({bits}, '0', 'w' || {nl}), '1', 'w' || {crlf})",
        f"{q(TYPOGRAPHY)} || {t}",
        f"{q(STYLE)} || {t} || '</p>'",
        f"{t} || {q(URLS)}",
        f"{q(FINGERPRINT)} || {t}",
        f"replace({t}, {nl}, {crlf}) || {nl} || repeat('\u2060\u00ad', (doc_id % 15)::INT) || '\u0445 ' || chr(9)",
    ]
    pick = lambda options: "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options)) + " END"
    return f"carriers AS (SELECT doc_id, lang, source, {pick([q(k) for k in KINDS])} AS injected, {pick(texts)} AS t FROM documents)"
