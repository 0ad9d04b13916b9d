"""Decoding and sanitizing of text assets, and writing the sanitized copies."""

from __future__ import annotations

import difflib
import os
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphtrace.functions import text
from glyphtrace.sources.assets import with_text


def decode_assets(assets: DataFrame) -> DataFrame:
    """Payloads of the text channels: zero-width characters, trailing blanks, line endings, look-alikes."""
    a = with_text(assets)
    trailing, endings = text.decode_bits(text.trailing_bits("text")), text.decode_bits(text.line_ending_bits("text"))
    decoded = text.decode_zero_width("text")
    ok = F.col("mode") == "text"
    return a.select(
        "asset_id", "path", F.when(ok, "DECODED").otherwise("NOT_SUPPORTED").alias("status"), F.sha2("content", 256).alias("sha256"), "encoding",
        F.when(ok, F.struct(decoded.alias("decoded"), F.when(decoded != "", 0.9).otherwise(0.0).alias("confidence"), text.zero_width_count("text").alias("occurrences"))).alias("zero_width"),
        F.when(ok, F.struct(trailing["text"].alias("decoded"), trailing["confidence"].alias("confidence"), text.trailing_bits("text").alias("bits"))).alias("trailing_whitespace"),
        F.when(ok, F.struct(endings["text"].alias("decoded"), endings["confidence"].alias("confidence"), text.line_ending_bits("text").alias("bits"))).alias("line_endings"),
        F.when(ok, F.struct(text.normalize_homoglyphs("text").alias("normalized_text"), text.homoglyph_count("text").alias("replacements"))).alias("homoglyphs"),
        F.when(ok, text.mixed_line_endings("text")).alias("mixed_line_endings"), F.when(ok, F.length("text")).alias("text_length"),
    )


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series, name: pd.Series, to: pd.Series) -> pd.Series:
    """A unified diff of two texts by lines."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), n or "", t or "")) for a, b, n, t in zip(before, after, name, to, strict=True)])


def sanitize_assets(assets: DataFrame, with_diff: bool = True, extended_bidi: bool = False) -> DataFrame:
    """Sanitized content and what was changed; binary assets pass unchanged as NO_OP_UNSUPPORTED."""
    a = with_text(assets).withColumn("s", text.sanitize("text", extended_bidi))
    ok = F.col("mode") == "text"
    clean = F.when(ok & (F.col("encoding") == "utf-8"), F.encode(F.col("s.text"), "UTF-8")).when(ok, F.encode(F.col("s.text"), "ISO-8859-1")).otherwise(F.col("content"))
    to = F.regexp_replace("path", r"^(.*?[^/])((?:\.[^./]+)?)$", "$1.sanitized$2")
    changes = F.struct(*[F.when(ok, F.col(f"s.{k}")).otherwise(F.lit(0)).cast("long").alias(k) for k in ("zero_width_removed", "bidi_removed", "homoglyphs_replaced", "trailing_whitespace_removed", "line_endings_normalized")])
    out = a.select("asset_id", "path", to.alias("sanitized_path"), F.when(ok, "SANITIZED").otherwise("NO_OP_UNSUPPORTED").alias("sanitization_status"), "text", F.col("s.text").alias("clean_text"), clean.alias("clean"), "content", changes.alias("changes"), "mode")
    diff = F.when(ok, unified_diff("text", "clean_text", "path", "sanitized_path")).otherwise("") if with_diff else F.lit("")
    return out.select("asset_id", "path", "sanitized_path", "sanitization_status", F.sha2("content", 256).alias("sha256_before"), F.sha2("clean", 256).alias("sha256_after"), (F.col("content") != F.col("clean")).alias("changed"), "changes", diff.alias("diff"), "clean")


def provenance_impact(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """asset_id, provenance_impact from (asset_id, status) before and after and (asset_id, changed)."""
    j = before.select("asset_id", F.col("status").alias("b")).join(after.select("asset_id", F.col("status").alias("a")), "asset_id").join(changed.select("asset_id", "changed"), "asset_id")
    valid = F.when(~F.col("changed") & (F.col("a") == "VALID"), "preserved").otherwise("invalidated")
    return j.select("asset_id", F.when(F.col("b") == "VALID", valid).when(F.col("changed"), "not_applicable").otherwise("unchanged").alias("provenance_impact"))


def write_file(path: str, data: bytes, replace: bool = False, mode: int | None = None) -> None:
    """Writes a new file, or replaces one atomically; an existing file is never changed unless `replace`."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if replace:
        handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            if mode is not None:
                os.chmod(name, mode)
            os.replace(name, target)
        except BaseException:
            Path(name).unlink(missing_ok=True)
            raise
        return
    with open(target, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    if mode is not None:
        os.chmod(target, mode)


def copy_sidecar(sidecar: str | None, to: str, dry: bool = False) -> str | None:
    """Copies a sidecar beside an unchanged copy, under the copy's name; FileExistsError if there is one. dry: only tests that."""
    if sidecar is None:
        return None
    target = to + (".c2pa.json" if sidecar.endswith(".c2pa.json") else ".c2pa")
    if os.path.lexists(target):
        raise FileExistsError(f"there is a sidecar already: {target}")
    if not dry:
        write_file(target, Path(sidecar).read_bytes(), mode=os.stat(sidecar).st_mode & 0o7777)
    return target


def write_sanitized(sanitized: DataFrame, in_place: bool = False, confirm: bool = False) -> None:
    """Writes the copies from the tasks. Replacing the originals needs both in_place and confirm.

    A column `sidecar`, where there is one, names the valid local sidecar of an asset; it is copied beside an unchanged copy.
    """
    if in_place != confirm:
        raise ValueError("replacing files needs both in_place and confirm")

    def run(rows):
        for r in rows:
            mode = os.stat(r["path"]).st_mode & 0o7777
            to = r["path"] if in_place else r["sanitized_path"]
            side = None if in_place else r["side"]
            copy_sidecar(side, to, dry=True)
            write_file(to, bytes(r["clean"]), in_place, mode)
            copy_sidecar(side, to)

    side = F.when(~F.col("changed"), F.col("sidecar")) if "sidecar" in sanitized.columns else F.lit(None).cast("string")
    sanitized.select("path", "sanitized_path", "clean", side.alias("side")).foreachPartition(run)
