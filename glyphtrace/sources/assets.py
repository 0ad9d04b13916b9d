"""Sources: files (dotfiles included) and DataFrame columns as rows of assets."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.limits import ScanLimits

SCHEMA = "asset_id string, parent_id string, root_id string, depth int, path string, name string, suffix string, length long, content binary, read_error string"


def suffix_of(name: str) -> str:
    return Path(name).suffix.lower()


def parse_suffixes(given: str) -> set[str]:
    """A comma list of suffixes, or ALL; dots may be left out and case does not matter."""
    if given.strip().upper() == "ALL":
        return {*dims.TEXT_SUFFIXES, *dims.BINARY_SUFFIXES}
    return {x if x.startswith(".") or x == "dockerfile" else f".{x}" for x in (p.strip().lower() for p in given.split(",")) if x}


def _dependency(path: Path, root: Path) -> bool:
    """Whether a component below the root is a dependency folder, or the folder holds a marker file."""
    parts = path.relative_to(root).parts if path != root and root in path.parents else path.parts[-1:]
    if any(p in dims.DEPENDENCY_FOLDERS or p.endswith(dims.DEPENDENCY_FOLDER_ENDS) for p in parts):
        return True
    folder = path.parent if path.is_file() else path
    return any((folder / m).exists() for m in dims.DEPENDENCY_MARKERS)


def list_files(paths: Iterable[str], suffixes: set[str] | None = None, recursive: bool = False, skip_dependencies: bool = False) -> tuple[list[str], int, list[str]]:
    """(files in order, how many dependency files were skipped, paths that do not exist).

    Folders are listed here and not by a file source of Spark, which leaves out names that start with a dot. Named files
    are taken whatever their suffix; links are not followed.
    """
    suffixes = suffixes or parse_suffixes("ALL")
    found, skipped, missing = [], 0, []
    for given in map(Path, paths):
        if given.is_file():
            if skip_dependencies and _dependency(given, given.parent):
                skipped += 1
            else:
                found.append(str(given))
            continue
        if not given.is_dir():
            missing.append(str(given))
            continue
        for folder, subfolders, names in os.walk(given):
            here = Path(folder)
            subfolders[:] = sorted(d for d in subfolders if recursive and not (here / d).is_symlink())
            if skip_dependencies:
                for d in [d for d in subfolders if _dependency(here / d, given)]:
                    skipped += sum(len(files) for _, _, files in os.walk(here / d))
                    subfolders.remove(d)
            for name in names:
                path = here / name
                if path.is_symlink() or not path.is_file() or not {suffix_of(name), name.lower()} & suffixes:
                    continue
                if skip_dependencies and _dependency(path, given):
                    skipped += 1
                else:
                    found.append(str(path))
    return sorted(found), skipped, missing


def read_files(spark: SparkSession, files: list[str], limits: ScanLimits | None = None, partitions: int | None = None) -> DataFrame:
    """Assets of files, read by tasks; what is too long or can't be read keeps its row, with the error."""
    most = ScanLimits.of(limits).max_file_bytes

    def run(batches):
        for b in batches:
            for path in b["path"].to_pylist():
                content, error, size = None, None, None
                try:
                    size = os.path.getsize(path)
                    if size > most:
                        error = f"max_file_bytes exceeded: {size} > {most}"
                    else:
                        with open(path, "rb") as f:
                            content = f.read(most + 1)
                        if len(content) > most:
                            content, error = None, f"max_file_bytes exceeded: input is larger than {most}"
                except OSError as e:
                    error = str(e)
                name = os.path.basename(path)
                row = {"asset_id": path, "parent_id": None, "root_id": path, "depth": 0, "path": path, "name": name, "suffix": suffix_of(name), "length": size, "content": content, "read_error": error}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("asset_id", pa.string()), ("parent_id", pa.string()), ("root_id", pa.string()), ("depth", pa.int32()), ("path", pa.string()), ("name", pa.string()), ("suffix", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("read_error", pa.string())]))

    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(partitions or min(max(1, len(files)), spark.sparkContext.defaultParallelism * 4))
    return listed.mapInArrow(run, SCHEMA)


def read_store(spark: SparkSession, path: str | list[str], suffixes: set[str] | None = None, recursive: bool = True, limits: ScanLimits | None = None) -> DataFrame:
    """Assets of a folder in any store that Spark reads, listed and read in parallel; content over the limit is not read.

    Spark's listing leaves out names that begin with a dot or an underscore; list_files and read_files take them, on
    folders that all machines share.
    """
    most = ScanLimits.of(limits).max_file_bytes
    wanted = sorted(suffixes or parse_suffixes("ALL"))
    name = F.regexp_extract("path", r"[^/]+$", 0)
    suffix = F.lower(F.regexp_extract(name, r"(?<=[^.])(\.[^./]+)$", 1))
    none = F.lit(None).cast("string")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).filter(suffix.isin(wanted) | F.lower(name).isin(wanted))

    def assets(of: DataFrame, content: Column, error: Column) -> DataFrame:
        return of.select(F.col("path").alias("asset_id"), none.alias("parent_id"), F.col("path").alias("root_id"), F.lit(0).alias("depth"), "path", name.alias("name"), suffix.alias("suffix"), "length", content.alias("content"), error.alias("read_error"))

    long = F.concat(F.lit("max_file_bytes exceeded: "), F.col("length").cast("string"), F.lit(f" > {most}"))
    return assets(rows.filter(F.col("length") <= most), F.col("content"), none).unionAll(assets(rows.filter(F.col("length") > most), F.lit(None).cast("binary"), long))


def from_column(df: DataFrame, id_col: str, column: str, name_col: str | None = None, suffix: str = ".txt") -> DataFrame:
    """Assets out of a string or binary column."""
    kind = dict(df.dtypes)[column]
    content = F.col(column) if kind == "binary" else F.encode(F.col(column), "UTF-8")
    asset = F.col(id_col).cast("string")
    name = F.col(name_col) if name_col else F.concat(asset, F.lit(suffix))
    found = F.lower(F.regexp_extract(name, r"(?<=[^.])(\.[^./]+)$", 1))
    content = F.coalesce(content, F.lit(b""))
    none = F.lit(None).cast("string")
    return df.select(asset.alias("asset_id"), none.alias("parent_id"), asset.alias("root_id"), F.lit(0).alias("depth"), name.alias("path"), name.alias("name"), found.alias("suffix"), F.length(content).cast("long").alias("length"), content.alias("content"), none.alias("read_error"))


def with_text(assets: DataFrame) -> DataFrame:
    """Adds mode (text or binary, by suffix), encoding, text (UTF-8, else Latin-1) and utf8_text (null if not UTF-8)."""
    raw = F.coalesce("content", F.lit(b""))
    valid = F.is_valid_utf8(raw.cast("string"))
    utf8 = F.when(valid, raw.cast("string"))
    return assets.withColumns({
        "mode": F.when(F.col("suffix").isin(*dims.BINARY_SUFFIXES), "binary").otherwise("text"),
        "encoding": F.when(valid, "utf-8").otherwise("latin-1"),
        "text": F.coalesce(utf8, F.decode(raw, "ISO-8859-1")),
        "utf8_text": utf8,
    })
