"""Search of binaries for the UTF-8 bytes of invisible and direction characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphtrace import dims
from glyphtrace.operators.formats import search_ranges

CONTEXT = 25
_ORDER = {c.encode(): k for k, c in enumerate(dims.BINARY_ORDER)}
#: No sequence is the beginning of another, so one pass finds every occurrence.
_ANY = re.compile(b"|".join(re.escape(s) for s in _ORDER))
_VISIBLE = "".join(chr(b) if 32 <= b < 127 else "\u00b7" for b in range(256))
SCHEMA = "asset_id string, range_ord int, sequence_ord int, byte_off long, category string, char string, name string, context string"


def byte_hits(assets: DataFrame) -> DataFrame:
    """Hits of every asset (asset_id, suffix, content); range_ord and sequence_ord give the order in which a cap keeps them."""
    names = {**dims.ZERO_WIDTH, **dims.SUSPICIOUS}

    def run(batches):
        for b in batches:
            rows = []
            for asset, suffix, raw in zip(b["asset_id"].to_pylist(), b["suffix"].to_pylist(), b["content"].to_pylist(), strict=True):
                seen = set()
                for k, (start, end) in enumerate(search_ranges(raw or b"", suffix or "")):
                    for m in _ANY.finditer(raw, start, end):
                        if m.start() in seen:
                            continue
                        seen.add(m.start())
                        c = m[0].decode()
                        near = raw[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]
                        rows.append((asset, k, _ORDER[m[0]], m.start(), "ZWC" if c in dims.ZERO_WIDTH else "BIDI", c, names[c], "".join(_VISIBLE[x] for x in near)))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return assets.select("asset_id", "suffix", "content").mapInArrow(run, SCHEMA)


def capped_hits(hits: DataFrame, most: int) -> DataFrame:
    """The hits that a cap keeps: by range, then by sequence, then by place."""
    w = Window.partitionBy("asset_id")
    ranked = hits.withColumn("ord", F.row_number().over(w.orderBy("range_ord", "sequence_ord", "byte_off"))).withColumn("over_limit", F.count("*").over(w) > most)
    return ranked.filter(F.col("ord") <= most)
