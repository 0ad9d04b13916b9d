import json
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_media import RGB, bmp, chunk, packed, png, tone

from glyphtrace import cli, dims, queries
from glyphtrace.functions import severity
from glyphtrace.operators.sanitize import decode_assets, provenance_impact, sanitize_assets, write_file, write_sanitized
from glyphtrace.plans.scan import Hooks, families, scan, verify_text
from glyphtrace.report import render_html, report_name, write_folder_reports, write_html, write_json, write_results
from glyphtrace.sources import remote
from glyphtrace.sources.assets import from_column, list_files, parse_suffixes, read_files, read_store

ZW = "\u200b"
CLAIM = png(RGB, 2, extra=chunk(b"caBX", b'{"provider": "x"}'))

FILES = {
    "plain.txt": b"A plain sentence.\n",
    "zero.txt": f"visible{ZW}hidden\n".encode(),
    "latin.txt": b"caf\xe9\xad",
    ".env": b"KEY=1 \n",
    "unicode.wasm": b"\0asm\xe2\x80\x8b",
    "plain.wasm": b"\0asm",
    "hidden.svg": b'<svg><text style="display:none">x</text></svg>',
    "comment.html": b"<!-- note --><p>x</p>",
    "private.png": png(RGB, 2, extra=chunk(b"vpAg")),
    "meta.png": png(RGB, 2, extra=chunk(b"tEXt", b"abc")),
    "tail.png": png(RGB, 2) + b"tail",
    "broken.png": png(RGB, 2)[:-16],
    "nested.zip": packed({"in/meta.png": png(RGB, 2, extra=chunk(b"tEXt", b"abc")), "deep.zip": packed({"x.svg": b"<svg style='opacity:0;'/>"})}),
    "doc.pdf": b"%PDF-1.4 /Author /EmbeddedFile " + png(RGB, 2, extra=chunk(b"tEXt", b"abc")),
    "sound.wav": tone([np.zeros(1000)]) + b"appended",
    "film.mp4": struct.pack(">I", 16) + b"ftyp" + b"isom0000" + struct.pack(">I", 8) + b"uuid" + b"rest frame_watermark",
    "layers.psd": b"8BPS 8BIM 8BIM",
    "board.bmp": bmp(np.dstack([np.where(np.indices((32, 32)).sum(0) % 2, 152, 104).astype(np.uint8)] * 3)),
    "claim.png": CLAIM,
    "side.png": png(RGB, 2),
    "photo.jpg": b"\xff\xd8\xff\xe1\x00\x10Exif\0\0 make=acme\xff\xda\xe2\x80\x8b",
    "song.mp3": b"ID3 phase_watermark",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, raw in FILES.items():
        (root / name).write_bytes(raw)
    (root / "side.png.c2pa.json").write_text("{broken")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.txt").write_text("x")
    (root / "sub").mkdir()
    (root / "sub" / "bad.txt").write_text(ZW * 30)
    (root / "link.txt").symlink_to(root / "plain.txt")
    return root


@pytest.fixture(scope="module")
def tables(spark, folder):
    files, _, _ = list_files([str(folder)], parse_suffixes("ALL"), True)
    return {name: table.persist() for name, table in scan(read_files(spark, files).persist()).items()}


def found(tables):
    out = {}
    for r in tables["findings"].collect():
        out.setdefault(r["asset_id"].split("/")[-1], []).append(r["detector"])
    return out


def test_listing(folder):
    files, skipped, missing = list_files([str(folder), "/no/such"], None, True, True)
    names = {f.rsplit("/", 1)[1] for f in files}
    assert ".env" not in names and "link.txt" not in names and "x.txt" not in names and "bad.txt" in names
    assert skipped == 2 and missing == ["/no/such"] and files == sorted(files)
    assert {f.rsplit("/", 1)[1] for f in list_files([str(folder)], parse_suffixes("WASM,.Env"))[0]} == {".env", "unicode.wasm", "plain.wasm"}
    assert list_files([str(folder / "side.png.c2pa.json")])[0]


def test_store(spark, folder):
    got = {r["name"]: r for r in read_store(spark, str(folder), limits={"max_file_bytes": 40}).collect()}
    assert bytes(got["plain.txt"]["content"]) == FILES["plain.txt"] and got["bad.txt"]["content"] is None and "max_file_bytes" in got["bad.txt"]["read_error"]
    assert "side.png.c2pa.json" in got and ".env" not in got and set(got) < {*FILES, "bad.txt", "x.txt", "link.txt", "side.png.c2pa.json"}
    assert scan(read_store(spark, str(folder / "sub")))["verdicts"].first()["severity"] == "critical"


def test_findings(tables):
    f = found(tables)
    assert f["private.png"] == ["png_private_chunk"] and f["meta.png"] == ["png_metadata_chunk"] and f["tail.png"] == ["png_appended_data"]
    assert "png_malformed_chunk" in f["broken.png"] and f["hidden.svg"] == ["hidden_layout_style"] and f["comment.html"] == ["format_metadata_fields"]
    assert f["sound.wav"][0] == "riff_appended_data" and {"bmff_private_box", "bmff_appended_data", "declared_robust_watermark_signal"} <= set(f["film.mp4"])
    assert f["layers.psd"] == ["psd_layer_structure"] and f["board.bmp"] == ["robust_media_analyzer"]
    assert {"pdf_hidden_structure", "format_metadata_fields"} <= set(f["doc.pdf"]) and f["doc.pdf!1"] == ["png_metadata_chunk"]
    assert f["nested.zip"] == ["archive_embedded_files"] and f["nested.zip!1"] == ["png_metadata_chunk"] and f["nested.zip!2!1"] == ["hidden_layout_style"]
    assert f["claim.png"].count("c2pa_validation") == 1 and "content_credentials" in f["side.png"]
    assert {"format_metadata_fields", "device_codec_fingerprint"} <= set(f["photo.jpg"]) and {"format_metadata_fields", "declared_robust_watermark_signal"} <= set(f["song.mp3"])
    assert "plain.txt" not in f and "plain.wasm" not in f


def test_verdicts(tables):
    v = {r["name"]: r for r in tables["verdicts"].collect()}
    assert (v["plain.txt"]["severity"], v["plain.txt"]["flagged"]) == ("clean", False)
    assert (v["zero.txt"]["severity"], v["zero.txt"]["hidden"]) == ("low", 1)
    assert v["latin.txt"]["hidden"] == 1 and v[".env"]["trailing"] == 1
    assert v["unicode.wasm"]["hidden"] == 1 and not v["plain.wasm"]["flagged"]
    assert v["hidden.svg"]["severity"] == "high" and v["bad.txt"]["severity"] == "critical"
    assert v["photo.jpg"]["hidden"] == 0 and v["claim.png"]["provenance"] == "NOT_CHECKED" and v["claim.png"]["severity"] == "high"
    assert v["side.png"]["provenance"] == "TAMPERED" and v["private.png"]["provenance"] == "MISSING"
    assert v["private.png"]["lsb_verdict"] in ("CLEAN", "SUSPICIOUS") and v["plain.txt"]["lsb_verdict"] is None
    assert not any(r["incomplete"] for r in v.values())


def test_limits(spark, folder):
    files = [str(folder / n) for n in ("bad.txt", "unicode.wasm", "nested.zip", "plain.txt")]
    files[0] = str(folder / "sub" / "bad.txt")
    v = {r["name"]: r for r in scan(read_files(spark, files), limits={"max_findings": 3, "max_nesting_depth": 1})["verdicts"].collect()}
    assert v["bad.txt"]["incomplete"] and v["bad.txt"]["hidden"] == 3 and "max_findings" in v["bad.txt"]["error"]
    assert v["nested.zip"]["nested_errors"] == ["nesting depth limit reached"] and v["nested.zip"]["incomplete"]
    assert not v["plain.txt"]["incomplete"]
    v = scan(read_files(spark, files, {"max_file_bytes": 5}))["verdicts"].filter("incomplete").count()
    assert v == 4


def test_hooks(spark, folder):
    hooks = Hooks(ai_text_verifier=lambda t, path: {"detected": "hidden" in t, "confidence": 0.9, "provider": "p"}, provenance_validator=lambda m, raw, where: {"status": "VALID"})
    t = scan(read_files(spark, [str(folder / n) for n in ("zero.txt", "claim.png")]), hooks=hooks)
    assert set(r["category"] for r in t["findings"].collect()) >= {"AI_TEXT_WATERMARK", "PROVENANCE"}
    assert verify_text(lambda t, path: {"confidence": 3}, "", "")["status"] == "ERROR"
    assert verify_text(None, "", "")["status"] == "NOT_CHECKED"


def test_column_source(spark):
    df = spark.createDataFrame([(1, f"a{ZW}"), (2, None), (3, "")], "k long, body string")
    v = {r["asset_id"]: r["hidden"] for r in scan(from_column(df, "k", "body"))["verdicts"].collect()}
    assert v == {"1": 1, "2": 0, "3": 0}


def test_verdicts_count_what_the_limit_does_not_list(spark, tmp_path):
    rows = [(2, "e" * 10_003, "en", "a"), (5, "x \n" * 10_002, "en", "a"), (14, None, "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, queries.QUERIES["asset_verdicts"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.sql(queries.ORACLES["asset_verdicts"]).fetchall())
    v = scan(from_column(spark.createDataFrame([(1, f"{ZW}{ZW}a \n{ZW}")], "k long, body string"), "k", "body"), limits={"max_findings": 2})["verdicts"].first()
    assert (v["hidden"], v["trailing"], v["every_hidden"], v["every_trailing"], v["incomplete"]) == (1, 1, 3, 1, True)
    binary = spark.createDataFrame([("b", bytearray(f"{ZW}{ZW}{ZW}".encode()), "b.wasm")], "k string, body binary, name string")
    v = scan(from_column(binary, "k", "body", "name"), limits={"max_findings": 2})["verdicts"].first()
    assert (v["hidden"], v["every_hidden"], v["incomplete"]) == (2, 3, True)


def test_empty(spark):
    assert scan(read_files(spark, []))["summary"].first()["total"] == 0


def test_corpus_metrics(spark, tables):
    cases = [("TEXT", "plain.txt", False), ("TEXT", "zero.txt", True), ("BINARY", "plain.wasm", False), ("BINARY", "unicode.wasm", True), ("STRUCTURAL", "meta.png", False), ("STRUCTURAL", "private.png", True)]
    v = {r["name"]: r for r in tables["verdicts"].collect()}
    rows = spark.createDataFrame([(f, e, v[n]["flagged"]) for f, n, e in cases], "family string, expected boolean, observed boolean")
    m = {r["family"]: r for r in severity.metrics(rows).collect()}
    assert (m[None]["tp"], m[None]["tn"], m[None]["precision"], m[None]["recall"], m[None]["false_positive_rate"]) == (3, 3, 1.0, 1.0, 0.0)
    assert set(m) == {None, "TEXT", "BINARY", "STRUCTURAL"}


def test_reports(spark, tables, folder, tmp_path):
    said = write_json(tables, str(tmp_path / "r.json"))
    payload = json.loads((tmp_path / "r.json").read_text())
    assert payload["total_files"] == said["total_files"] == len(payload["results"]) and [r["path"] for r in payload["results"]] == sorted(r["path"] for r in payload["results"])
    write_results(tables, str(tmp_path / "lines"))
    assert sorted(json.loads(r[0])["path"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == [r["path"] for r in payload["results"]]
    write_html(tables, str(tmp_path / "r.html"))
    assert (tmp_path / "r.html").read_text().count("<section") == said["total_files"]
    payload["results"][0]["path"] = "<script>"
    assert "<script>" not in render_html(payload).split("<section")[1]
    write_folder_reports(tables, str(folder), str(tmp_path / "by"))
    assert (tmp_path / "by" / "sub.html").exists() and "bad.txt" in (tmp_path / "by" / "critical_all.txt").read_text()
    assert report_name("org/re po:x") == "org_re_po_x.html" and report_name("") == "report.html"


def test_families(tables):
    got = {r["counter"]: r["value"] for r in families(tables).collect()}
    chars, verdicts = tables["characters"].collect(), tables["verdicts"].collect()
    assert got["zero_width"] == sum(r["kind"] == "zero_width" for r in chars) > 0 and got["binary_hits"] == tables["hits"].count() > 0
    assert got["hidden"] == sum(r["hidden"] for r in verdicts) and got["mixed_line_endings"] == sum(r["mixed"] for r in verdicts)
    records = [json.loads(r["provenance"]) for r in tables["provenance"].collect()]
    assert got["provenance_failures"] == sum(r["status"] in ("TAMPERED", "UNTRUSTED_SIGNER") or bool(r["validation_errors"]) for r in records)


def test_provenance_panel():
    record = {"status": "VALID", "provider": "<p>", "timestamps": ["2024"], "actions": [{"action": "c2pa.created", "when": "2023"}], "ingredients": [{"title": "a&b"}], "validation_errors": ["e"]}
    row = {"severity": "low", "path": "p", "hidden": 0, "trailing": 0, "provenance": "VALID", "provenance_record": json.dumps(record)}
    made = render_html({"total_files": 1, "flagged_files": 0, "incomplete_files": 0, "clean_files": 1, "results": [row], "families": {"lsb": 2}})
    assert "&lt;p&gt;" in made and "<li>2024</li><li>2023 c2pa.created</li><li>ingredient a&amp;b</li>" in made and "lowest bits" in made
    assert "Provenance" not in render_html({"total_files": 1, "flagged_files": 0, "incomplete_files": 0, "clean_files": 1, "results": [row | {"provenance_record": None}]})


def test_plain_text_needs_no_python_and_content_no_shuffle(spark):
    tables = scan(from_column(spark.createDataFrame([(1, "a\u200bb"), (2, "c")], "id long, t string"), "id", "t"), persist=False)
    plan = tables["provenance"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sorted(r["asset_id"] for r in tables["provenance"].collect()) == ["1", "2"]
    for line in tables["verdicts"]._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "Exchange" not in line or "content" not in line


def test_sidecars_and_remote_manifests(spark, tmp_path):
    picture = png(RGB, 2)
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(picture)
    (tmp_path / "a.c2pa.json").write_text('{"provider": "p"}')
    (tmp_path / "c.png").write_bytes(picture[:8] + chunk(b"caBX", b'{"remote_url": "https://m.example/1"}') + picture[8:])
    assets = read_files(spark, sorted(map(str, tmp_path.iterdir())))
    asked = []

    def load(url):  # runs where it is given, on the driver
        asked.append(url)
        return {"provider": "far"}

    got = {r["asset_id"].rsplit("/")[-1]: json.loads(r["provenance"]) for r in scan(assets, hooks=Hooks(remote_manifest_loader=load))["provenance"].collect()}
    assert got["a.png"]["provider"] == "p" and got["a.png"]["manifest_location"].endswith("a.c2pa.json") and got["b.png"]["status"] == "MISSING"
    assert got["c.png"]["provider"] == "far" and asked == ["https://m.example/1"]


def test_sidecar_copies(spark, tmp_path):
    (tmp_path / "a.svg").write_bytes(b"<svg/>")
    (tmp_path / "a.c2pa.json").write_bytes(b"{}")
    same = sanitize_assets(read_files(spark, [str(tmp_path / "a.svg")])).withColumn("sidecar", F.lit(str(tmp_path / "a.c2pa.json")))
    write_sanitized(same)
    assert (tmp_path / "a.sanitized.svg").read_bytes() == b"<svg/>" and (tmp_path / "a.sanitized.svg.c2pa.json").read_bytes() == b"{}"
    (tmp_path / "a.sanitized.svg").unlink()
    with pytest.raises(Exception, match="sidecar already"):
        write_sanitized(same)
    assert not (tmp_path / "a.sanitized.svg").exists()


def test_decode_and_sanitize(spark, folder, tmp_path):
    (tmp_path / "a.txt").write_bytes(f"he{ZW}llo  \r\nx".encode())
    (tmp_path / "l.txt").write_bytes(b"caf\xe9\xad ")
    assets = read_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "l.txt"), str(folder / "plain.wasm")])
    d = {r["path"].rsplit("/")[-1]: r for r in decode_assets(assets).collect()}
    assert d["a.txt"]["zero_width"]["occurrences"] == 1 and d["plain.wasm"]["status"] == "NOT_SUPPORTED" and d["l.txt"]["encoding"] == "latin-1"
    s = sanitize_assets(assets)
    rows = {r["path"].rsplit("/")[-1]: r for r in s.collect()}
    assert bytes(rows["a.txt"]["clean"]) == b"hello\nx" and bytes(rows["l.txt"]["clean"]) == b"caf\xe9" and not rows["plain.wasm"]["changed"]
    assert rows["a.txt"]["diff"].startswith("---") and rows["a.txt"]["sanitized_path"].endswith("a.sanitized.txt")
    write_sanitized(s.filter("changed"))
    assert (tmp_path / "a.sanitized.txt").read_bytes() == b"hello\nx" and (tmp_path / "a.txt").read_bytes() != b"hello\nx"
    with pytest.raises(Exception, match="exists"):
        write_sanitized(s.filter("changed"))
    with pytest.raises(ValueError):
        write_sanitized(s, in_place=True)
    write_sanitized(s.filter("changed"), True, True)
    assert (tmp_path / "a.txt").read_bytes() == b"hello\nx"
    status = lambda x: spark.createDataFrame([("a", x)], "asset_id string, status string")
    changed = lambda x: spark.createDataFrame([("a", x)], "asset_id string, changed boolean")
    impact = lambda b, a, c: provenance_impact(status(b), status(a), changed(c)).first()[1]
    assert [impact("VALID", "VALID", False), impact("VALID", "TAMPERED", True), impact("MISSING", "MISSING", False), impact("MISSING", "MISSING", True)] == ["preserved", "invalidated", "unchanged", "not_applicable"]


def test_exclusive_write(tmp_path):
    write_file(str(tmp_path / "x" / "a"), b"1")
    with pytest.raises(FileExistsError):
        write_file(str(tmp_path / "x" / "a"), b"2")
    write_file(str(tmp_path / "x" / "a"), b"3", replace=True)
    assert (tmp_path / "x" / "a").read_bytes() == b"3" and len(list((tmp_path / "x").iterdir())) == 1


def test_cli(spark, folder, tmp_path, capsys):
    assert cli.main(["detect", str(folder / "plain.txt")], spark) == 0
    assert cli.main(["detect", str(folder / "zero.txt"), "--json", str(tmp_path / "j.json")], spark) == 1
    assert cli.main(["detect", "/no/such"], spark) == 2
    capsys.readouterr()
    assert cli.main(["detect", str(folder / "zero.txt"), "-v", "-d", "--results", str(tmp_path / "lines")], spark) == 1
    said = capsys.readouterr().out
    assert "hidden characters" in said and "zero width" in said and "\x1b" not in said
    assert cli.main(["decode", str(folder / "zero.txt")], spark) == 0
    assert cli.main(["sanitize", str(folder / "zero.txt"), "-o", str(tmp_path / "z.txt")], spark) == 0
    assert (tmp_path / "z.txt").read_bytes() == b"visiblehidden\n"
    assert cli.main(["watermark", str(folder / "hidden.svg"), "--html", str(tmp_path / "h.html")], spark) == 0
    assert cli.main(["decode", "/no/such"], spark) == 2
    with pytest.raises(SystemExit):
        cli.main(["sanitize", "x", "--in-place"], spark)


def test_remote_rules():
    for bad in ("http://a.example/x", "https://a.example:444/", "https://u@a.example/", "https://a.example/#f"):
        with pytest.raises(ValueError):
            remote.checked_url(bad)
    for address in ("127.0.0.1", "10.0.0.1", "169.254.1.1", "::1"):
        with pytest.raises(ValueError):
            remote.public_address("a.example", lambda *a, address=address, **k: [(0, 0, 0, "", (address, 443))])


def test_tables():
    assert (len(dims.ZERO_WIDTH), len(dims.HOMOGLYPHS), len(dims.SUSPICIOUS), len(dims.BINARY_ORDER)) == (12, 23, 14, 26)
    assert (len(dims.TEXT_SUFFIXES), len(dims.BINARY_SUFFIXES), len(dims.DEPENDENCY_FOLDERS)) == (44, 61, 53)
