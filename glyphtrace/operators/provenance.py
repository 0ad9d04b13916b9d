"""Content credentials: where a manifest is, what a validator says, and the findings that follow."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from glyphtrace import dims
from glyphtrace.operators.formats import PNG, png_parts

FIELDS = ["status", "provider", "claim_generator", "signer_identity", "certificate_trust", "digital_source_type", "timestamps", "manifest_location", "manifest_label", "validation_errors", "actions", "ingredients"]
# What the codes of an untrusted signer contain.
UNTRUSTED = ("untrusted", "unknownsigner", "credential.nottrusted", "signingcredential.untrusted")
TOOL_OUTPUT = 10 << 20


def record(status: str = "NOT_CHECKED", **given) -> dict:
    """A provenance record; unknown statuses raise ValueError."""
    if status not in dims.PROVENANCE_STATUSES:
        raise ValueError(f"unknown provenance status: {status}")
    lists = {k: list(given.get(k, [])) for k in ("timestamps", "validation_errors", "actions", "ingredients")}
    return {"status": status, **{k: str(given.get(k, "unknown" if k == "certificate_trust" else "")) for k in FIELDS[1:] if k not in lists}, **lists}


def embedded_manifest(suffix: str, raw: bytes):
    """The manifest inside a file: a PNG chunk, or a mention of the claim container; None without."""
    if suffix == ".png" and raw.startswith(PNG):
        for kind, name, a, b in png_parts(raw):
            if kind == "chunk" and name in ("c2pa", "caBX"):
                body = raw[a + 8 : b - 4]
                try:
                    return json.loads(body)
                except ValueError:
                    return {"raw_manifest_hex": body.hex()}
    lowered = raw.lower()
    return {"embedded_claim_container": True} if b"c2pa" in lowered or b"content credentials" in lowered else None


def locate(suffix: str, raw: bytes, sidecar: tuple[str, bytes] | None, loader: Callable | None = None):
    """(manifest, location, errors); a sidecar goes before what is embedded."""
    if sidecar:
        name, content = sidecar
        try:
            return (json.loads(content.decode()) if name.lower().endswith(".json") else content), name, []
        except ValueError as e:
            return None, name, [f"malformed sidecar manifest: {e}"]
    found = embedded_manifest(suffix, raw)
    if isinstance(found, dict) and found.get("remote_url"):
        url = str(found["remote_url"])
        if loader is None:
            return None, url, ["remote manifest was not loaded"]
        try:
            return loader(url), url, []
        except Exception as e:
            return None, url, [f"remote manifest failed to load: {e}"]
    return found, "embedded" if found is not None else "", []


def examine(name: str, suffix: str, raw: bytes, sidecar=None, validator=None, loader=None) -> dict:
    """The provenance record of one asset."""
    if suffix not in dims.PROVENANCE_SUFFIXES:
        return record("UNSUPPORTED")
    manifest, where, errors = locate(suffix, raw, sidecar, loader)
    reads_content = getattr(validator, "validate_content", None) or getattr(validator, "validate_file", None)
    if reads_content:
        where = where if manifest is not None or errors else "embedded"
        call = lambda: reads_content(name, raw, where) if hasattr(validator, "validate_content") else reads_content(name, where)
    elif errors:
        return record("NOT_CHECKED" if where.startswith(("http://", "https://")) else "TAMPERED", manifest_location=where, validation_errors=errors)
    elif manifest is None:
        return record("MISSING")
    elif validator is None:
        given = manifest.get("provider", "") if isinstance(manifest, dict) else ""
        return record("NOT_CHECKED", provider=given, manifest_location=where, validation_errors=["no validator is configured"])
    else:
        call = lambda: validator(manifest, raw, where)
    try:
        said = call()
        if not isinstance(said, Mapping):
            raise TypeError("a validator returns a mapping")
        said = {k: v for k, v in said.items() if k in FIELDS}
        status = said.pop("status", "NOT_CHECKED")
        return record(status, **said | {"manifest_location": "" if status == "MISSING" else where})
    except Exception as e:
        return record("NOT_CHECKED", manifest_location=where, validation_errors=[f"validator failed: {e}"])


def findings(r: dict) -> list[tuple]:
    """(category, detector, description, confidence, location, evidence, risk) pairs for a record."""
    if r["status"] in ("MISSING", "UNSUPPORTED"):
        return []
    if r["status"] == "VALID":
        said = "valid provenance is attached", 1.0, "informational"
    elif r["status"] in ("TAMPERED", "UNTRUSTED_SIGNER"):
        said = "provenance is broken or its signer is not trusted", 0.95, "high"
    else:
        said = "provenance is attached but was not validated", 0.7, "medium"
    text, confidence, risk = said
    return [(category, detector, text, confidence, r["manifest_location"], {"status": r["status"]}, risk) for category, detector in (("C2PA_PROVENANCE", "c2pa_validation"), ("PROVENANCE", "content_credentials"))]


def _nested(value, key: str = "", listed: bool = False):
    """Every object of a JSON value, as (key that it stands under, whether in a list, object)."""
    if isinstance(value, dict):
        yield key, listed, value
    inner = value.items() if isinstance(value, dict) else ((key, x) for x in value) if isinstance(value, list) else ()
    for k, x in inner:
        yield from _nested(x, k, isinstance(value, list))


def validation_entries(payload) -> list[dict]:
    """Distinct entries with a code, anywhere in a tool's report."""
    entries = [x for key, listed, x in _nested(payload) if "code" in x and (listed or "validation" in key.lower() or {"explanation", "url"} & x.keys())]
    return list({(str(x.get("code", "")), str(x.get("explanation", ""))): x for x in reversed(entries)}.values())[::-1]


# Where a tool's report has what a record tells, as paths from the report (@: its active manifest), the first that is there.
_LABELS = ["active_manifest", "activeManifest"]
_REPORT = {
    "claim_generator": ["@.claim_generator", "@.claimGenerator"],
    "signer_identity": [f"@.{s}.{n}" for s in ("signature_info", "signatureInfo") for n in ("issuer", "common_name", "commonName")],
    "certificate_trust": [f"@.{s}.{n}" for s in ("signature_info", "signatureInfo") for n in ("cert_trust", "certificate_trust")],
}
_TIMES = [["@.signature_info.time", "@.signatureInfo.time"], ["@.signature_info.timestamp", "@.signatureInfo.timestamp"], ["@.claim_generator_time"]]
#: Whom a certificate is trusted by, where the report does not say.
_TRUST = {"UNTRUSTED_SIGNER": "untrusted", "VALID": "trusted"}


def _at(report, active: dict, paths: list[str]):
    """What stands at the first of the paths that holds something."""
    for path in paths:
        value = report
        for step in path.split("."):
            value = active if step == "@" else value.get(step) if isinstance(value, dict) else None
        if value:
            return value
    return ""


class ToolValidator:
    """Validates assets with an external command that prints a JSON report."""

    def __init__(self, command: str | Sequence[str] = "c2patool", timeout: float = 30.0):
        self.command = [command] if isinstance(command, str) else [str(x) for x in command]
        if not self.command:
            raise ValueError("the tool's command is empty")
        self.timeout = timeout

    def validate_content(self, name: str, raw: bytes, location: str = "") -> dict:
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / (Path(name).name or "asset.bin")
            path.write_bytes(raw)
            try:
                done = subprocess.run([*self.command, str(path), "-d"], capture_output=True, timeout=self.timeout, check=False)
            except FileNotFoundError:
                return {"status": "NOT_CHECKED", "validation_errors": [f"tool not found: {' '.join(self.command)}"]}
            except (subprocess.TimeoutExpired, OSError) as e:
                return {"status": "NOT_CHECKED", "validation_errors": [f"tool failed: {e}"]}
        if len(done.stdout) > TOOL_OUTPUT:
            return {"status": "NOT_CHECKED", "validation_errors": ["the tool's report is too long"]}
        try:
            payload = json.loads(done.stdout)
        except ValueError as e:
            return {"status": "NOT_CHECKED", "validation_errors": [f"the tool's report is no JSON: {e}"]}
        return self.read(payload, done.returncode, done.stderr.decode(errors="replace").strip())

    @staticmethod
    def read(payload, code: int = 0, said: str = "") -> dict:
        """A record out of a tool's report."""
        if not isinstance(payload, dict):
            return {"status": "NOT_CHECKED", "validation_errors": ["the tool's report is no object"]}
        manifests = {k: v for k, v in payload["manifests"].items() if isinstance(v, dict)} if isinstance(payload.get("manifests"), dict) else {}
        label = str(_at(payload, {}, _LABELS))
        label = label if label in manifests else next(iter(manifests), "")
        active = manifests.get(label, {})
        entries = validation_entries(payload)
        errors = [str(e.get("explanation") or e.get("code") or "validation error") for e in entries]
        untrusted = any(token in str(e.get("code", "")).lower() for e in entries for token in UNTRUSTED)
        rules = [(not label, "MISSING"), (untrusted, "UNTRUSTED_SIGNER"), (bool(entries or code), "TAMPERED"), (True, "VALID")]
        status = next(s for holds, s in rules if holds)
        if status == "TAMPERED" and not errors:
            errors = [said or f"the tool ended with {code}"]
        told = {name: str(_at(payload, active, paths)) for name, paths in _REPORT.items()}
        acts = [x["data"].get("actions") or [] for x in active.get("assertions") or [] if isinstance(x, dict) and str(x.get("label", "")).startswith("c2pa.actions") and isinstance(x.get("data"), dict)]
        actions = [a for some in acts for a in some if isinstance(a, dict)]
        return told | {
            "status": status, "provider": told["signer_identity"], "certificate_trust": told["certificate_trust"] or _TRUST.get(status, "unknown"), "manifest_label": label,
            "digital_source_type": next((str(a["digitalSourceType"]) for a in actions if a.get("digitalSourceType")), ""), "timestamps": [str(t) for t in (_at(payload, active, p) for p in _TIMES) if t],
            "validation_errors": errors, "actions": actions, "ingredients": [x for x in active.get("ingredients") or [] if isinstance(x, dict)],
        }
