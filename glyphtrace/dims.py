"""Fixed lookup tables: characters, byte markers, file suffixes. Descriptions are ours; code points and suffixes are data."""

from __future__ import annotations

# Zero-width characters.
ZERO_WIDTH = {
    "\u200b": "zero width space",
    "\u200c": "zero width non-joiner",
    "\u200d": "zero width joiner",
    "\u200e": "left-to-right mark",
    "\u200f": "right-to-left mark",
    "\ufeff": "byte order mark",
    "\u2060": "word joiner",
    "\u2061": "function application",
    "\u2062": "invisible times",
    "\u2063": "invisible separator",
    "\u2064": "invisible plus",
    "\u00ad": "soft hyphen",
}

# Look-alikes of Latin letters, as (Latin letter, script and name).
HOMOGLYPHS = {
    "\u0430": ("a", "Cyrillic a"),
    "\u0435": ("e", "Cyrillic ie"),
    "\u043e": ("o", "Cyrillic o"),
    "\u0440": ("p", "Cyrillic er"),
    "\u0441": ("c", "Cyrillic es"),
    "\u0445": ("x", "Cyrillic ha"),
    "\u04cf": ("l", "Cyrillic palochka"),
    "\u0456": ("i", "Cyrillic i"),
    "\u03bf": ("o", "Greek omicron"),
    "\u03c1": ("p", "Greek rho"),
    "\u03b5": ("e", "Greek epsilon"),
    "\u0391": ("A", "Greek capital alpha"),
    "\u0392": ("B", "Greek capital beta"),
    "\u0395": ("E", "Greek capital epsilon"),
    "\u039a": ("K", "Greek capital kappa"),
    "\u039c": ("M", "Greek capital mu"),
    "\u039d": ("N", "Greek capital nu"),
    "\u039f": ("O", "Greek capital omicron"),
    "\u03a1": ("P", "Greek capital rho"),
    "\u03a4": ("T", "Greek capital tau"),
    "\u03a7": ("X", "Greek capital chi"),
    "\u03a5": ("Y", "Greek capital upsilon"),
    "\u2126": ("O", "Ohm sign"),
}

# Direction controls that a sanitizer deletes.
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2069"

# Other suspicious characters.
SUSPICIOUS = {
    "\u00a0": "no-break space",
    "\u202a": "left-to-right embedding",
    "\u202b": "right-to-left embedding",
    "\u202c": "pop directional formatting",
    "\u202d": "left-to-right override",
    "\u202e": "right-to-left override",
    "\u2066": "left-to-right isolate",
    "\u2067": "right-to-left isolate",
    "\u2069": "pop directional isolate",
    "\u034f": "combining grapheme joiner",
    "\u115f": "Hangul choseong filler",
    "\u1160": "Hangul jungseong filler",
    "\u3164": "Hangul filler",
    "\uffa0": "halfwidth Hangul filler",
}
#: The isolate that the default tables leave out; options named extended_bidi add it.
FIRST_STRONG_ISOLATE = "\u2068"

# Order in which byte sequences are searched in binaries (it decides which hits a cap keeps).
BINARY_ORDER = [*ZERO_WIDTH, "\u202a", "\u202b", "\u202c", "\u202d", "\u202e", "\u2066", "\u2067", "\u2069", "\u034f", "\u00a0", "\u3164", "\uffa0", "\u115f", "\u1160"]

# Suffixes of text files.
TEXT_SUFFIXES = (
    ".txt .md .tex .rtf .log .csv .tsv .svg .xml .html .htm .asp .jsp .htaccess .json .yaml .yml .toml .ini .conf .env .gitignore "
    ".kubeconfig dockerfile .py .js .ts .java .cpp .c .go .rs .rb .php .css .scss .jsx .tsx .vue .sh .bat .tf .gradle .pom"
).split()
# Suffixes of binary files.
BINARY_SUFFIXES = (
    ".doc .docx .xls .xlsx .odt .ods .pages .pdf .jpg .jpeg .png .gif .bmp .tiff .tif .webp .ico .heic .psd .mp4 .mkv .avi .mov .wmv "
    ".flv .webm .m4v .mpg .mpeg .3gp .mp3 .wav .aac .flac .ogg .m4a .wma .aiff .opus .mid .zip .rar .7z .tar .gz .bz2 .iso .dmg .pkg "
    ".deb .exe .msi .app .dll .sys .bin .wasm .apk .ipa .parquet .avro"
).split()
# Lossless images whose pixels are analysed.
LSB_SUFFIXES = [".png", ".bmp", ".gif", ".tif", ".tiff"]
# Suffixes of containers and of members that are opened.
ZIP_SUFFIXES = [".zip", ".docx", ".pptx", ".xlsx"]
NESTED_ARCHIVES = [".zip", ".docx", ".pptx", ".xlsx", ".jar", ".apk"]
MEMBER_SUFFIXES = [".svg", ".png", ".jpg", ".jpeg", ".zip", ".docx", ".pptx", ".xlsx", ".pdf", ".html", ".htm"]
BMFF_SUFFIXES = [".mp4", ".mov", ".m4v", ".3gp"]
PROVENANCE_SUFFIXES = [".svg", ".png", ".jpg", ".jpeg"]

# Names of dependency and build folders, their suffixes and marker files.
DEPENDENCY_FOLDERS = (
    "venv .venv env .env virtualenv .virtualenv __pycache__ .tox .nox site-packages dist-packages dist build eggs .eggs *.egg-info "
    "node_modules .yarn .pnp .npm .pnpm-store .bundle vendor gems target .gradle .m2 out .idea .classpath .dart_tool .pub-cache .pub "
    "Pods .build DerivedData _build .mix deps .stack-work dist-newstyle .cabal .julia renv .renv packrat .terraform .cache "
    ".pytest_cache .mypy_cache .ruff_cache __pypackages__ .hypothesis"
).split()
DEPENDENCY_FOLDER_ENDS = (".egg-info", ".dist-info", ".egg-link")
DEPENDENCY_MARKERS = ["pyvenv.cfg", "activate", "pip-selfcheck.json", ".node_version", ".nvmrc"]

# Byte markers, lower case, and what they stand for.
ROBUST_MARKERS = {
    "IMAGE_ROBUST": {"dct-watermark": "transform_domain", "dwt-watermark": "transform_domain", "correlation-template": "correlation", "spread-spectrum-image": "spread_spectrum"},
    "AUDIO_ROBUST": {"phase_watermark": "phase", "echo-hiding": "echo", "spread-spectrum-audio": "spread_spectrum", "spectral_watermark": "spectral", "silence-interval-watermark": "silence_interval"},
    "VIDEO_ROBUST": {"frame_watermark": "frame", "motion_vector_watermark": "motion_vector", "chroma-watermark": "chroma", "audio_track_watermark": "audio_track"},
}
ROBUST_SUFFIXES = {
    "IMAGE_ROBUST": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"],
    "AUDIO_ROBUST": [".wav", ".mp3", ".flac", ".ogg", ".aac", ".m4a", ".opus", ".aiff"],
    "VIDEO_ROBUST": [".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v", ".mpeg", ".mpg"],
}
ROBUST_FAMILIES = {
    "IMAGE_ROBUST": ["transform_domain", "correlation"],
    "AUDIO_ROBUST": ["phase", "echo", "spread_spectrum", "spectral", "silence_interval"],
    "VIDEO_ROBUST": ["frame", "motion_vector", "chroma", "audio_track"],
}
FINGERPRINT_MARKERS = {
    "make=": "camera_make",
    "model=": "camera_model",
    "software=": "codec_or_software",
    "encoder=": "codec_encoder",
    "device_fingerprint=": "device_fingerprint",
    "printer_fingerprint=": "printer_fingerprint",
    "camera_fingerprint=": "camera_fingerprint",
}
PDF_MARKERS = {"/EmbeddedFile": "embedded file", "/Filespec": "file specification", "/OCG": "optional hidden-content group", "/JavaScript": "embedded JavaScript", "/Launch": "launch action"}
PDF_METADATA = ["/author", "/title", "/subject", "/keywords", "/creator", "/producer"]

# Names of categories and statuses.
CATEGORIES = ["TEXT_PATTERN", "LAYOUT", "NETWORK_OR_EXTERNAL", "STRUCTURAL", "METADATA", "IMAGE_ROBUST", "AUDIO_ROBUST", "VIDEO_ROBUST", "FINGERPRINT", "C2PA_PROVENANCE", "PROVENANCE", "AI_TEXT_WATERMARK"]
PROVENANCE_STATUSES = ["VALID", "TAMPERED", "UNTRUSTED_SIGNER", "MISSING", "UNSUPPORTED", "NOT_CHECKED"]
MEDIA_STATUSES = ["DETECTED", "NOT_DETECTED", "NOT_CHECKED", "ERROR"]

#: Line breaks as a character class body (Java and RE2), CR LF aside.
BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
#: White space and word characters of Unicode, as class bodies.
SPACES = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = r"\p{L}\p{N}_"

# Styles that hide content, by name (case is ignored).
LAYOUT_PATTERNS = {
    "display_none": rf"display[{SPACES}]*:[{SPACES}]*none",
    "zero_opacity": rf"opacity[{SPACES}]*:[{SPACES}]*0[;\"'{SPACES}]",
    "zero_font": rf"font-size[{SPACES}]*:[{SPACES}]*0",
    "visibility_hidden": rf"visibility[{SPACES}]*:[{SPACES}]*hidden",
    "off_canvas": rf"(?:left|top)[{SPACES}]*:[{SPACES}]*-\p{{Nd}}{{3,}}(?:px|pt)",
}
# Patterns of intervals between sentences and of addresses, and the punctuation that ends none.
TYPOGRAPHY_PATTERN = rf"[.!?](?:[{SPACES}]+[{WORDS}]+){{1,4}}[{SPACES}]{{2}}"
URL_PATTERN = rf"https?://[^\"'<>{SPACES}]+"
URL_TAIL = ".,;:!?)]}"
