"""Fixed values of the detector: kinds, order of precedence, patterns, formats and limits."""

from __future__ import annotations

# Kinds and their labels.
LABELS = {
    "email": "Email address",
    "phone": "Phone-like number",
    "cnic": "CNIC-like number",
    "card": "Luhn-valid card-like number",
    "ipv4": "IPv4 address",
    "iban": "IBAN",
    "name": "Labeled name",
    "address": "Labeled address",
    "custom": "Custom private text",
}
# Order in which overlapping findings win.
PRIORITY = {"custom": 0, "address": 1, "name": 2, "email": 3, "iban": 4, "card": 5, "cnic": 6, "ipv4": 7, "phone": 8}

# What the kinds look like, in Java's dialect. Classes are spelled out, as the engine's
# shorthands for letters, digits and spaces are not those the results are defined by.
_WORD = r"\p{L}\p{N}_"
_MAIL = "A-Za-zİıſK"
_GAP = r"[\s\x1c-\x1f\x85\p{Z}]*"
PATTERNS = {
    "email": rf"(?<![{_WORD}.+-])[{_MAIL}0-9._%+-]{{1,64}}@[{_MAIL}0-9.-]{{1,190}}\.[{_MAIL}]{{2,30}}(?![{_WORD}.-])",
    "cnic": r"(?<!\p{Nd})\p{Nd}{5}-\p{Nd}{7}-\p{Nd}(?!\p{Nd})",
    "card": r"(?<!\p{Nd})(?:\p{Nd}[ -]?){12,18}\p{Nd}(?!\p{Nd})",
    "ipv4": r"(?<![\p{Nd}.])(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}(?![\p{Nd}.])",
    "phone": rf"(?<![{_WORD}])\+?\p{{Nd}}[\p{{Nd}} ()+.-]{{6,24}}\p{{Nd}}(?![{_WORD}])",
    "iban": rf"(?<![{_WORD}])[A-Z]{{2}}\p{{Nd}}{{2}}(?: ?[A-Z0-9]){{11,30}}(?![{_WORD}])",
    "name": rf"(?iumd)^((?:full name|name|patient|customer){_GAP}:{_GAP})([^\r\n]{{2,120}})",
    "address": rf"(?iumd)^((?:home address|postal address|address){_GAP}:{_GAP})([^\r\n]{{5,200}})",
}
#: Kinds whose finding is what follows a label.
LABELLED = ("name", "address")
#: Cheap tests that every text with a finding of a kind passes.
MAY_HOLD = {
    "email": "@",
    "cnic": r"\p{Nd}{5}-\p{Nd}",
    "card": r"\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}",
    "ipv4": r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}",
    "phone": r"\p{Nd}[\p{Nd} ()+.-]{6}",
    "iban": r"[A-Z]{2}\p{Nd}{2}",
    "name": ":",
    "address": ":",
}

PREVIEW = "[private value]"
BLOCK = "[REDACTED]"

# Limits.
MAX_TEXT = 250_000
MAX_LITERALS = 30
MAX_LITERAL = 200
MAX_CANDIDATES = 6000
MAX_FILE_BYTES = 25 * 1024 * 1024
MAX_EXPANDED_BYTES = 50 * 1024 * 1024
MAX_ARCHIVE_ENTRIES = 1000
MAX_ARCHIVE_SCAN = 100
MAX_XML_BYTES = 5 * 1024 * 1024
MAX_PIXELS = 40_000_000
MAX_FILES = 20_000

# File formats.
TEXT_FORMATS = ".txt .md .csv .tsv .json .jsonl .log .py .js .ts .jsx .tsx .html .css .xml .yaml .yml .toml .ini .cfg .rst .sql .sh .bat .c .cpp .h .java .rs .go .srt .vtt".split()
OFFICE_FORMATS = ".docx .pptx .xlsx .odt .ods .odp".split()
NATIVE_OFFICE = ".docx .pptx .xlsx .docm .pptm .xlsm".split()
IMAGE_FORMATS = ".png .jpg .jpeg .tiff .tif .bmp .webp".split()
MACRO_FORMATS = {".docm": ".docx", ".xlsm": ".xlsx", ".pptm": ".pptx"}
EXCLUDED = (".git", ".venv", "venv", "node_modules", "__pycache__", ".local-data", ".localflow", ".env", ".ssh", ".aws", ".config", "AppData")
DEVICE_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


class InputError(ValueError):
    """A request that cannot be met: unknown kind, too many literals, a limit passed."""


def enabled_kinds(enabled: list[str] | None) -> list[str]:
    """None means all kinds, an empty list none; unknown kinds are an error."""
    kinds = list(LABELS) if enabled is None else enabled
    if not isinstance(kinds, list) or any(k not in LABELS for k in kinds):
        raise InputError("unknown detector kind")
    return kinds


def checked_literals(literals: list[str] | None) -> list[str]:
    literals = literals or []
    if not isinstance(literals, list) or len(literals) > MAX_LITERALS or any(not isinstance(s, str) or not 1 <= len(s) <= MAX_LITERAL for s in literals):
        raise InputError(f"literals: up to {MAX_LITERALS}, each of 1 to {MAX_LITERAL} characters")
    return literals


def literals_of(text: str) -> list[str]:
    """Literals from a newline-separated text: stripped, blank lines left out."""
    return [s.strip() for s in text.splitlines() if s.strip()]
