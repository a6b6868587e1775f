"""Settings from a key=value file under the environment."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

#: Keys and defaults.
DEFAULTS = {
    "DATABASE_URL": "", "DATA_DIR": "data", "VERBOSE": "false", "CHAT_TEMPLATE": "", "LOW_MEMORY": "false", "DPI_SHARP": "100", "DPI_MEDIUM": "150", "DPI_BLUR": "200",
    "BLUR_THRESHOLD_SHARP": "5e8", "BLUR_THRESHOLD_MEDIUM": "5e7", "YEAR_RANGE": "", "PAGE_COUNT_RANGE": "-5", "PAGE_COUNT_ORDER": "asc", "CLASSIFY_PAGE_WINDOW": "2", "TEXT_CHECK": "true",
    "CHEAP_TIER": "true", "TESSERACT_LANG": "ind", "DEBUG_RESULT": "false", "DEBUG_DIR": "debug",
}


def parse(text: str) -> dict[str, str]:
    """Pairs of a file: comments and blank lines skipped, an `export ` before a key and quotes around a value dropped."""
    found = {}
    for line in text.splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not key.startswith("#"):
            value = value.strip()
            found[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


def load(path: str | None = None, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Defaults, under the file, under the environment."""
    environ = dict(os.environ) if environ is None else environ
    read = parse(Path(path).read_text()) if path and Path(path).exists() else {}
    return DEFAULTS | read | {k: v for k, v in environ.items() if k in DEFAULTS or k in read}


def boolean(value: str) -> bool:
    return value.strip().lower() in ("1", "true", "yes", "on", "ya")


def number(value: str, default: int) -> int:
    try:
        return int(value.strip())
    except ValueError:
        return default


def fingerprint(prompts: dict[str, str]) -> str:
    """Sixteen hexadecimal digits over all prompts, in order of their names."""
    return hashlib.sha256("\0".join(prompts[k] for k in sorted(prompts)).encode()).hexdigest()[:16]
