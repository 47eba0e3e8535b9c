"""One spelling for file paths that name the same place."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

_SEPARATORS = re.compile(r"[\\/]+")


def directory_of(path: str | None, root: str = "photos") -> str | None:
    """The directory of path below and with its part root, in one spelling; null for null, blank and bare file names.

    Letter case, composition, kind and number of slashes, percent escapes of file: URLs, "." parts and whatever stands
    before root (drives, mounts) don't matter. A path without root keeps all its parts.
    """
    path = (path or "").strip()
    if path[:5].lower() == "file:":
        path = unquote(path[5:])
    parts = [p for p in _SEPARATORS.split(unicodedata.normalize("NFC", unicodedata.normalize("NFC", path).lower())) if p not in ("", ".")][:-1]
    if root in parts:
        parts = parts[parts.index(root) :]
    return "/".join(parts) or None
