"""Which files belong to which language."""

from __future__ import annotations

import os

# File extensions.
EXTENSIONS = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}


def detect_language(path: str) -> str | None:
    return EXTENSIONS.get(os.path.splitext(path)[1].lower())
