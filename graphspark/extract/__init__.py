"""Source text to facts: nodes, edges and transforms of one file at a time, in plain Python."""

from __future__ import annotations

from collections.abc import Callable

from graphspark.extract.facts import Facts
from graphspark.sources.languages import detect_language


def _extractors() -> dict[str, Callable[[Facts], None]]:
    from graphspark.extract import golang, javascript, python_

    return {"python": python_.extract, "javascript": javascript.extract, "typescript": javascript.extract_typescript, "go": golang.extract}


#: Extractors that callers add, by language; they take the ``Facts`` of a file and add to them.
REGISTERED: dict[str, Callable[[Facts], None]] = {}


def extract(path: str, source: str, language: str | None = None) -> Facts | None:
    """The facts of a file, or None if no extractor knows its language."""
    language = language or detect_language(path)
    run = REGISTERED.get(language) or _extractors().get(language)
    if run is None:
        return None
    facts = Facts(path, source)
    run(facts)
    return facts
