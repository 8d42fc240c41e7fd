"""Column expressions over node ids, scopes, locations and code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphspark.schema import EXTERNAL, META

_LOCATION = r"^(.*):(\d+):(\d+)$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_of(node: Column) -> Column:
    """``a.py#f`` to ``a.py``; an external node has no file."""
    return F.substring_index(node, "#", 1)


def symbol_of(node: Column) -> Column:
    """What follows the first ``#``."""
    return F.when(F.instr(node, "#") > 0, F.substr(node, F.instr(node, "#") + 1)).otherwise(F.lit(""))


def is_external(node: Column) -> Column:
    return node.startswith(EXTERNAL)


def scope_of(node: Column) -> Column:
    """The scope that an edge from this node is in: ``a.py#`` to ``a.py``, ``a.py#f`` to ``a.py:f``."""
    return F.when(F.instr(node, "#") == 0, node).when(symbol_of(node) == "", file_of(node)).otherwise(F.concat(file_of(node), F.lit(":"), symbol_of(node)))


def inner_scope(node: Column) -> Column:
    """The scope of what is defined inside this node."""
    return F.replace(node, F.lit("#"), F.lit(":"))


def location_file(location: Column) -> Column:
    return F.regexp_extract(location, _LOCATION, 1)


def location_line(location: Column) -> Column:
    return F.regexp_extract(location, _LOCATION, 2).try_cast("int")


def location_col(location: Column) -> Column:
    return F.regexp_extract(location, _LOCATION, 3).try_cast("int")


def location_order(location: Column) -> Column:
    """Sorts locations by file, then by line and column as numbers."""
    return F.struct(location_file(location), location_line(location), location_col(location), location)


def fold(text: Column) -> Column:
    """ASCII letters in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def contains_folded(text: Column, wanted: str) -> Column:
    """Literal search that ignores the case of ASCII letters; no character is a wildcard."""
    return F.contains(fold(text), F.lit(wanted.translate(str.maketrans(UPPER, LOWER))))


def role(code: Column) -> Column:
    """What a statement does with a symbol: definition, import, call or reference."""
    head = F.ltrim(code)
    starts = lambda *words: _any(*[head.startswith(w) for w in words])
    early = F.substring(head, 1, 50)
    definition = starts("def ", "class ", "type ", "func ", "function ", "async function ") | F.contains(early, F.lit(" struct {")) | F.contains(early, F.lit(" interface {"))
    imported = starts("from ", "import ") | (starts("var ", "const ", "let ") & F.contains(head, F.lit("require")))
    called = F.contains(code, F.lit("(")) & ~F.contains(F.substring_index(code, "(", 1), F.lit("="))
    return F.when(definition, "definition").when(imported, "import").when(called, "call").otherwise("reference")


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def metadata(text: Column) -> Column:
    """The metadata of an edge as a struct; malformed text gives nulls."""
    return F.from_json(text, META)


def language(path: Column) -> Column:
    """Language by file extension, empty if unknown."""
    from graphspark.sources.languages import EXTENSIONS

    extension = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    out = F.lit("")
    for ext, lang in EXTENSIONS.items():
        out = F.when(extension == ext, lang).otherwise(out)
    return out


def is_test_file(path: Column) -> Column:
    return path.startswith("test") | F.contains(path, F.lit("/test")) | path.endswith("_test.go") | F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec."))


def is_test_name(name: Column) -> Column:
    return name.startswith("test") | name.startswith("Test") | name.endswith("_test") | name.endswith("Test")


def module_of(path: Column) -> Column:
    """``a/b.py`` to ``a.b``."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py$", "")


def stem_of(path: Column) -> Column:
    """``a/b.py`` to ``b``."""
    return F.replace(F.substring_index(path, "/", -1), F.lit(".py"), F.lit(""))
