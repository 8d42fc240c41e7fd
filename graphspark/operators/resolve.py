"""Resolving names across files, as ranked equi-joins instead of a lookup for each edge.

Every rule proposes targets for edges with a rank; the least rank wins, ties go by preference of file, then by id. Rules
join on all they fix (name and scope, file, directory or stem), and where a rule leaves a choice its candidates are brought
down to the one or two that can win before the join, so common names don't multiply calls by definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions import columns as C
from graphspark.operators.checkpoints import stored
from graphspark.schema import EXTERNAL


def _external_name(to: Column) -> Column:
    return F.when(to.startswith(EXTERNAL), F.substr(to, F.lit(len(EXTERNAL) + 1)))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _family(path: Column) -> Column:
    """Languages that can call each other: Python, JavaScript with TypeScript, Go."""
    return F.when(path.endswith(".py"), "py").when(path.endswith(".go"), "go").otherwise("js")


def _best(proposals: DataFrame) -> DataFrame:
    """``(id, target, rank)``, the best proposal of each edge."""
    return proposals.groupBy("id").agg(F.min(F.struct("rank", "preference", "target")).alias("x")).select("id", "x.target", "x.rank")


def resolve_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, target)``: import edges to externals that name a function or class of a file in the graph.

    The last part of the name is the symbol, what comes before it the module: the file's stem is the module's last part,
    or its path contains the module's path. Without a module part any homonym fits. The least id wins.
    """
    asked = edges.where(F.col("edge_type") == "imports").select("id", _external_name(F.col("raw_to_node")).alias("full")).where("full IS NOT NULL")
    asked = asked.select("id", F.substring_index("full", ".", -1).alias("name"), F.when(F.contains("full", F.lit(".")), F.regexp_extract("full", r"^(.*)\.[^.]*$", 1)).otherwise("").alias("module"))
    symbols = nodes.where(F.col("kind").isin("Function", "Class")).select("name", F.col("id").alias("target"), C.file_of(F.col("id")).alias("file"))
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")
    path = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    fits = (F.col("module") == "") | (stem == F.substring_index("module", ".", -1)) | F.contains("file", path)
    # Many files import the same: each (module, name) is looked up once.
    found = asked.select("name", "module").distinct().join(symbols, "name").where(fits).groupBy("name", "module").agg(F.min("target").alias("target"))
    return asked.join(found, ["name", "module"]).select("id", "target")


def _stem(path: Column) -> Column:
    """The name that imports use for a file: its folder for ``index`` and ``__init__`` files."""
    entry = r"/(?:index|__init__)\.[^./]+$"
    return F.when(path.rlike(entry), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).otherwise(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))


def _least_two(symbols: DataFrame, *key: str) -> DataFrame:
    """For each key the least target with its file, ``target t_file``, and the least in another file, ``other``."""
    per_file = symbols.groupBy(*key, "t_file").agg(F.min("target").alias("target"))
    place = Window.partitionBy(*key).orderBy("target")
    two = per_file.withColumn("place", F.row_number().over(place)).where("place <= 2")
    first = lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))
    return two.groupBy(*key).agg(first("target", 1).alias("target"), first("t_file", 1).alias("t_file"), first("target", 2).alias("other"))


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, target, rank)`` for call edges that don't lead to a function or class yet.

    Ranks: 0 own class of ``this.m``; 1 ``Owner.m`` in the same file; 2 a method of an imported module; 3 a method of a
    class around the caller; 4 a top-level function of the file for a method of a local; 5 last name of a chain in the
    caller's class; 6 any top-level function of the name, other files first; 7 any method, other files first; 8 a bare
    name in the file, in Go in the directory; 9 what the file imports under the name, a function first, else the symbol
    that the longest module path in the imported name leads to.
    """
    symbols = nodes.where(F.col("kind").isin("Function", "Class")).select(F.col("id").alias("target"), "kind", "name", F.col("scope").alias("t_scope"), C.file_of(F.col("id")).alias("t_file"))
    calls = edges.where(F.col("edge_type") == "calls").select("id", "from_node", F.col("raw_to_node").alias("to"))
    open_calls = calls.join(symbols.select("target"), F.col("to") == F.col("target"), "left_anti")
    full = F.coalesce(_external_name(F.col("to")), C.symbol_of(F.col("to")))
    open_calls = open_calls.select("id", "from_node", "to", full.alias("full"), C.file_of(F.col("from_node")).alias("file"), C.symbol_of(F.col("from_node")).alias("caller"))
    open_calls = open_calls.withColumns({"name": F.substring_index("full", ".", -1), "owner": F.regexp_extract("full", r"^(.*)\.[^.]*$", 1), "around": F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1)})

    # All rules below read these, so they are worked out once.
    open_calls, symbols = stored(open_calls, "open-calls"), stored(symbols, "symbols")
    functions = symbols.where("kind = 'Function'")

    scope, dotted, this = F.col("t_scope"), F.col("owner") != "", F.col("owner") == "this"
    in_scope = functions.groupBy("name", F.col("t_scope").alias("wanted")).agg(F.min("target").alias("target"))
    top, methods = functions.where(~F.contains(scope, F.lit(":"))), functions.where(F.contains(scope, F.lit(":")))
    caller_class = F.concat("file", F.lit(":"), "around")

    def proposal(rows: DataFrame, rank: int, preference: Column | None = None) -> DataFrame:
        return rows.select("id", F.lit(rank).alias("rank"), (F.lit(0) if preference is None else preference).cast("int").alias("preference"), "target")

    def scoped(rows: DataFrame, wanted: Column, rank: int) -> DataFrame:
        return proposal(rows.withColumn("wanted", wanted).join(in_scope, ["name", "wanted"]), rank)

    def anywhere(candidates: DataFrame, rank: int) -> DataFrame:
        # The loosest rules stay within a language: a name that another language shares says nothing about a call.
        two = _least_two(candidates.withColumn("family", _family(F.col("t_file"))), "name", "family")
        hit = open_calls.where(dotted).withColumn("family", _family(F.col("file"))).join(two, ["name", "family"])
        own = F.col("file") == F.col("t_file")
        chosen = hit.withColumn("target", F.when(own, F.coalesce("other", "target")).otherwise(F.col("target")))
        return proposal(chosen, rank)

    # Classes around the caller, from the innermost: A.B.m is in A.B and in A.
    parts = F.split("around", r"\.")
    classes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.col("file"), F.lit(":"), F.array_join(F.slice(parts, 1, k), ".")))
    enclosed = open_calls.where(dotted & (F.col("around") != "")).withColumn("wanted", F.explode(classes))

    file_top = top.groupBy("name", F.col("t_file").alias("file")).agg(F.min("target").alias("target"))
    file_any = symbols.groupBy("name", F.col("t_file").alias("file")).agg(F.min("target").alias("target"))
    go = F.col("t_file").endswith(".go")
    go_any = symbols.where(go).groupBy("name", _directory(F.col("t_file")).alias("directory")).agg(F.min("target").alias("target"))
    bare = open_calls.where(~dotted)

    imports = edges.where((F.col("edge_type") == "imports") & F.col("to_node").startswith(EXTERNAL)).select(C.file_of(F.col("from_node")).alias("file"), _external_name(F.col("to_node")).alias("imported")).distinct()
    modules = imports.select("file", F.explode(F.array_distinct(F.array("imported", F.regexp_replace("imported", r"\.[^.]*$", "")))).alias("module"))
    modules = modules.select("file", F.regexp_replace(F.regexp_replace("module", r"^[./]+", ""), r"\.(js|ts|py|go)$", "").alias("module")).select("file", F.substring_index(F.regexp_replace("module", "/", "."), ".", -1).alias("stem")).distinct()
    in_module = _least_two(functions.withColumn("stem", _stem(F.col("t_file"))), "name", "stem")
    called = open_calls.where(dotted)
    # What the names that a file calls and the modules that it imports have in common, once for the file.
    reached = called.select("file", "name").distinct().join(modules, "file").join(in_module, ["name", "stem"]).withColumn("target", F.when(F.col("file") == F.col("t_file"), F.col("other")).otherwise(F.col("target"))).where("target IS NOT NULL").select("file", "name", "stem", "target")
    through_module = proposal(called.join(reached, ["file", "name"]), 2, F.when(F.col("stem") == F.substring_index("owner", ".", -1), 0).otherwise(1))

    raw_imports = edges.where((F.col("edge_type") == "imports") & F.col("raw_to_node").startswith(EXTERNAL)).select(C.file_of(F.col("from_node")).alias("file"), _external_name(F.col("raw_to_node")).alias("imported"), F.col("id").alias("import_id")).withColumn("name", F.substring_index("imported", ".", -1))
    resolved = resolve_imports(nodes, edges).join(functions.select("target"), "target", "left_semi").withColumnRenamed("id", "import_id")
    by_import = raw_imports.join(resolved, "import_id").groupBy("file", "name").agg(F.min("target").alias("target"))
    through_import = proposal(open_calls.join(by_import, ["file", "name"]), 9)

    # An imported name, completed by what the call adds, is a module's path and a symbol in it; the longest path first.
    local = raw_imports.select("file", F.col("name").alias("head"), "imported").distinct()
    whole = open_calls.withColumn("head", F.substring_index("full", ".", 1)).join(local, ["file", "head"]).select("id", "file", F.split(F.concat("imported", F.expr("substring(full, length(head) + 1)")), r"\.").alias("parts"))
    splits = whole.withColumn("k", F.explode(F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1)).otherwise(F.array().cast("array<int>"))))
    splits = splits.select("id", "file", (F.size("parts") - F.col("k")).alias("left"), F.element_at("parts", -1).alias("name"), F.regexp_replace(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"), r"^[./]+", "").alias("module"), F.expr("array_join(slice(parts, k + 1, size(parts) - k - 1), '.')").alias("outer"))
    homes = symbols.withColumn("stem", _stem(F.col("t_file"))).withColumn("path", F.regexp_replace(F.regexp_replace("t_file", r"/(?:index|__init__)\.[^./]+$", ""), r"\.[^./]+$", ""))
    homes = homes.withColumn("outer", F.when(F.contains(scope, F.lit(":")), F.substring_index("t_scope", ":", -1)).otherwise(""))
    homes = homes.groupBy("name", "stem", "outer", "path", "t_file").agg(F.min("target").alias("target"))
    at_home = (F.col("path") == F.col("module")) | F.endswith("path", F.concat(F.lit("/"), F.col("module")))
    through_split = proposal(splits.withColumn("stem", F.substring_index("module", "/", -1)).join(homes, ["name", "stem", "outer"]).where(at_home & (F.col("file") != F.col("t_file"))), 9, F.col("left"))

    proposals = [
        scoped(open_calls.where(this), caller_class, 0),
        scoped(open_calls.where(dotted & ~this), F.concat("file", F.lit(":"), "owner"), 1),
        through_module,
        proposal(enclosed.join(in_scope, ["name", "wanted"]), 3),
        proposal(called.join(file_top, ["file", "name"]), 4),
        scoped(open_calls.where(F.instr("owner", ".") > 0), caller_class, 5),
        anywhere(top, 6),
        anywhere(methods, 7),
        proposal(bare.join(file_any, ["file", "name"]), 8),
        proposal(bare.where(F.col("file").endswith(".go")).withColumn("directory", _directory(F.col("file"))).join(go_any, ["name", "directory"]), 8, F.lit(1)),
        through_import,
        through_split,
    ]
    out = proposals[0]
    for p in proposals[1:]:
        out = out.unionByName(p)
    return _best(out)


def homonyms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, homonyms, elsewhere)`` of the calls whose name top-level functions bear: how many, and the least one of another file.

    Both depend on the name and the caller's file only, so a call meets one row of its name, however many bear it.
    """
    top = nodes.where("kind = 'Function' AND NOT contains(scope, ':')").select(F.col("id").alias("target"), "name", C.file_of(F.col("id")).alias("t_file"))
    names = stored(top.groupBy("name").agg(F.countDistinct("target").alias("homonyms")).join(_least_two(top, "name"), "name"), "homonyms")
    calls = edges.where("edge_type = 'calls'").select("id", C.file_of(F.col("from_node")).alias("file"), F.substring_index("raw_to_node", ":", -1).alias("name"))
    elsewhere = F.when(F.col("file") != F.col("t_file"), F.col("target")).when(F.col("file") == F.col("t_file"), F.col("other"))
    # Edges that share an id count each name once.
    by_name = calls.join(names, "name").groupBy("id", "name").agg(F.first("homonyms").alias("homonyms"), F.min(elsewhere).alias("elsewhere"))
    return by_name.groupBy("id").agg(F.sum("homonyms").alias("homonyms"), F.min("elsewhere").alias("elsewhere"))


def apply_resolution(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``edges`` with the targets found; arguments and other metadata stay, and calls without a target say ``unknown``."""
    joined = edges.join(targets.select("id", "target"), "id", "left")
    unknown = (F.col("edge_type") == "calls") & F.col("target").isNull() & F.col("to_node").startswith(EXTERNAL)
    marked = F.to_json(F.struct(*[C.metadata(F.col("metadata"))[f].alias(f) for f in ("args", "decorator", "arg_index", "arg_kind", "call_edge")], F.lit(True).alias("unknown")))
    values = {"to_node": F.coalesce("target", "to_node"), "metadata": F.when(unknown, marked).otherwise(F.col("metadata"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in edges.columns])


def function_params(nodes: DataFrame) -> DataFrame:
    """``(function, position, param, name)``: parameters by line and column, from 0."""
    params = nodes.where("kind = 'Variable' AND is_param = 1").select(F.col("id").alias("param"), "name", "location", "scope")
    functions = nodes.where("kind = 'Function'").select(F.col("id").alias("function"), C.inner_scope(F.col("id")).alias("scope"))
    place = Window.partitionBy("function").orderBy(C.location_line(F.col("location")), C.location_col(F.col("location")), "param")
    return functions.join(params, "scope").select("function", (F.row_number().over(place) - 1).alias("position"), "param", "name")


def param_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from argument variables to the parameters that take them, for calls that lead to a function.

    Arguments go by position, keyword arguments by name. ``self`` and ``cls`` of a method and a receiver in Go take none.
    """
    calls = edges.where("edge_type = 'calls'").select("id", "from_node", "to_node", "location", "code", C.metadata(F.col("metadata"))["args"].alias("args"))
    args = calls.select("id", "from_node", "to_node", "location", "code", F.explode("args").alias("arg")).where(F.col("arg.kind").isin("name", "attr", "kw") & (F.col("arg.name") != ""))
    params = function_params(nodes)
    own = Window.partitionBy("function").orderBy("position")
    receiver = C.file_of(F.col("function")).endswith(".go") & F.contains(C.symbol_of(F.col("function")), F.lit("."))
    params = params.withColumn("bound", (F.first("name").over(own).isin("self", "cls") | receiver).cast("int")).withColumn("position", F.col("position") - F.col("bound")).where("position >= 0")
    by_name = F.col("arg.kw").isNotNull()
    hit = args.join(params, (F.col("to_node") == F.col("function")) & F.when(by_name, F.col("arg.kw") == F.col("name")).otherwise(F.col("arg.index") == F.col("position")))
    caller_scope = C.scope_of(F.col("from_node"))
    variables = nodes.where("kind = 'Variable'").select(F.col("id").alias("source"), F.col("name").alias("v_name"), F.col("scope").alias("v_scope"))
    # The variable of the caller's own scope, or of the module.
    near = hit.withColumn("caller", caller_scope).join(variables, (F.col("arg.name") == F.col("v_name")) & ((F.col("v_scope") == F.col("caller")) | (F.col("v_scope") == C.file_of(F.col("from_node")))))
    nearest = near.groupBy("id", "to_node", "location", "code", F.col("param"), F.col("arg")).agg(F.max_by("source", F.struct(F.length("v_scope"), "source")).alias("source"))
    label = F.coalesce("arg.kw", F.col("arg.index").cast("string"))
    meta = F.to_json(F.struct(F.col("arg.index").alias("arg_index"), F.col("arg.kind").alias("arg_kind"), F.col("id").alias("call_edge")))
    return nearest.select(F.concat("id", F.lit("_pf_"), label).alias("id"), F.lit("param-flow").alias("edge_type"), F.col("source").alias("from_node"), F.col("param").alias("to_node"), "location", "code", meta.alias("metadata"), F.col("param").alias("raw_to_node"))


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges after imports, then calls, then parameter flow; ``raw_to_node`` keeps what the source said."""
    imported = apply_resolution(edges, resolve_imports(nodes, edges))
    called = apply_resolution(imported, resolve_calls(nodes, imported))
    return called.unionByName(param_flow(nodes, called))
