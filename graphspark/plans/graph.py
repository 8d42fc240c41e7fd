"""Queries over a graph of code symbols, as plans over its node and edge tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions import columns as C
from graphspark.operators import traverse
from graphspark.schema import EXTERNAL

#: Edges by which a symbol of a kind appears elsewhere; a class appears by all.
APPEARS_BY = {"Function": ("calls", "imports"), "Variable": ("reads", "writes", "assigns", "param-flow")}
#: Edges along which a change of a symbol spreads.
SPREADS_BY = {"Variable": ("reads", "assigns", "writes", "param-flow")}
SPREADS_OTHERWISE = ("calls", "param-flow")
USES = ("calls", "reads", "imports", "decorates", "param-flow")
#: Names that start a program and are alive without a caller.
ENTRY_POINTS = ("main", "serve", "run", "init", "start", "handler")
API_PATH = r"""(?U)["'`](/api/[\w/{}\-]+)["'`]"""
EXPORTED_EDGES = ("calls", "reads", "imports", "defines")
KIND_ORDER = ("Function", "Class", "Variable", "External", "File")


class CodeGraph:
    """``nodes`` and ``edges`` need the columns of ``schema.NODE`` and ``schema.EDGE`` that a query reads, no more."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, transforms: DataFrame | None = None, files: DataFrame | None = None):
        self.nodes, self.edges, self.transforms, self.files = nodes, edges, transforms, files
        #: Edges without their own id, for joins in which ``id`` is a node's.
        self._edges = edges.drop("id")

    # Symbols

    def matching(self, symbol: str, *, scope: str | None = None, fuzzy: bool = False) -> DataFrame:
        """Nodes by exact name, in a scope if one is given; fuzzy takes every name that contains the text."""
        if fuzzy:
            return self.nodes.where(C.contains_folded(F.col("name"), symbol))
        found = self.nodes.where(F.col("name") == symbol)
        return found if scope is None else found.where(F.col("scope") == scope)

    def appearances(self, nodes: DataFrame) -> DataFrame:
        """``(id, code, at, scope)``: the definition of each node and where other code uses it, by the node's kind."""
        own = nodes.select("id", "kind", "name", "location", "scope")
        defined = self.edges.where("edge_type = 'defines'").groupBy(F.col("to_node").alias("id")).agg(F.min("code").alias("defined_by"))
        head = F.when(F.col("kind") == "Function", F.concat(F.lit("def "), "name")).when(F.col("kind") == "Class", F.concat(F.lit("class "), "name")).otherwise(F.col("name"))
        definitions = own.join(defined, "id", "left").select("id", F.coalesce("defined_by", head).alias("code"), F.col("location").alias("at"), "scope", F.lit(0).alias("rank"))
        shown = (F.col("kind") == "Class") | self._edge_fits(APPEARS_BY)
        used = self._edges.join(own.select("id", "kind"), F.col("to_node") == F.col("id")).where(shown).select("id", "code", F.col("location").alias("at"), C.scope_of(F.col("from_node")).alias("scope"), F.lit(1).alias("rank"))
        first = Window.partitionBy("id", "code", "at").orderBy("rank", "scope")
        return definitions.unionByName(used).withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "code", "at", "scope")

    @staticmethod
    def _edge_fits(kinds: dict[str, tuple[str, ...]]) -> Column:
        out = F.lit(False)
        for kind, types in kinds.items():
            out = out | ((F.col("kind") == kind) & F.col("edge_type").isin(*types))
        return out

    def reverse_appearances(self, nodes: DataFrame) -> DataFrame:
        """``(id, code, at, scope)`` of all edges into each node."""
        into = self._edges.join(nodes.select("id"), F.col("to_node") == F.col("id"))
        return into.groupBy("id", "code", F.col("location").alias("at")).agg(F.min(C.scope_of(F.col("from_node"))).alias("scope"))

    def trace(self, symbol: str, *, reverse: bool = False, fuzzy: bool = False, scope: str | None = None, roles: str | None = None, limit: int | None = None) -> DataFrame:
        """``(code, at, scope, role)`` of a symbol; with a leading dot only variables count as the attribute."""
        found = self.matching(symbol.removeprefix("."), scope=scope, fuzzy=fuzzy)
        if symbol.startswith("."):
            found = found.where("kind = 'Variable'")
        shown = self.reverse_appearances(found) if reverse else self.appearances(found)
        out = shown.select("code", "at", "scope").distinct().withColumn("role", C.role(F.col("code")))
        if roles:
            out = out.where(F.col("role").isin(*[r.strip() for r in roles.split(",")]))
        return out if limit is None else out.orderBy(C.location_order(F.col("at")), "code", "scope").limit(limit)

    def trace_layers(self, symbol: str, depth: int, *, scope: str | None = None) -> DataFrame:
        """``(depth, code, at, scope)``: appearances of what layer after layer of edges, of any type and direction, leads to.

        A layer lists the neighbours of the nodes that the layer before found anew.
        """
        arcs = self._both_ways(self.edges)
        levels = traverse.bfs_levels(self.matching(symbol, scope=scope).select("id"), arcs, depth - 2) if depth >= 2 else None
        if levels is None:
            return self.trace(symbol, scope=scope).select(F.lit(1).alias("depth"), "code", "at", "scope").limit(0)
        met = levels.join(arcs, levels["id"] == arcs["src"]).select((F.col("depth") + 2).alias("depth"), F.col("dst").alias("id")).distinct()
        shown = met.join(self.appearances(self.nodes.join(met.select("id").distinct(), "id", "left_semi")), "id")
        return shown.groupBy("depth", "code", "at").agg(F.min("scope").alias("scope"))

    @staticmethod
    def _both_ways(edges: DataFrame) -> DataFrame:
        there = edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
        return there.union(there.select("dst", "src")).distinct()

    # Details

    def params(self, functions: DataFrame) -> DataFrame:
        """``(id, position, name, type_annotation, location)``: parameters by line and column, from 0."""
        inside = functions.select("id", C.inner_scope(F.col("id")).alias("_scope"))
        found = self.nodes.where("kind = 'Variable' AND is_param = 1").select(F.col("id").alias("_param"), "name", "type_annotation", "location", F.col("scope").alias("_scope")).join(inside, "_scope")
        place = Window.partitionBy("id").orderBy(C.location_line(F.col("location")), C.location_col(F.col("location")), "_param")
        return found.select("id", (F.row_number().over(place) - 1).cast("long").alias("position"), "name", "type_annotation", "location")

    def returns(self, functions: DataFrame) -> DataFrame:
        """``(id, name, at)`` of what functions return."""
        edges = self._edges.where("edge_type = 'returns'").join(functions.select("id"), F.col("from_node") == F.col("id"))
        return edges.join(self.nodes.select(F.col("id").alias("_to"), "name"), F.col("to_node") == F.col("_to")).select("id", "name", F.col("location").alias("at"))

    def decorators(self, functions: DataFrame) -> DataFrame:
        """``(id, decorator)``; edges with malformed metadata are passed over."""
        edges = self._edges.where("edge_type = 'decorates'").join(functions.select("id"), F.col("from_node") == F.col("id"))
        return edges.select("id", C.metadata(F.col("metadata"))["decorator"].alias("decorator")).where("decorator IS NOT NULL")

    def members(self, classes: DataFrame, kind: str) -> DataFrame:
        """``(id, name, type_annotation, location)`` of methods (``Function``) or fields (``Variable``) of classes."""
        inside = classes.select("id", C.inner_scope(F.col("id")).alias("_scope"))
        return self.nodes.where(F.col("kind") == kind).select("name", "type_annotation", "location", F.col("scope").alias("_scope")).join(inside, "_scope").select("id", "name", "type_annotation", "location")

    def ambiguous(self, symbol: str) -> DataFrame:
        """Matches of a name in the order functions, classes, variables, externals, files, others; none if there is one at most."""
        order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER))).cast("long")
        found = self.matching(symbol)
        several = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
        return found.join(several, "name", "left_semi").select("id", "kind", "location", "scope", order.alias("kind_order"))

    def info(self, symbol: str, scope: str | None = None) -> DataFrame:
        """One row for each match, with parameters, returns, decorators, methods and fields as sorted lists."""
        found = self.matching(symbol, scope=scope)
        listed = lambda df, column: df.groupBy("id").agg(F.array_sort(F.collect_list(column)))
        parts = {"params": listed(self.params(found), F.struct("position", "name", "type_annotation")), "returns": listed(self.returns(found), F.struct("at", "name")), "decorators": listed(self.decorators(found), "decorator"), "methods": listed(self.members(found, "Function"), F.struct("location", "name")), "fields": listed(self.members(found, "Variable"), F.struct("location", "name", "type_annotation"))}
        out = found
        for name, df in parts.items():
            out = out.join(df.toDF("id", name), "id", "left")
        return out

    # Places and text

    def at_nodes(self, file: str, line: int) -> DataFrame:
        return self._at(self.nodes, file, line).select("id", "kind", "name", "scope", "location")

    def at_edges(self, file: str, line: int) -> DataFrame:
        return self._at(self.edges, file, line).select("edge_type", "from_node", "to_node", "location", "code")

    @staticmethod
    def _at(df: DataFrame, file: str, line: int) -> DataFrame:
        return df.where(F.col("location").startswith(f"{file}:{line}:") & (C.location_file(F.col("location")) == file))

    def at(self, target: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of ``file:line`` or ``file:line:col``; the column is not looked at."""
        file, line = parse_place(target)
        return self.at_nodes(file, line), self.at_edges(file, line)

    def search(self, text: str, *, file_filter: str | None = None, limit: int | None = None) -> DataFrame:
        """``(at, code, scope, match_type, total)``: one row for each place whose code or symbol name contains the text.

        Case of ASCII letters is ignored, no character is a wildcard; an edge's code comes before a symbol's name, and
        ``total`` counts all places, whatever the limit.
        """
        in_code = self.edges.where(C.contains_folded(F.col("code"), text)).select(F.col("location").alias("at"), "code", C.scope_of(F.col("from_node")).alias("scope"), F.lit("code").alias("match_type"))
        in_name = self.nodes.where(C.contains_folded(F.col("name"), text)).select(F.col("location").alias("at"), F.col("name").alias("code"), "scope", F.lit("name").alias("match_type"))
        found = in_code.unionByName(in_name)
        if file_filter:
            found = found.where(F.col("at").startswith(file_filter))
        best = found.groupBy("at").agg(F.min(F.struct("match_type", "code", "scope")).alias("x")).select("at", "x.code", "x.scope", "x.match_type")
        if limit is None:
            return best
        total = best.agg(F.count(F.lit(1)).alias("total"))
        return best.orderBy(C.location_order(F.col("at"))).limit(limit).join(F.broadcast(total))

    # Files

    def file_defines(self, path: str) -> DataFrame:
        """``(symbol, kind, at)``: top-level symbols but for those that an assignment of the file node names."""
        top = self.nodes.where(F.col("id").startswith(f"{path}#") & (F.col("id") != f"{path}#") & F.col("kind").isin("Function", "Class", "Variable") & F.col("scope").isin("", path))
        named = self.edges.where((F.col("edge_type") == "assigns") & (F.col("from_node") == f"{path}#")).select(F.col("to_node").alias("id"))
        return top.join(named, "id", "left_anti").select(F.col("name").alias("symbol"), "kind", F.col("location").alias("at"))

    def file_imports(self, path: str) -> DataFrame:
        edges = self._edges.where((F.col("edge_type") == "imports") & (F.col("from_node") == f"{path}#"))
        return edges.join(self.nodes.select("id", "name"), F.col("to_node") == F.col("id")).select(F.col("name").alias("symbol"), F.col("location").alias("at"))

    def file_imported_by(self, path: str) -> DataFrame:
        """``(file, code)``: import statements that reach symbols of the file, directly or by module name."""
        module = re.sub(r"\.py$", "", path.replace("/", "."))
        stem = path.rsplit("/", 1)[-1].replace(".py", "")
        importer, to = C.file_of(F.col("from_node")), F.col("to_node")
        direct = to.startswith(f"{path}#") | to.startswith(f"{EXTERNAL}{module}")
        loose = to.startswith(EXTERNAL) & F.contains(F.substr(to, F.lit(len(EXTERNAL) + 1)), F.lit(stem)) & (importer != path)
        return self.edges.where((F.col("edge_type") == "imports") & (direct | loose)).select(importer.alias("file"), "code").distinct()

    # Dead code

    def dead(self, scope: str | None = None) -> DataFrame:
        """``(id, kind, name, location, scope, confidence, is_test)`` of top-level functions and classes that nothing uses."""
        used = self.edges.where(F.col("edge_type").isin(*USES)).select(F.col("to_node").alias("id"))
        defining = self.edges.where("edge_type = 'defines'").select(F.col("from_node").alias("id"), F.lit("Class").alias("kind"))
        decorated = self.edges.where("edge_type = 'decorates'").select(F.col("from_node").alias("id"))
        top = self.nodes.where(F.col("kind").isin("Function", "Class") & ~F.contains("scope", F.lit(":")) & ~F.col("name").isin(*ENTRY_POINTS))
        if scope is not None:
            top = top.where(F.col("scope") == scope)
        dead = top.join(used.union(decorated), "id", "left_anti").join(defining, ["id", "kind"], "left_anti")
        file, name = F.substring_index("location", ":", 1), F.col("name")
        is_test = C.is_test_file(file) | C.is_test_name(name)
        dead = dead.withColumn("file", file).join(self._imported_modules(), "file", "left")
        confidence = (
            F.when(is_test, "low").when(name.startswith("_"), "medium").when(file.endswith(".go") & F.substring(name, 1, 1).rlike(r"^\p{Lu}"), "medium")
            .when(file.endswith(".py") & F.coalesce("imported", F.lit(False)), "medium").otherwise("high")
        )
        return dead.select("id", "kind", "name", "location", "scope", confidence.alias("confidence"), is_test.alias("is_test"))

    def _imported_modules(self) -> DataFrame:
        """``(file, imported)`` of Python files that an import of another file names, by path or by ``module.symbol``."""
        files = self.nodes.where("kind = 'File'").select(C.file_of(F.col("id")).alias("file")).where(F.col("file").endswith(".py")).distinct()
        targets = self.edges.where("edge_type = 'imports'").select("from_node", "to_node").distinct()
        # The text after the last slash of what an import names must end as the path does; then the whole path is compared.
        by_path = targets.withColumn("last", F.substring_index("to_node", "/", -1)).join(files.select("file", F.substring_index("file", "/", -1).alias("last")), "last").where(F.col("to_node").endswith(F.col("file")))
        first = F.regexp_extract("to_node", r"^#external:([^.]+)\..", 1)
        by_module = targets.withColumn("stem", first).where("stem <> ''").join(files.select("file", C.stem_of(F.col("file")).alias("stem")), "stem")
        both = by_path.select("file", "from_node").union(by_module.select("file", "from_node"))
        return both.where(F.col("from_node") != F.concat("file", F.lit("#"))).select("file", F.lit(True).alias("imported")).distinct()

    def dead_chains(self) -> DataFrame:
        """``(id, depth)``: dead symbols (depth 0) and what only dead symbols use."""
        candidates = self.nodes.where(F.col("kind").isin("Function", "Class") & ~F.col("name").isin(*ENTRY_POINTS)).select("id")
        uses = self.edges.where(F.col("edge_type").isin(*USES)).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
        return traverse.dead_fixpoint(candidates, self.dead().select("id"), uses)

    # Impact

    def spreading(self) -> DataFrame:
        """Edges along which changes spread, as ``(src, dst, code, at, scope, forward)``, from both of their ends."""
        kinds = self.nodes.select(F.col("id").alias("src"), F.col("kind"))
        there = self.edges.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), "edge_type", "code", F.col("location").alias("at"), C.scope_of(F.col("from_node")).alias("scope"), F.lit(True).alias("forward"))
        back = self.edges.select(F.col("to_node").alias("src"), F.col("from_node").alias("dst"), "edge_type", "code", F.col("location").alias("at"), C.scope_of(F.col("from_node")).alias("scope"), F.lit(False).alias("forward"))
        relevant = there.union(back).where(F.col("edge_type").isin(*SPREADS_BY["Variable"], *SPREADS_OTHERWISE) & ~F.col("src").startswith(EXTERNAL)).join(kinds, "src", "left")
        variable = F.coalesce(F.col("kind"), F.lit("")) == "Variable"
        fits = F.when(variable, F.col("edge_type").isin(*SPREADS_BY["Variable"])).otherwise(F.col("edge_type").isin(*SPREADS_OTHERWISE))
        return relevant.where(fits).select("src", "dst", "code", "at", "scope", "forward")

    def impact(self, target: str, *, scope: str | None = None, depth: int = 3) -> DataFrame:
        """``(tier, code, at, scope, depth)``: direct callees and callers of a symbol or place, then what depends on those.

        Each ``(code, at)`` comes once, in the first tier that meets it.
        """
        if ":" in target and not target.startswith("."):
            edges = self.at(target)[1]
            seeds = edges.select(F.explode(F.array("from_node", "to_node")).alias("id")).distinct()
        else:
            seeds = self.matching(target, scope=scope).select("id").distinct()
        arcs = self.spreading()
        levels = traverse.bfs_levels(seeds, arcs.select("src", "dst").distinct(), depth - 1)
        met = levels.join(arcs, levels["id"] == arcs["src"]).withColumn("depth", (F.col("depth") + 1).cast("long"))
        tier = F.when(F.col("depth") > 1, "transitive").when(F.col("forward"), "direct_callees").otherwise("direct_callers")
        rank = F.struct("depth", F.when(F.col("forward"), 0).otherwise(1).alias("way"), "scope", tier.alias("tier"))
        first = met.groupBy("code", "at").agg(F.min(rank).alias("x"))
        return first.select("x.tier", "code", "at", "x.scope", "x.depth")

    # Paths between services

    def api_references(self, path: str | None = None) -> DataFrame:
        """``(path, file, scope, at, code)`` of API paths in code strings; code is cut to 200 characters."""
        rows = self.edges.where(F.contains("code", F.lit("/api/"))).select("code", "location", "from_node").distinct()
        found = rows.select(F.explode(F.regexp_extract_all("code", F.lit(API_PATH), F.lit(1))).alias("path"), "code", F.col("location").alias("at"), "from_node")
        if path is not None:
            found = found.where(F.col("path") == path)
        return found.select("path", C.file_of(F.col("from_node")).alias("file"), C.scope_of(F.col("from_node")).alias("scope"), "at", F.substring("code", 1, 200).alias("code"))

    def api_paths(self) -> DataFrame:
        return self.api_references().groupBy("path").agg(F.count(F.lit(1)).alias("references"))

    # Files that import each other

    def file_arcs(self) -> DataFrame:
        """``(src, dst)``: files by their imports; names of externals lead to the file of their module, if there is one."""
        imports = self.edges.where("edge_type = 'imports'").select(C.file_of(F.col("from_node")).alias("src"), "to_node")
        direct = imports.where(~F.col("to_node").startswith(EXTERNAL)).select("src", C.file_of(F.col("to_node")).alias("dst"))
        files = self.nodes.where("kind = 'File'").select(C.file_of(F.col("id")).alias("dst")).distinct()
        # A file answers to its path without the extension; an import names the path of a module or of a symbol in it.
        named = files.withColumn("module", F.regexp_replace(F.regexp_replace("dst", r"\.(py|js|ts|go)$", ""), "/", "."))
        stems = named.select("dst", F.substring_index("module", ".", -1).alias("stem"), "module")
        outside = imports.where(F.col("to_node").startswith(EXTERNAL)).select("src", F.regexp_replace(F.substr("to_node", F.lit(len(EXTERNAL) + 1)), r"\.(py|js|ts|go)(?=\.|$)", "").alias("name")).distinct()
        asked = outside.select("src", "name", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", r"\.[^.]*$", "")))).alias("wanted"))
        asked = asked.select("src", "name", F.regexp_replace(F.regexp_replace("wanted", r"^[./]+", ""), "/", ".").alias("wanted")).withColumn("stem", F.substring_index("wanted", ".", -1))
        hit = asked.join(stems, "stem").where((F.col("module") == F.col("wanted")) | F.col("module").endswith(F.concat(F.lit("."), "wanted")) | (~F.contains("wanted", F.lit(".")) & (F.col("stem") == F.col("wanted"))))
        exact = (F.col("module") == F.col("wanted")).cast("int")
        best = hit.groupBy("src", "name").agg(F.max_by("dst", F.struct(F.length("wanted"), exact, -F.length("dst"), "dst")).alias("dst"))
        return direct.union(best.select("src", "dst")).where("src <> dst AND dst <> ''").distinct()

    def cycle_components(self) -> DataFrame:
        """``(id, component)`` of files that are part of an import cycle."""
        return traverse.strongly_connected(self.file_arcs())

    def cycles(self, longest: int = 4) -> DataFrame:
        """``(chain, length)`` of the import cycles of up to ``longest`` files, from the least file on."""
        return traverse.simple_cycles(self.file_arcs(), longest)

    # Types in several languages

    def type_definitions(self, name: str | None = None) -> DataFrame:
        """``(name, id, file, language, location, fields)`` of classes defined in several files; fields are sorted names."""
        classes = self.nodes.where("kind = 'Class'") if name is None else self.nodes.where((F.col("kind") == "Class") & (F.col("name") == name))
        classes = classes.select("name", "id", C.file_of(F.col("id")).alias("file"), "location")
        shared = classes.groupBy("name").agg(F.countDistinct("file").alias("n")).where("n > 1").select("name")
        children = self.edges.where("edge_type = 'defines'").select(F.col("from_node").alias("id"), F.col("to_node").alias("child"))
        fields = children.join(self.nodes.select(F.col("id").alias("child"), F.col("name").alias("field")), "child").groupBy("id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
        out = classes.join(shared, "name", "left_semi").join(fields, "id", "left")
        return out.select("name", "id", "file", C.language(F.col("file")).alias("language"), "location", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))

    def type_mismatches(self, name: str | None = None) -> DataFrame:
        """``(name, file, base_file, kind, missing, extra)``: how definitions differ from the first of their name.

        The first is by file and line. ``kind`` is ``same``, ``case`` (equal but for case) or ``fields``.
        """
        defs = self.type_definitions(name)
        first = Window.partitionBy("name").orderBy("file", C.location_line(F.col("location")), "id")
        numbered = defs.withColumn("n", F.row_number().over(first))
        base = numbered.where("n = 1").select("name", F.col("file").alias("base_file"), F.col("fields").alias("base"))
        pairs = numbered.where("n > 1").join(base, "name")
        folded = lambda c: F.array_sort(F.array_distinct(F.transform(c, F.lower)))
        kind = F.when(F.col("fields") == F.col("base"), "same").when(folded("fields") == folded("base"), "case").otherwise("fields")
        joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
        return pairs.select("name", "file", "base_file", kind.alias("kind"), joined("base", "fields").alias("missing"), joined("fields", "base").alias("extra"))

    # Whole graph

    def stats(self) -> DataFrame:
        """``(table, rows)`` of the four tables."""
        tables = {"nodes": self.nodes, "edges": self.edges, "transforms": self.transforms, "files": self.files}
        counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items() if df is not None]
        out = counts[0]
        for c in counts[1:]:
            out = out.union(c)
        return out

    def call_resolution(self) -> DataFrame:
        """``(calls, resolved)``: call edges, and those whose target is not external."""
        return self.edges.where("edge_type = 'calls'").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("to_node").startswith(EXTERNAL)).alias("resolved"))

    def export_nodes(self, include_external: bool = False) -> DataFrame:
        nodes = self.nodes if include_external else self.nodes.where("kind <> 'External'")
        return nodes.select("id", "kind", "name", "scope")

    def export_edges(self) -> DataFrame:
        return self.edges.where(F.col("edge_type").isin(*EXPORTED_EDGES)).select("from_node", "to_node", "edge_type")


def parse_place(target: str) -> tuple[str, int]:
    """``file:line`` or ``file:line:col``; anything else is an error."""
    m = re.fullmatch(r"(.+?):(\d+)(?::\d+)?", target)
    if not m:
        raise ValueError(f"not a place, file:line or file:line:col: {target}")
    return m[1], int(m[2])
