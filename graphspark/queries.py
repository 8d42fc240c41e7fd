"""Queries over the graph of the relational tables, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark import cases
from graphspark.functions import columns as C
from graphspark.operators import export, normalize, resolve, traverse
from graphspark.plans import build
from graphspark.plans.graph import CodeGraph
from graphspark.sources.languages import detect_language
from graphspark.trade import trade_graph, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[CodeGraph], DataFrame]], Callable[[CodeGraph], DataFrame]]:
    def add(f: Callable[[CodeGraph], DataFrame]) -> Callable[[CodeGraph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(trade_graph(spark, sf_dir))
        if sql is not None:
            # ``at`` is a keyword in some dialects, so the column is quoted.
            ORACLES[name] = with_views(re.sub(r"""(?<![\w"'])at(?![\w"'])""", '"at"', sql))
        return f

    return add


# Pieces of SQL that several queries share.
SCOPE = "CASE WHEN strpos({0}, '#') = 0 THEN {0} WHEN strpos({0}, '#') = length({0}) THEN substr({0}, 1, length({0}) - 1) ELSE split_part({0}, '#', 1) || ':' || substr({0}, strpos({0}, '#') + 1) END"
FROM_SCOPE = SCOPE.format("from_node")
LINE = "CAST(regexp_extract(location, ':(\\d+):(\\d+)$', 1) AS BIGINT)"
COL = "CAST(regexp_extract(location, ':(\\d+):(\\d+)$', 2) AS BIGINT)"
ROLE = """CASE WHEN ltrim(code) LIKE 'def %' OR ltrim(code) LIKE 'class %' OR ltrim(code) LIKE 'type %' OR ltrim(code) LIKE 'func %' THEN 'definition'
  WHEN ltrim(code) LIKE 'from %' OR ltrim(code) LIKE 'import %' THEN 'import'
  WHEN strpos(code, '(') > 0 AND strpos(split_part(code, '(', 1), '=') = 0 THEN 'call' ELSE 'reference' END"""


def appearances_sql(where: str) -> str:
    """Appearances of the nodes for which ``where`` holds, as the table ``apps`` (id, code, at, scope)."""
    return f""", wanted AS (SELECT * FROM tg_nodes WHERE {where}),
found AS (
  SELECT w.id, coalesce((SELECT min(e.code) FROM tg_edges e WHERE e.edge_type = 'defines' AND e.to_node = w.id), CASE w.kind WHEN 'Function' THEN 'def ' || w.name WHEN 'Class' THEN 'class ' || w.name ELSE w.name END) AS code, w.location AS at, w.scope, 0 AS rank FROM wanted w
  UNION ALL
  SELECT w.id, e.code, e.location, {SCOPE.format('e.from_node')}, 1 FROM wanted w JOIN tg_edges e ON e.to_node = w.id
  WHERE w.kind = 'Class' OR (w.kind = 'Function' AND e.edge_type IN ('calls', 'imports')) OR (w.kind = 'Variable' AND e.edge_type IN ('reads', 'writes', 'assigns', 'param-flow'))),
apps AS (SELECT id, code, at, scope FROM (SELECT *, row_number() OVER (PARTITION BY id, code, at ORDER BY rank, scope) AS n FROM found) WHERE n = 1)
"""


def trace_sql(where: str, more: str = "") -> str:
    # A CTE list that goes on after the views: with_views puts a line end between, the leading comma joins both.
    return appearances_sql(where) + f"SELECT * FROM (SELECT DISTINCT code, at, scope, {ROLE} AS role FROM apps) {more}"


# Stats


@query("stats_counts", """SELECT 'nodes' AS "table", count(*) AS "rows" FROM tg_nodes UNION ALL SELECT 'edges', count(*) FROM tg_edges UNION ALL SELECT 'transforms', 0 UNION ALL SELECT 'files', count(*) FROM tg_nodes WHERE kind = 'File'""")
def _(g: CodeGraph) -> DataFrame:
    return g.stats()


@query("stats_by_kind", "SELECT kind, count(*) AS n, CAST(sum(is_param) AS BIGINT) AS params FROM tg_nodes GROUP BY kind")
def _(g: CodeGraph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("is_param").cast("long").alias("params"))


@query("edge_type_rollup", "SELECT edge_type, split_part(location, '/', 1) AS region, count(*) AS n FROM tg_edges GROUP BY ROLLUP (edge_type, split_part(location, '/', 1))")
def _(g: CodeGraph) -> DataFrame:
    return g.edges.withColumn("region", F.substring_index("location", "/", 1)).rollup("edge_type", "region").agg(F.count(F.lit(1)).alias("n"))


@query("call_resolution", "SELECT count(*) AS calls, count(*) FILTER (to_node NOT LIKE '#external:%') AS resolved FROM tg_edges WHERE edge_type = 'calls'")
def _(g: CodeGraph) -> DataFrame:
    return g.call_resolution()


# Normalising and resolving


def _raw_nodes(g: CodeGraph) -> DataFrame:
    """Every node twice, the second time later, without annotation and as a parameter: what two extractions would give."""
    own = g.nodes.select("id", "kind", "name", "location", "scope", "type_annotation", "is_param")
    again = own.withColumns({"location": F.regexp_replace("location", r":(\d+):(\d+)$", ":9:0"), "type_annotation": F.lit(""), "is_param": F.lit(1)}).where("kind = 'Variable'")
    return own.withColumn("seq", F.lit(1)).union(again.select(*own.columns).withColumn("seq", F.lit(2)))


@query("node_merge", f"""SELECT id, kind, name, scope, type_annotation, CASE WHEN kind = 'Variable' THEN 1 ELSE is_param END AS is_param,
  CASE WHEN kind = 'Variable' AND ({LINE} > 9 OR ({LINE} = 9 AND {COL} > 0)) THEN regexp_replace(location, ':(\\d+):(\\d+)$', ':9:0') ELSE location END AS location FROM tg_nodes""")
def _(g: CodeGraph) -> DataFrame:
    return normalize.merge_nodes(_raw_nodes(g))


@query("edge_dedupe", "SELECT from_node, to_node, edge_type, location, min(id) AS id, max(metadata) AS metadata FROM tg_edges GROUP BY from_node, to_node, edge_type, location")
def _(g: CodeGraph) -> DataFrame:
    own = g.edges.select("id", "edge_type", "from_node", "to_node", "location", "metadata")
    again = own.withColumns({"id": F.concat("id", F.lit("~")), "metadata": F.lit("{}")})
    place = lambda n: F.struct(F.lit(n).alias("n"), "id")
    return normalize.dedupe_edges(own.withColumn("seq", place(1)).union(again.withColumn("seq", place(2)))).drop("seq")


@query("transform_dedupe", """SELECT edge_type AS op, split_part(location, ':', 1) AS location, array_to_string(list_sort(list(DISTINCT to_node)), ',') AS inputs, min(id) AS id FROM tg_edges WHERE edge_type IN ('calls', 'assigns') GROUP BY ALL""")
def _(g: CodeGraph) -> DataFrame:
    raw = g.edges.where("edge_type IN ('calls', 'assigns')").select(F.col("edge_type").alias("op"), F.substring_index("location", ":", 1).alias("location"), F.array("to_node").alias("inputs"), F.array().cast("array<string>").alias("outputs"), "id", F.col("id").alias("seq"))
    return normalize.dedupe_transforms(raw).select("op", "location", F.array_join("inputs", ",").alias("inputs"), "id")


@query("fill_externals", "SELECT raw_to_node AS id, 'External' AS kind, substr(raw_to_node, 11) AS name, count(*) AS uses FROM tg_edges WHERE raw_to_node LIKE '#external:%' AND raw_to_node NOT IN (SELECT id FROM tg_nodes) GROUP BY raw_to_node")
def _(g: CodeGraph) -> DataFrame:
    raw = g.edges.withColumn("to_node", F.col("raw_to_node"))
    new = normalize.missing_externals(g.nodes, raw).select("id", "kind", "name")
    return new.join(raw.groupBy(F.col("to_node").alias("id")).agg(F.count(F.lit(1)).alias("uses")), "id")


@query("scope_index", "SELECT scope, name, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM tg_nodes GROUP BY scope, name")
def _(g: CodeGraph) -> DataFrame:
    return normalize.scope_index(g.nodes).withColumn("ids", F.array_join("ids", ","))


@query("scope_parents", """SELECT DISTINCT scope, CASE WHEN strpos(scope, ':') > 0 THEN regexp_extract(scope, '^(.*)[.:][^.:]*$', 1) END AS parent FROM tg_nodes WHERE scope <> ''""")
def _(g: CodeGraph) -> DataFrame:
    return normalize.scope_parents(g.nodes)


def _raw_edges(g: CodeGraph) -> DataFrame:
    """Edges as the sources have them before any resolving: imports of modules without file endings, and calls by bare
    name, through ``this``, a class, any object, or a chain, by the line item that the call comes from. Imports of Python
    files lead to their symbols already, so that calls there fall to the rules behind that of imported modules."""
    line, supplier = F.split("id", "_")[1].cast("int") % 6, F.split("id", "_")[3].cast("int")
    method = F.concat(F.lit("fn_"), (supplier % 50).cast("string"))
    through = F.when(line == 1, F.concat(F.lit("this."), method)).when(line == 2, F.concat(F.lit("BUILDING."), method)).when(line == 3, F.concat(F.lit("svc."), method))
    said = F.concat(F.lit("#external:"), through.when(line == 4, F.concat(F.lit("a.svc."), F.substring("raw_to_node", 11, 100))).otherwise(F.substring("raw_to_node", 11, 100)))
    raw = F.when(F.col("edge_type") == "calls", said).when(F.col("edge_type") == "imports", F.regexp_replace("raw_to_node", r"\.(py|go|ts|js)\.", ".")).otherwise(F.col("raw_to_node"))
    return g.edges.withColumn("raw_to_node", raw).withColumn("to_node", F.when((F.col("edge_type") == "calls") | ((F.col("edge_type") == "imports") & ~C.file_of(F.col("from_node")).endswith(".py")), F.col("raw_to_node")).otherwise(F.col("to_node")))


RAW = r""", syms AS (SELECT id AS target, kind, name, scope AS t_scope, split_part(id, '#', 1) AS t_file FROM tg_nodes WHERE kind IN ('Function', 'Class')),
imps AS MATERIALIZED (SELECT id, split_part(from_node, '#', 1) AS file, substr(regexp_replace(raw_to_node, '\.(py|go|ts|js)\.', '.'), 11) AS imported FROM tg_edges WHERE edge_type = 'imports' AND raw_to_node LIKE '#external:%'),
asked AS (SELECT id, file, split_part(imported, '.', -1) AS name, regexp_extract(imported, '^(.*)\.[^.]*$', 1) AS module FROM imps),
found AS MATERIALIZED (SELECT a.id, min(s.target) AS target FROM asked a JOIN syms s ON s.name = a.name
  WHERE a.module = '' OR regexp_replace(split_part(s.t_file, '/', -1), '\.[^.]*$', '') = split_part(a.module, '.', -1) OR strpos(s.t_file, replace(a.module, '.', '/')) > 0 GROUP BY a.id)
"""


@query("import_resolve", RAW + "SELECT id, target FROM found")
def _(g: CodeGraph) -> DataFrame:
    return resolve.resolve_imports(g.nodes, _raw_edges(g))


@query("call_resolve_ranked", RAW + r""", lines AS (SELECT id, split_part(from_node, '#', 1) AS file, split_part(from_node, '#', 2) AS caller, substr(raw_to_node, 11) AS bare, 'fn_' || (CAST(split_part(id, '_', 4) AS INTEGER) % 50) AS method, CAST(split_part(id, '_', 2) AS INTEGER) % 6 AS line FROM tg_edges WHERE edge_type = 'calls'),
said AS (SELECT id, file, caller, CASE line WHEN 1 THEN 'this.' || method WHEN 2 THEN 'BUILDING.' || method WHEN 3 THEN 'svc.' || method WHEN 4 THEN 'a.svc.' || bare ELSE bare END AS full_name FROM lines),
calls AS MATERIALIZED (SELECT id, file, split_part(full_name, '.', -1) AS name, regexp_extract(full_name, '^(.*)\.[^.]*$', 1) AS owner, regexp_extract(caller, '^(.*)\.[^.]*$', 1) AS around FROM said),
stems AS (SELECT DISTINCT file, regexp_replace(split_part(replace(regexp_replace(module, '\.(js|ts|py|go)$', ''), '/', '.'), '.', -1), '', '') AS stem FROM (SELECT file, unnest([imported, regexp_replace(imported, '\.[^.]*$', '')]) AS module FROM imps WHERE file NOT LIKE '%.py')),
pairs AS (SELECT c.*, s.*, c.file = s.t_file AS own, strpos(s.t_scope, ':') = 0 AS top,
  CASE WHEN c.file LIKE '%.py' THEN 'py' WHEN c.file LIKE '%.go' THEN 'go' ELSE 'js' END = CASE WHEN s.t_file LIKE '%.py' THEN 'py' WHEN s.t_file LIKE '%.go' THEN 'go' ELSE 'js' END AS related,
  regexp_extract(c.file, '^(.*)/[^/]*$', 1) = regexp_extract(s.t_file, '^(.*)/[^/]*$', 1) AND c.file LIKE '%.go' AND s.t_file LIKE '%.go' AS go_dir FROM calls c JOIN syms s ON s.name = c.name),
props AS (
  SELECT id, target, 0 AS "rank", 0 AS pref FROM pairs WHERE kind = 'Function' AND owner = 'this' AND t_scope = file || ':' || around
  UNION ALL SELECT id, target, 1, 0 FROM pairs WHERE kind = 'Function' AND owner NOT IN ('', 'this') AND t_scope = file || ':' || owner
  UNION ALL SELECT p.id, p.target, 2, CASE WHEN stem = split_part(owner, '.', -1) THEN 0 ELSE 1 END FROM pairs p JOIN stems m ON m.file = p.file AND m.stem = regexp_replace(split_part(p.t_file, '/', -1), '\.[^.]*$', '') WHERE kind = 'Function' AND owner <> '' AND NOT own
  UNION ALL SELECT id, target, 3, 0 FROM pairs WHERE kind = 'Function' AND owner <> '' AND around <> '' AND (t_scope = file || ':' || around OR (NOT top AND starts_with(file || ':' || around, t_scope || '.')))
  UNION ALL SELECT id, target, 4, 0 FROM pairs WHERE kind = 'Function' AND owner <> '' AND own AND top
  UNION ALL SELECT id, target, 5, 0 FROM pairs WHERE kind = 'Function' AND strpos(owner, '.') > 0 AND t_scope = file || ':' || around
  UNION ALL SELECT id, target, 6, CASE WHEN own THEN 1 ELSE 0 END FROM pairs WHERE kind = 'Function' AND owner <> '' AND top AND related
  UNION ALL SELECT id, target, 7, CASE WHEN own THEN 1 ELSE 0 END FROM pairs WHERE kind = 'Function' AND owner <> '' AND NOT top AND related
  UNION ALL SELECT id, target, 8, CASE WHEN own THEN 0 ELSE 1 END FROM pairs WHERE owner = '' AND (own OR go_dir)
  UNION ALL SELECT c.id, f.target, 9, 0 FROM calls c JOIN asked a ON a.file = c.file AND a.name = c.name JOIN found f ON f.id = a.id JOIN syms s ON s.target = f.target AND s.kind = 'Function')
SELECT id, target, "rank" FROM (SELECT id, target, "rank", row_number() OVER (PARTITION BY id ORDER BY "rank", pref, target) AS n FROM props) WHERE n = 1""")
def _(g: CodeGraph) -> DataFrame:
    return resolve.resolve_calls(g.nodes, _raw_edges(g))


@query("method_anywhere", """SELECT e.id, count(DISTINCT n.id) AS homonyms, min(CASE WHEN split_part(n.id, '#', 1) <> split_part(e.from_node, '#', 1) THEN n.id END) AS elsewhere
FROM tg_edges e JOIN tg_nodes n ON n.kind = 'Function' AND n.name = substr(e.raw_to_node, 11) AND n.scope NOT LIKE '%:%' WHERE e.edge_type = 'calls' GROUP BY e.id""")
def _(g: CodeGraph) -> DataFrame:
    return resolve.homonyms(g.nodes, g.edges)


@query("param_order", f"""SELECT f.id AS function, CAST(row_number() OVER (PARTITION BY f.id ORDER BY {LINE.replace('location', 'v.location')}, {COL.replace('location', 'v.location')}, v.id) - 1 AS BIGINT) AS position, v.id AS param, v.name
FROM tg_nodes f JOIN tg_nodes v ON f.kind = 'Function' AND v.kind = 'Variable' AND v.is_param = 1 AND v.scope = replace(f.id, '#', ':')""")
def _(g: CodeGraph) -> DataFrame:
    return resolve.function_params(g.nodes).withColumn("position", F.col("position").cast("long"))


@query("param_flow", """SELECT e.id || '_pf_0' AS id, v.id AS from_node, e.to_node || '.lot' AS to_node, e.location, e.code
FROM tg_edges e JOIN tg_nodes v ON v.kind = 'Variable' AND v.scope = replace(e.from_node, '#', ':') AND v.name = regexp_extract(e.metadata, '"name":"([^"]*)"', 1) WHERE e.edge_type = 'calls' AND e.metadata LIKE '%args%'""")
def _(g: CodeGraph) -> DataFrame:
    return resolve.param_flow(g.nodes, g.edges).select("id", "from_node", "to_node", "location", "code")


@query("resolved_edges", """SELECT edge_type, count(*) AS n, count(*) FILTER (to_node LIKE '#external:%') AS external FROM (SELECT edge_type, to_node FROM tg_edges UNION ALL
SELECT 'param-flow', e.to_node || '.lot' FROM tg_edges e JOIN tg_nodes v ON v.kind = 'Variable' AND v.scope = replace(e.from_node, '#', ':') AND v.name = regexp_extract(e.metadata, '"name":"([^"]*)"', 1) WHERE e.edge_type = 'calls' AND e.metadata LIKE '%args%') GROUP BY edge_type""")
def _(g: CodeGraph) -> DataFrame:
    return g.edges.select("edge_type", "to_node").union(resolve.param_flow(g.nodes, g.edges).select("edge_type", "to_node")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("to_node").startswith("#external:")).alias("external"))


# Trace


@query("trace_exact", trace_sql("name = 'supply_7'"))
def _(g: CodeGraph) -> DataFrame:
    return g.trace("supply_7")


@query("trace_fuzzy", trace_sql("name LIKE '%ply\\_1%' ESCAPE '\\'"))
def _(g: CodeGraph) -> DataFrame:
    return g.trace("ply_1", fuzzy=True)


@query("trace_scope", trace_sql("name = 'main' AND scope = (SELECT min(scope) FROM tg_nodes WHERE name = 'main')"))
def _(g: CodeGraph) -> DataFrame:
    return g.trace("main", scope=g.matching("main").agg(F.min("scope").alias("least")).first()["least"])


@query("trace_role", trace_sql("name LIKE '%supply%'", "WHERE role IN ('call', 'import')"))
def _(g: CodeGraph) -> DataFrame:
    return g.trace("supply", fuzzy=True, roles="call, import")


@query("trace_attr", trace_sql("kind = 'Variable' AND name = 'lot'"))
def _(g: CodeGraph) -> DataFrame:
    return g.trace(".lot")


@query("trace_reverse", f"SELECT DISTINCT code, at, scope, {ROLE} AS role FROM (SELECT n.id, e.code, e.location AS at, min({SCOPE.format('e.from_node')}) AS scope FROM tg_edges e JOIN tg_nodes n ON n.id = e.to_node AND n.name = 'supply_3' GROUP BY n.id, e.code, e.location)")
def _(g: CodeGraph) -> DataFrame:
    return g.trace("supply_3", reverse=True)


@query("trace_depth2", """, both_ways AS (SELECT from_node AS src, to_node AS dst FROM tg_edges UNION SELECT to_node, from_node FROM tg_edges),
near AS (SELECT DISTINCT dst FROM both_ways WHERE src IN (SELECT id FROM tg_nodes WHERE name = 'supply_9'))""" + appearances_sql("id IN (SELECT dst FROM near)") + "SELECT CAST(2 AS INTEGER) AS depth, code, at, min(scope) AS scope FROM apps GROUP BY code, at")
def _(g: CodeGraph) -> DataFrame:
    return g.trace_layers("supply_9", 2)


# Details


@query("info_function", """SELECT n.id, n.kind, n.scope, (SELECT count(*) FROM tg_nodes v WHERE v.kind = 'Variable' AND v.is_param = 1 AND v.scope = replace(n.id, '#', ':')) AS params, (SELECT count(*) FROM tg_edges e WHERE e.edge_type = 'returns' AND e.from_node = n.id) AS "returns"
FROM tg_nodes n WHERE n.name = 'fn_8'""")
def _(g: CodeGraph) -> DataFrame:
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long").alias(c)
    return g.info("fn_8").select("id", "kind", "scope", size("params"), size("returns"))


@query("info_class", """SELECT n.id, (SELECT count(*) FROM tg_nodes v WHERE v.kind = 'Function' AND v.scope = replace(n.id, '#', ':')) AS methods, (SELECT count(*) FROM tg_nodes v WHERE v.kind = 'Variable' AND v.scope = replace(n.id, '#', ':')) AS fields
FROM tg_nodes n WHERE n.name = 'BUILDING'""")
def _(g: CodeGraph) -> DataFrame:
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long").alias(c)
    return g.info("BUILDING").select("id", size("methods"), size("fields"))


@query("info_ambiguous", "SELECT id, kind, location, scope, CAST(CASE kind WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 WHEN 'Variable' THEN 2 WHEN 'External' THEN 3 WHEN 'File' THEN 4 ELSE 5 END AS BIGINT) AS kind_order FROM tg_nodes WHERE name = 'main' AND (SELECT count(*) FROM tg_nodes WHERE name = 'main') > 1")
def _(g: CodeGraph) -> DataFrame:
    return g.ambiguous("main")


@query("info_params", f"""SELECT f.id, CAST(row_number() OVER (PARTITION BY f.id ORDER BY {LINE.replace('location', 'v.location')}, {COL.replace('location', 'v.location')}, v.id) - 1 AS BIGINT) AS position, v.name, v.type_annotation, v.location
FROM tg_nodes f JOIN tg_nodes v ON v.kind = 'Variable' AND v.is_param = 1 AND v.scope = replace(f.id, '#', ':') WHERE f.kind = 'Function' AND f.name LIKE 'fn\\_%' ESCAPE '\\'""")
def _(g: CodeGraph) -> DataFrame:
    return g.params(g.nodes.where(F.col("kind").eqNullSafe("Function") & F.col("name").startswith("fn_")))


@query("info_returns", "SELECT e.from_node AS id, n.name, e.location AS at FROM tg_edges e JOIN tg_nodes n ON n.id = e.to_node WHERE e.edge_type = 'returns'")
def _(g: CodeGraph) -> DataFrame:
    return g.returns(g.nodes)


@query("info_decorators", "SELECT from_node AS id, regexp_extract(metadata, '\"decorator\":\"([^\"]*)\"', 1) AS decorator FROM tg_edges WHERE edge_type = 'decorates'")
def _(g: CodeGraph) -> DataFrame:
    return g.decorators(g.nodes)


@query("info_methods", "SELECT c.id, f.name, f.type_annotation, f.location FROM tg_nodes c JOIN tg_nodes f ON f.kind = 'Function' AND f.scope = replace(c.id, '#', ':') WHERE c.kind = 'Class'")
def _(g: CodeGraph) -> DataFrame:
    return g.members(g.nodes.where("kind = 'Class'"), "Function")


@query("info_fields", "SELECT c.id, f.name, f.type_annotation, f.location FROM tg_nodes c JOIN tg_nodes f ON f.kind = 'Variable' AND f.scope = replace(c.id, '#', ':') WHERE c.kind = 'Class'")
def _(g: CodeGraph) -> DataFrame:
    return g.members(g.nodes.where("kind = 'Class'"), "Variable")


# Places and text


@query("at_nodes", "SELECT id, kind, name, scope, location FROM tg_nodes WHERE starts_with(location, 'lib/parts.py:12:')")
def _(g: CodeGraph) -> DataFrame:
    return g.at("lib/parts.py:12")[0]


@query("at_edges", "SELECT edge_type, from_node, to_node, location, code FROM tg_edges WHERE starts_with(location, 'r0/nation_0.py:1:')")
def _(g: CodeGraph) -> DataFrame:
    return g.at("r0/nation_0.py:1:5")[1]


def search_sql(text: str, more: str = "TRUE") -> str:
    return f"""SELECT at, split_part(x, chr(1), 2) AS code, split_part(x, chr(1), 3) AS scope, split_part(x, chr(1), 1) AS match_type FROM (SELECT at, min(match_type || chr(1) || code || chr(1) || scope) AS x FROM (
  SELECT location AS at, code, {FROM_SCOPE} AS scope, 'code' AS match_type FROM tg_edges WHERE contains(translate(code, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{text}')
  UNION ALL SELECT location, name, scope, 'name' FROM tg_nodes WHERE contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{text}')) WHERE {more} GROUP BY at)"""


@query("search_code", search_sql("supply_1("))
def _(g: CodeGraph) -> DataFrame:
    return g.search("Supply_1(")


@query("search_name", search_sql("fn_4"))
def _(g: CodeGraph) -> DataFrame:
    return g.search("fn_4")


@query("search_file_filter", search_sql("supply", "starts_with(at, 'r1/')"))
def _(g: CodeGraph) -> DataFrame:
    return g.search("SUPPLY", file_filter="r1/")


# Files


@query("file_defines", "SELECT name AS symbol, kind, location AS at FROM tg_nodes WHERE starts_with(id, 'r1/nation_1.go#') AND id <> 'r1/nation_1.go#' AND kind IN ('Function', 'Class', 'Variable') AND scope IN ('', 'r1/nation_1.go') AND id NOT IN (SELECT to_node FROM tg_edges WHERE edge_type = 'assigns' AND from_node = 'r1/nation_1.go#')")
def _(g: CodeGraph) -> DataFrame:
    return g.file_defines("r1/nation_1.go")


@query("file_imports", "SELECT n.name AS symbol, e.location AS at FROM tg_edges e JOIN tg_nodes n ON n.id = e.to_node WHERE e.edge_type = 'imports' AND e.from_node = 'r1/nation_1.go#'")
def _(g: CodeGraph) -> DataFrame:
    return g.file_imports("r1/nation_1.go")


@query("file_imported_by", "SELECT DISTINCT split_part(from_node, '#', 1) AS file, code FROM tg_edges WHERE edge_type = 'imports' AND (starts_with(to_node, 'r0/nation_0.py#') OR starts_with(to_node, '#external:r0.nation_0') OR (starts_with(to_node, '#external:') AND contains(substr(to_node, 11), 'nation_0') AND split_part(from_node, '#', 1) <> 'r0/nation_0.py'))")
def _(g: CodeGraph) -> DataFrame:
    return g.file_imported_by("r0/nation_0.py")


# Dead code

DEAD = """SELECT n.id, n.kind, n.name, n.location, n.scope, split_part(n.location, ':', 1) AS file FROM tg_nodes n WHERE n.kind IN ('Function', 'Class') AND strpos(n.scope, ':') = 0 AND n.name NOT IN ('main', 'serve', 'run', 'init', 'start', 'handler')
  AND NOT EXISTS (SELECT 1 FROM tg_edges e WHERE e.to_node = n.id AND e.edge_type IN ('calls', 'reads', 'imports', 'decorates', 'param-flow')) AND NOT EXISTS (SELECT 1 FROM tg_edges e WHERE e.from_node = n.id AND e.edge_type = 'decorates')
  AND NOT (n.kind = 'Class' AND EXISTS (SELECT 1 FROM tg_edges e WHERE e.from_node = n.id AND e.edge_type = 'defines'))"""
TEST = "(starts_with(file, 'test') OR contains(file, '/test') OR file LIKE '%\\_test.go' ESCAPE '\\' OR contains(file, '.test.') OR contains(file, '.spec.') OR starts_with(name, 'test') OR starts_with(name, 'Test') OR name LIKE '%\\_test' ESCAPE '\\' OR name LIKE '%Test')"
CONFIDENCE = f"""CASE WHEN {TEST} THEN 'low' WHEN starts_with(name, '_') THEN 'medium' WHEN file LIKE '%.go' AND regexp_matches(name, '^[A-Z]') THEN 'medium'
  WHEN file LIKE '%.py' AND EXISTS (SELECT 1 FROM tg_edges e WHERE e.edge_type = 'imports' AND e.from_node <> file || '#' AND (ends_with(e.to_node, file) OR (starts_with(e.to_node, '#external:' || replace(split_part(file, '/', -1), '.py', '') || '.') AND length(e.to_node) > length('#external:' || replace(split_part(file, '/', -1), '.py', '') || '.')))) THEN 'medium' ELSE 'high' END"""


@query("dead_symbols", f"SELECT id, kind, name, location, scope, {CONFIDENCE} AS confidence, {TEST} AS is_test FROM ({DEAD})")
def _(g: CodeGraph) -> DataFrame:
    return g.dead()


@query("dead_confidence", f"SELECT confidence, kind, count(*) AS n FROM (SELECT kind, {CONFIDENCE} AS confidence FROM ({DEAD})) GROUP BY confidence, kind")
def _(g: CodeGraph) -> DataFrame:
    return g.dead().groupBy("confidence", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("dead_scope", f"SELECT id, name, {CONFIDENCE} AS confidence FROM ({DEAD}) WHERE scope = 'r1/nation_1.go'")
def _(g: CodeGraph) -> DataFrame:
    return g.dead(scope="r1/nation_1.go").select("id", "name", "confidence")


@query("dead_fixpoint", f""", start AS ({DEAD}), uses AS (SELECT DISTINCT from_node AS src, to_node AS dst FROM tg_edges WHERE edge_type IN ('calls', 'reads', 'imports', 'decorates', 'param-flow') AND from_node <> to_node),
cand AS (SELECT id FROM tg_nodes WHERE kind IN ('Function', 'Class') AND name NOT IN ('main', 'serve', 'run', 'init', 'start', 'handler')),
d0 AS (SELECT id, 0 AS depth FROM start),
d1 AS (SELECT * FROM d0 UNION ALL SELECT dst, 1 FROM uses WHERE dst IN (SELECT id FROM cand) AND dst NOT IN (SELECT id FROM d0) GROUP BY dst HAVING count(*) = count(*) FILTER (src IN (SELECT id FROM d0))),
d2 AS (SELECT * FROM d1 UNION ALL SELECT dst, 2 FROM uses WHERE dst IN (SELECT id FROM cand) AND dst NOT IN (SELECT id FROM d1) GROUP BY dst HAVING count(*) = count(*) FILTER (src IN (SELECT id FROM d1))),
d3 AS (SELECT * FROM d2 UNION ALL SELECT dst, 3 FROM uses WHERE dst IN (SELECT id FROM cand) AND dst NOT IN (SELECT id FROM d2) GROUP BY dst HAVING count(*) = count(*) FILTER (src IN (SELECT id FROM d2)))
SELECT id, depth FROM d3""")
def _(g: CodeGraph) -> DataFrame:
    return g.dead_chains()


# Impact

SPREAD = f"""arcs AS (SELECT e.src, e.dst, e.code, e.at, e.scope, e.forward FROM (
  SELECT from_node AS src, to_node AS dst, edge_type, code, location AS at, {FROM_SCOPE} AS scope, TRUE AS forward FROM tg_edges UNION ALL SELECT to_node, from_node, edge_type, code, location, {FROM_SCOPE}, FALSE FROM tg_edges) e
  LEFT JOIN tg_nodes n ON n.id = e.src WHERE NOT starts_with(src, '#external:') AND CASE WHEN n.kind = 'Variable' THEN edge_type IN ('reads', 'assigns', 'writes', 'param-flow') ELSE edge_type IN ('calls', 'param-flow') END)"""


def impact_sql(seeds: str, depth: int, more: str = "") -> str:
    steps = ["l0 AS (SELECT DISTINCT id, 0 AS d FROM seeds)"]
    for k in range(1, depth):
        steps.append(f"l{k} AS (SELECT * FROM l{k - 1} UNION ALL SELECT DISTINCT dst, {k} FROM arcs JOIN l{k - 1} ON src = id AND d = {k - 1} WHERE dst NOT IN (SELECT id FROM l{k - 1}))")
    return f""", seeds AS ({seeds}), {SPREAD}, {', '.join(steps)},
met AS (SELECT code, at, scope, CAST(d + 1 AS BIGINT) AS depth, forward FROM l{depth - 1} JOIN arcs ON src = id)
SELECT tier, code, at, scope, depth FROM (SELECT *, CASE WHEN depth > 1 THEN 'transitive' WHEN forward THEN 'direct_callees' ELSE 'direct_callers' END AS tier, row_number() OVER (PARTITION BY code, at ORDER BY depth, forward DESC, scope) AS n FROM met) WHERE n = 1 {more}"""


@query("impact_tier1", impact_sql("SELECT id FROM tg_nodes WHERE name = 'supply_5'", 1))
def _(g: CodeGraph) -> DataFrame:
    return g.impact("supply_5", depth=1)


@query("impact_transitive", impact_sql("SELECT id FROM tg_nodes WHERE name = 'supply_2'", 3))
def _(g: CodeGraph) -> DataFrame:
    return g.impact("supply_2", depth=3)


@query("impact_location", impact_sql("SELECT from_node AS id FROM tg_edges WHERE starts_with(location, 'r0/nation_0.py:14:') UNION SELECT to_node FROM tg_edges WHERE starts_with(location, 'r0/nation_0.py:14:')", 2))
def _(g: CodeGraph) -> DataFrame:
    return g.impact("r0/nation_0.py:14", depth=2)


@query("reach_hops", """, arcs AS (SELECT DISTINCT from_node AS src, to_node AS dst FROM tg_edges WHERE edge_type IN ('calls', 'imports')), l0 AS (SELECT id, 0 AS depth FROM tg_nodes WHERE name = 'main'),
l1 AS (SELECT * FROM l0 UNION ALL SELECT DISTINCT dst, 1 FROM arcs JOIN l0 ON src = id WHERE dst NOT IN (SELECT id FROM l0)),
l2 AS (SELECT * FROM l1 UNION ALL SELECT DISTINCT dst, 2 FROM arcs JOIN l1 ON src = id AND depth = 1 WHERE dst NOT IN (SELECT id FROM l1))
SELECT id, depth FROM l2""")
def _(g: CodeGraph) -> DataFrame:
    arcs = g.edges.where("edge_type IN ('calls', 'imports')").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst")).distinct()
    return traverse.bfs_levels(g.matching("main").select("id"), arcs, 2)


# Paths between services


@query("api_paths", r"""SELECT path, count(*) AS "references" FROM (SELECT DISTINCT code, location, from_node, unnest(regexp_extract_all(code, '["''`](/api/[\w/{}\-]+)["''`]', 1)) AS path FROM tg_edges WHERE contains(code, '/api/')) GROUP BY path""")
def _(g: CodeGraph) -> DataFrame:
    return g.api_paths()


@query("api_refs", rf"""SELECT path, split_part(from_node, '#', 1) AS file, {FROM_SCOPE} AS scope, location AS at, substr(code, 1, 200) AS code FROM (SELECT DISTINCT code, location, from_node, unnest(regexp_extract_all(code, '["''`](/api/[\w/{{}}\-]+)["''`]', 1)) AS path FROM tg_edges WHERE contains(code, '/api/')) WHERE path = (SELECT '/api/' || lower(min(p_type)) || '/{{id}}' FROM part)""")
def _(g: CodeGraph) -> DataFrame:
    least = g.api_references().agg(F.min("path").alias("least")).first()["least"]
    return g.api_references(least)


# Import cycles

FILE_ARCS = "file_arcs AS (SELECT DISTINCT split_part(from_node, '#', 1) AS src, split_part(to_node, '#', 1) AS dst FROM tg_edges WHERE edge_type = 'imports' AND NOT starts_with(to_node, '#external:') AND split_part(from_node, '#', 1) <> split_part(to_node, '#', 1))"


@query("cycles_file_graph", f", {FILE_ARCS} SELECT src, dst FROM file_arcs")
def _(g: CodeGraph) -> DataFrame:
    return g.file_arcs()


@query("cycles_scc", f""" , {FILE_ARCS}, nodes0 AS (SELECT DISTINCT src AS id FROM file_arcs UNION SELECT dst FROM file_arcs),
reach AS (SELECT * FROM (WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM file_arcs UNION SELECT r.a, f.dst FROM r JOIN file_arcs f ON f.src = r.b) SELECT a, b FROM r))
SELECT x.a AS id, min(y.b) AS component FROM reach x JOIN reach y ON y.a = x.a JOIN reach z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a""")
def _(g: CodeGraph) -> DataFrame:
    return g.cycle_components()


@query("cycles_len2", f", {FILE_ARCS} SELECT a.src || '>' || a.dst AS chain, CAST(2 AS BIGINT) AS length FROM file_arcs a JOIN file_arcs b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst")
def _(g: CodeGraph) -> DataFrame:
    return g.cycles(2).select(F.array_join("chain", ">").alias("chain"), F.col("length").cast("long").alias("length"))


@query("cycles_len3", f", {FILE_ARCS} SELECT a.src || '>' || a.dst || '>' || b.dst AS chain, CAST(3 AS BIGINT) AS length FROM file_arcs a JOIN file_arcs b ON a.dst = b.src JOIN file_arcs c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst")
def _(g: CodeGraph) -> DataFrame:
    return g.cycles(3).where("length = 3").select(F.array_join("chain", ">").alias("chain"), F.col("length").cast("long").alias("length"))


# Types

TYPE_DEFS = """defs AS (SELECT c.name, c.id, split_part(c.id, '#', 1) AS file, c.location, coalesce((SELECT list_sort(list(DISTINCT v.name)) FROM tg_edges e JOIN tg_nodes v ON v.id = e.to_node WHERE e.edge_type = 'defines' AND e.from_node = c.id), []) AS fields
  FROM tg_nodes c WHERE c.kind = 'Class' AND c.name IN (SELECT name FROM tg_nodes WHERE kind = 'Class' GROUP BY name HAVING count(DISTINCT split_part(id, '#', 1)) > 1))"""
TYPE_PAIRS = f"""{TYPE_DEFS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, {LINE}, id) AS n FROM defs),
pairs AS (SELECT o.name, o.file, b.file AS base_file, o.fields, b.fields AS base FROM numbered o JOIN numbered b ON b.name = o.name AND b.n = 1 WHERE o.n > 1)"""


@query("types_groups", f""", {TYPE_DEFS} SELECT name, id, file, CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.go' THEN 'go' WHEN file LIKE '%.ts' THEN 'typescript' WHEN file LIKE '%.js' THEN 'javascript' ELSE '' END AS language, location, array_to_string(fields, ',') AS fields FROM defs""")
def _(g: CodeGraph) -> DataFrame:
    return g.type_definitions().withColumn("fields", F.array_join("fields", ","))


@query("types_mismatch_case", f""", {TYPE_PAIRS} SELECT name, file, base_file, CASE WHEN fields = base THEN 'same' WHEN list_sort(list_distinct(list_transform(fields, lambda x: lower(x)))) = list_sort(list_distinct(list_transform(base, lambda x: lower(x)))) THEN 'case' ELSE 'fields' END AS kind FROM pairs""")
def _(g: CodeGraph) -> DataFrame:
    return g.type_mismatches().select("name", "file", "base_file", "kind")


@query("types_missing_extra", f""", {TYPE_PAIRS} SELECT name, file, base_file, array_to_string(list_sort(list_filter(base, lambda x: NOT list_contains(fields, x))), ',') AS missing, array_to_string(list_sort(list_filter(fields, lambda x: NOT list_contains(base, x))), ',') AS extra FROM pairs""")
def _(g: CodeGraph) -> DataFrame:
    return g.type_mismatches().select("name", "file", "base_file", "missing", "extra")


# Export


@query("export_nodes", "SELECT id, kind, name, scope FROM tg_nodes WHERE kind <> 'External'")
def _(g: CodeGraph) -> DataFrame:
    return g.export_nodes()


@query("export_edges", "SELECT from_node, to_node, edge_type FROM tg_edges WHERE edge_type IN ('calls', 'reads', 'imports', 'defines')")
def _(g: CodeGraph) -> DataFrame:
    return g.export_edges()


# Over the tables themselves


def table_query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@table_query("search_documents", "SELECT doc_id, source, length(text) AS n FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licensed under')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where(C.contains_folded(F.col("text"), "Licensed UNDER")).select("doc_id", "source", F.length("text").cast("long").alias("n"))


@table_query("page_links", """SELECT link, count(*) AS pages FROM (SELECT unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS link FROM pages) GROUP BY link""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
    return _table(spark, sf_dir, "pages").select(F.explode(links).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


@table_query("file_hashes", "SELECT doc_id, lang, sha256(text) AS source_hash, substr(sha256(text), 1, 12) AS short_hash, strlen(text) AS size FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", sha.alias("source_hash"), F.substring(sha, 1, 12).alias("short_hash"), F.octet_length("text").cast("long").alias("size"))


@table_query("incremental_diff", """SELECT path, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT 'k' || CAST(s_suppkey AS VARCHAR) AS path, sha256(CAST(s_nationkey AS VARCHAR)) AS now FROM supplier)
FULL JOIN (SELECT 'k' || CAST(c_custkey AS VARCHAR) AS path, sha256(CAST(c_nationkey AS VARCHAR)) AS was FROM customer) USING (path) WHERE now IS DISTINCT FROM was""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the files of now, customers as those of the build before."""
    files = lambda t, key, value: _table(spark, sf_dir, t).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("path"), F.sha2(F.col(value).cast("string").cast("binary"), 256).alias("source_hash"))
    return build.changes(files("supplier", "s_suppkey", "s_nationkey"), files("customer", "c_custkey", "c_nationkey"))


@table_query("upsert_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.latest(_table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id")


@query("file_languages", "SELECT CASE WHEN name LIKE '%.py' THEN 'python' WHEN name LIKE '%.go' THEN 'go' WHEN name LIKE '%.ts' THEN 'typescript' WHEN name LIKE '%.js' THEN 'javascript' ELSE '' END AS language, count(*) AS files FROM tg_nodes WHERE kind = 'File' GROUP BY 1")
def _(g: CodeGraph) -> DataFrame:
    return g.nodes.where("kind = 'File'").groupBy(C.language(F.col("name")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def _xml(column: str) -> str:
    return f"replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "export_graphml",
    f"""SELECT 1 AS part, '    <node id="' || {_xml('id')} || '">' || CASE WHEN kind <> '' THEN '<data key="kind">' || {_xml('kind')} || '</data>' ELSE '' END || CASE WHEN name <> '' THEN '<data key="name">' || {_xml('name')} || '</data>' ELSE '' END || CASE WHEN scope <> '' THEN '<data key="scope">' || {_xml('scope')} || '</data>' ELSE '' END || '</node>' AS line FROM tg_nodes WHERE kind <> 'External'
UNION ALL SELECT 2, '    <edge source="' || {_xml('from_node')} || '" target="' || {_xml('to_node')} || '"><data key="edge_type">' || edge_type || '</data></edge>' FROM tg_edges WHERE edge_type IN ('calls', 'reads', 'imports', 'defines') AND from_node IN (SELECT id FROM tg_nodes WHERE kind <> 'External') AND to_node IN (SELECT id FROM tg_nodes WHERE kind <> 'External')""",
)
def _(g: CodeGraph) -> DataFrame:
    return export.lines(g, "graphml").where("part IN (1, 2)").select("part", "line")


@query(
    "export_dot",
    """SELECT '  "' || from_node || '" -> "' || to_node || '" [label="' || edge_type || '", color="' || CASE edge_type WHEN 'calls' THEN '#E91E63' WHEN 'reads' THEN '#3F51B5' WHEN 'imports' THEN '#009688' ELSE '#795548' END || '"];' AS line
FROM tg_edges WHERE edge_type IN ('calls', 'reads', 'imports', 'defines') AND from_node IN (SELECT id FROM tg_nodes) AND to_node IN (SELECT id FROM tg_nodes)""",
)
def _(g: CodeGraph) -> DataFrame:
    return export.lines(g, "dot", include_external=True).where("part = 2").select("line")


@table_query("extract_sources", cases.facts_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of fixed sources in all languages, as extraction has them before any merging or resolving."""
    rows = [(path, detect_language(path), text.encode()) for path, text in cases.SOURCES.items()]
    files = spark.createDataFrame(rows, "path string, lang string, content binary").repartition(4, "path")
    raw = build.raw_tables(build.extract_facts(files.where("lang IS NOT NULL")))
    meta = C.metadata(F.col("metadata"))
    text = lambda c: F.coalesce(c, F.lit(""))
    said = F.array_join(F.transform(meta["args"], lambda x: F.concat_ws(":", x["index"].cast("string"), x["kind"], text(x["kw"]), x["name"])), " ")
    nodes = raw["raw_nodes"].select(F.lit("node").alias("fact"), "kind", F.col("id").alias("a"), F.col("type_annotation").alias("b"), F.when(F.col("is_param") == 1, "parameter").otherwise("").alias("said"), F.col("location").alias("place"))
    edges = raw["raw_edges"].select(F.lit("edge"), "edge_type", "from_node", "to_node", text(F.coalesce(said, meta["decorator"])), "location")
    return nodes.union(edges)
