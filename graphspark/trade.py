"""Relational tables as a graph: the same SQL text makes the views on Spark and the expected rows elsewhere.

Nations are files, market segments classes, customers and suppliers functions, parts and pending orders variables, brands
externals; line items are calls, reads, assignments and writes by their flag, and imports between files. Every row counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators.checkpoints import stored
from graphspark.plans.graph import CodeGraph

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

#: Views in the order in which they build on each other.
VIEWS = {
    "tg_file": """
SELECT n_nationkey AS nk, n_regionkey AS rk,
  'r'||CAST(n_regionkey AS STRING)||'/nation_'||CAST(n_nationkey AS STRING)||
  CASE n_regionkey WHEN 1 THEN '.go' WHEN 2 THEN '.ts' WHEN 3 THEN '.js' ELSE '.py' END AS file
FROM nation
""",
    "tg_cust": """
SELECT c.c_custkey AS k, f.file, c.c_mktsegment AS seg, c.c_acctbal AS bal,
  f.file||'#'||CASE WHEN c.c_custkey%3=0 THEN c.c_mktsegment||'.' ELSE '' END||'C'||CAST(c.c_custkey AS STRING) AS id,
  f.file||CASE WHEN c.c_custkey%3=0 THEN ':'||c.c_mktsegment ELSE '' END AS scope,
  CASE WHEN c.c_custkey%97=1 THEN 'main'
       WHEN c.c_custkey%10=2 THEN '_fn_'||CAST(c.c_custkey%50 AS STRING)
       WHEN c.c_custkey%10=5 THEN 'test_fn_'||CAST(c.c_custkey%50 AS STRING)
       WHEN c.c_custkey%10=7 THEN 'Fn'||CAST(c.c_custkey%50 AS STRING)
       ELSE 'fn_'||CAST(c.c_custkey%50 AS STRING) END AS name,
  f.file||':'||CAST(c.c_custkey+10 AS STRING)||':4' AS location
FROM customer c JOIN tg_file f ON f.nk=c.c_nationkey
""",
    "tg_supp": """
SELECT s.s_suppkey AS k, f.file, f.file||'#S'||CAST(s.s_suppkey AS STRING) AS id,
  'supply_'||CAST(s.s_suppkey%40 AS STRING) AS name,
  f.file||':'||CAST(s.s_suppkey+1000000 AS STRING)||':0' AS location
FROM supplier s JOIN tg_file f ON f.nk=s.s_nationkey
""",
    "tg_field": """
SELECT DISTINCT c.file, c.seg, o.o_orderpriority AS pr,
  CASE WHEN c.file LIKE '%.go' THEN upper(replace(o.o_orderpriority,'-','_')) ELSE lower(replace(o.o_orderpriority,'-','_')) END AS name
FROM orders o JOIN tg_cust c ON c.k=o.o_custkey WHERE o.o_orderstatus='P'
""",
    "tg_li": """
SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk, l.l_returnflag AS rf,
  MAX(l.l_quantity) AS qty, MAX(o.o_orderstatus) AS os, MAX(c.id) AS cid, MAX(c.file) AS cfile,
  MAX(s.id) AS sid, MAX(s.file) AS sfile, MAX(s.name) AS sname, MAX(p.p_name) AS pname, MAX(p.p_type) AS ptype, MAX(p.p_brand) AS pbrand
FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey JOIN tg_cust c ON c.k=o.o_custkey
  JOIN tg_supp s ON s.k=l.l_suppkey JOIN part p ON p.p_partkey=l.l_partkey
GROUP BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag
""",
    "tg_nodes": """
SELECT file||'#' AS id,'File' AS kind,file AS name,file||':1:0' AS location,file AS scope,'' AS type_annotation,0 AS is_param FROM tg_file
UNION ALL SELECT 'lib/parts.py#','File','lib/parts.py','lib/parts.py:1:0','lib/parts.py','',0
UNION ALL SELECT file||'#'||seg,'Class',seg,file||':'||CAST(MIN(k)+2 AS STRING)||':0',file,'',0 FROM tg_cust GROUP BY file,seg
UNION ALL SELECT file||'#'||seg||'.'||name,'Variable',name,file||':2:4',file||':'||seg,pr,0 FROM tg_field
UNION ALL SELECT id,'Function',name,location,scope,'',0 FROM tg_cust
UNION ALL SELECT id,'Function',name,location,file,'str',0 FROM tg_supp
UNION ALL SELECT id||'.lot','Variable','lot',location,replace(id,'#',':'),'int',1 FROM tg_supp
UNION ALL SELECT 'lib/parts.py#P'||CAST(p_partkey AS STRING),'Variable',p_name,'lib/parts.py:'||CAST(p_partkey+2 AS STRING)||':0','lib/parts.py',p_type,0 FROM part
UNION ALL SELECT c.id||'.o'||CAST(o.o_orderkey AS STRING),'Variable','o'||CAST(o.o_orderkey AS STRING),c.file||':'||CAST(c.k+10 AS STRING)||':'||CAST(o.o_orderkey%80 AS STRING),replace(c.id,'#',':'),o.o_orderpriority,1 FROM orders o JOIN tg_cust c ON c.k=o.o_custkey WHERE o.o_orderstatus='P'
UNION ALL SELECT DISTINCT '#external:brand.'||replace(p_brand,'#','_'),'External','brand.'||replace(p_brand,'#','_'),'lib/parts.py:1:0','','',0 FROM part
""",
    "tg_edges": """
SELECT 'c'||CAST(ok AS STRING)||'_'||CAST(ln AS STRING)||'_'||CAST(pk AS STRING)||'_'||CAST(sk AS STRING) AS id,'calls' AS edge_type,cid AS from_node,sid AS to_node,
  cfile||':'||CAST(ok+1 AS STRING)||':'||CAST(ln AS STRING) AS location, sname||'(o'||CAST(ok AS STRING)||')' AS code,
  CASE WHEN os='P' THEN '{"args":[{"index":0,"name":"o'||CAST(ok AS STRING)||'","kind":"name"}]}' ELSE '{"unknown":true}' END AS metadata, '#external:'||sname AS raw_to_node
FROM tg_li WHERE rf='R'
UNION ALL SELECT 'r'||CAST(ok AS STRING)||'_'||CAST(ln AS STRING)||'_'||CAST(pk AS STRING)||'_'||CAST(sk AS STRING),'reads',cid,'lib/parts.py#P'||CAST(pk AS STRING),cfile||':'||CAST(ok+1 AS STRING)||':'||CAST(ln AS STRING),'x = get("/api/'||lower(ptype)||'/{id}")','{}','lib/parts.py#P'||CAST(pk AS STRING) FROM tg_li WHERE rf='A'
UNION ALL SELECT 'a'||CAST(ok AS STRING)||'_'||CAST(ln AS STRING)||'_'||CAST(pk AS STRING)||'_'||CAST(sk AS STRING),CASE WHEN qty>=26 THEN 'assigns' ELSE 'writes' END,cid,'lib/parts.py#P'||CAST(pk AS STRING),cfile||':'||CAST(ok+1 AS STRING)||':'||CAST(ln AS STRING),'v = '||pname,'{}','lib/parts.py#P'||CAST(pk AS STRING) FROM tg_li WHERE rf='N'
UNION ALL SELECT 'i'||cfile||'>'||sid,'imports',cfile||'#',sid,cfile||':'||CAST(MIN(sk)+1 AS STRING)||':0','from '||sfile||' import '||MIN(sname),'{}','#external:'||sfile||'.'||MIN(sname) FROM tg_li WHERE rf='R' AND cfile<>sfile GROUP BY cfile,sfile,sid
UNION ALL SELECT DISTINCT 'b'||sfile||'>'||pbrand,'imports',sfile||'#','#external:brand.'||replace(pbrand,'#','_'),sfile||':1:0','import brand.'||replace(pbrand,'#','_'),'{}','#external:brand.'||replace(pbrand,'#','_') FROM tg_li WHERE rf='A'
UNION ALL SELECT 'd'||id,'defines',CASE WHEN scope=file THEN file||'#' ELSE file||'#'||seg END,id,location,'def '||name||'():','{}',id FROM tg_cust
UNION ALL SELECT 'd'||id,'defines',file||'#',id,location,'def '||name||'(lot):','{}',id FROM tg_supp
UNION ALL SELECT 'd'||file||'#'||seg,'defines',file||'#',file||'#'||seg,file||':'||CAST(MIN(k)+2 AS STRING)||':0','class '||seg||':','{}',file||'#'||seg FROM tg_cust GROUP BY file,seg
UNION ALL SELECT 'd'||file||'#'||seg||'.'||name,'defines',file||'#'||seg,file||'#'||seg||'.'||name,file||':2:4',name||': '||pr,'{}',file||'#'||seg||'.'||name FROM tg_field
UNION ALL SELECT 't'||c.id||'.o'||CAST(o.o_orderkey AS STRING),'returns',c.id,c.id||'.o'||CAST(o.o_orderkey AS STRING),c.file||':'||CAST(o.o_orderkey+1 AS STRING)||':0','return o'||CAST(o.o_orderkey AS STRING),'{}',c.id||'.o'||CAST(o.o_orderkey AS STRING) FROM orders o JOIN tg_cust c ON c.k=o.o_custkey WHERE o.o_orderstatus='P'
UNION ALL SELECT 'e'||id,'decorates',id,id,location,'@'||lower(seg),'{"decorator":"'||lower(seg)||'"}',id FROM tg_cust WHERE bal<0
""",
}


#: Views that several branches of later ones read.
REUSED = ("tg_cust", "tg_supp", "tg_li")


def with_views(query: str) -> str:
    """The query behind the definitions of all views; one that starts with a comma goes on with definitions."""
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql.strip()})" for name, sql in VIEWS.items()) + "\n" + query.strip()


_kept: dict[tuple[str, str], CodeGraph] = {}


def trade_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph over the tables in a folder; nodes and edges are stored for the queries of the session that follow."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        frames = dict(sources)
        for name, sql in VIEWS.items():
            # Names in the text are arguments here, so nothing is registered in the session's catalog.
            used = {n: df for n, df in frames.items() if _mentions(sql, n)}
            frames[name] = spark.sql(_braced(sql, used), **used)
            if name in REUSED:
                frames[name] = stored(frames[name], name)
        nodes = stored(frames["tg_nodes"].withColumns({"end_location": F.col("location"), "source_hash": F.lit("")}), "trade-nodes")
        edges = stored(frames["tg_edges"], "trade-edges")
        transforms = spark.createDataFrame([], "id string, kind string, op string, op_node string, location string, inputs array<string>, outputs array<string>, branch string, code string")
        files = nodes.where("kind = 'File'").select(F.col("name").alias("path"), "source_hash")
        _kept[key] = CodeGraph(nodes, edges, transforms, files)
    return _kept[key]


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def _braced(sql: str, names: dict[str, DataFrame]) -> str:
    return re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], sql.replace("{", "{{").replace("}", "}}"))
