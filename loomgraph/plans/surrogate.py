"""The engine's relations over the standard tables, as SQL that both Spark and DuckDB read.

The standard tables hold no code.  These views give them the shapes the operators take:
parts stand for functions, line items for calls, regions and nations for stages, orders
for members, documents for files with their contents and cards.  `{name}` names a table
or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "functions": """
        SELECT p_partkey AS ord, concat('f', p_partkey) AS id,
          CASE WHEN p_partkey % 97 = 0 THEN 'main' WHEN p_partkey % 89 = 0 THEN concat('run_', p_partkey % 50) WHEN p_partkey % 83 = 0 THEN 'Bootstrap' WHEN p_partkey % 79 = 0 THEN concat('exec_', p_partkey % 50)
            WHEN p_partkey % 73 = 0 THEN 'cli' WHEN p_partkey % 71 = 0 THEN 'process' WHEN p_partkey % 67 = 0 THEN 'cmd' ELSE concat('fn', p_partkey % 1500) END AS name,
          concat(CASE WHEN p_partkey % 3 = 0 THEN concat('C', p_partkey % 11, '.') ELSE '' END,
            CASE WHEN p_partkey % 97 = 0 THEN 'main' WHEN p_partkey % 89 = 0 THEN concat('run_', p_partkey % 50) WHEN p_partkey % 83 = 0 THEN 'Bootstrap' WHEN p_partkey % 79 = 0 THEN concat('exec_', p_partkey % 50)
            WHEN p_partkey % 73 = 0 THEN 'cli' WHEN p_partkey % 71 = 0 THEN 'process' WHEN p_partkey % 67 = 0 THEN 'cmd' ELSE concat('fn', p_partkey % 1500) END) AS qualname,
          concat(lower(p_type), '/', lower(replace(p_brand, '#', '_')), '.py') AS file, p_size AS line_start,
          CAST(p_size + p_partkey % 80 AS INT) AS line_end, concat('def ', p_name, '(', repeat('x, ', CAST(p_partkey % 60 AS INT)), ')') AS signature,
          CASE WHEN p_partkey % 3 = 0 THEN concat('C', p_partkey % 11) END AS class_name, p_partkey % 41 = 0 AS synthetic, 'internal' AS kind,
          split(concat('a', p_partkey % 5, ',b', p_partkey % 7), ',') AS used_self_attrs_read, split(concat('a', p_partkey % 4), ',') AS used_self_attrs_written,
          concat(p_name, chr(10), 'body ', p_partkey % 9) AS text
        FROM {part}""",
    "calls": """
        SELECT l_orderkey * 10 + l_linenumber AS ord, concat('f', l_partkey) AS caller_id,
          CASE WHEN l_returnflag = 'R' THEN concat('unresolved:', CASE l_linenumber % 7 WHEN 0 THEN 'self.logger.info' WHEN 1 THEN 'self.other' WHEN 2 THEN '''s''.join' WHEN 3 THEN CASE l_orderkey % 5 WHEN 0 THEN 'len' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'super' WHEN 3 THEN 'hash' ELSE 'StopIteration' END
              WHEN 4 THEN CASE l_orderkey % 3 WHEN 0 THEN 'obj.run' WHEN 1 THEN 'print (x).flush' ELSE 'input.read' END WHEN 5 THEN 'helper' ELSE 'sorted.x' END)
            WHEN l_suppkey % 5 = 0 THEN concat('boundary:pkg', l_orderkey % 7, CASE WHEN l_orderkey % 2 = 0 THEN concat('.Cls', l_orderkey % 3) ELSE '.sub' END, '.f', l_orderkey % 11)
            WHEN l_suppkey % 5 = 1 THEN concat('m', l_orderkey % 13, '.K', l_orderkey % 17, '.__init__') ELSE concat('f', l_orderkey) END AS callee_id,
          CASE WHEN l_returnflag = 'R' THEN 'unresolved' WHEN l_suppkey % 5 = 0 THEN 'boundary' WHEN l_suppkey % 5 = 1 THEN 'internal_constructor' ELSE 'internal_func' END AS call_type,
          l_linestatus = 'O' AS is_await, l_linenumber AS line, l_returnflag AS raw
        FROM {lineitem}""",
    "kept": "SELECT * FROM {calls} WHERE call_type <> 'unresolved'",
    "scanned": """
        SELECT DISTINCT file, CAST(0 AS BIGINT) AS ord FROM {functions} UNION ALL SELECT concat('empty/', n_name, '.py') AS file, CAST(n_nationkey AS BIGINT) AS ord FROM {nation}""",
    "stages": """
        SELECT CAST(r_regionkey * 1000 AS BIGINT) AS ord, concat('stage-', r_regionkey + 1) AS id, concat(r_name, ' Regions') AS title, concat('All of ', r_name, '. More text.') AS description,
          CAST(NULL AS VARCHAR(9)) AS parent, FALSE AS crosscut FROM {region}
        UNION ALL SELECT CAST(n_regionkey * 1000 + n_nationkey + 1 AS BIGINT), concat('stage-', n_regionkey + 1, '.', n_nationkey), concat('Nation zone', n_nationkey % 6, ' unit', n_nationkey % 4),
          concat('Part of it. Number ', n_nationkey), CASE WHEN n_nationkey % 11 = 10 THEN 'stage-77' ELSE concat('stage-', n_regionkey + 1) END, n_nationkey % 8 = 0 FROM {nation}
        UNION ALL SELECT CAST(n_regionkey * 1000 + 100 + n_nationkey AS BIGINT), concat('stage-', n_regionkey + 1, '.', n_nationkey, '.1'), concat('Leaf unit', n_nationkey % 5), 'Leaf',
          concat('stage-', n_regionkey + 1, '.', n_nationkey), FALSE FROM {nation} WHERE n_nationkey % 3 = 0
        UNION ALL SELECT CAST(10000 + c.c_custkey AS BIGINT), concat('stage-c', c.c_custkey), concat('Account ', lower(c.c_mktsegment), ' desk', c.c_custkey % 400, ' support'),
          concat('Holds account ', c.c_custkey, '. More.'), CASE WHEN c.c_custkey % 5 = 0 AND c.c_custkey >= 10 THEN concat('stage-c', CAST(floor(c.c_custkey / 5) AS BIGINT))
            WHEN c.c_custkey % 5 = 1 AND c.c_custkey % 100 > 1 THEN concat('stage-c', c.c_custkey - 5) ELSE concat('stage-', n.n_regionkey + 1, '.', n.n_nationkey) END, FALSE
          FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        UNION ALL SELECT CAST(9000 + k AS BIGINT), concat('crosscut-', k), concat('Shared zone', k), '', CAST(NULL AS VARCHAR(9)), TRUE FROM (SELECT DISTINCT n_nationkey % 4 AS k FROM {nation}) c""",
    "file_stage": """
        SELECT f.file, f.k AS ord, CASE WHEN f.k % 9 = 0 THEN 'unassigned' WHEN f.k % 13 = 0 THEN 'stage-99' WHEN f.k % 4 = 1 THEN concat('stage-c', f.k % 700 + 1) ELSE concat('stage-', n.n_regionkey + 1, '.', n.n_nationkey) END AS stage
        FROM (SELECT file, min(ord) AS k FROM {functions} GROUP BY file) f JOIN {nation} n ON n.n_nationkey = f.k % 25""",
    "members": """
        SELECT CASE WHEN o.o_orderkey % 10 = 0 THEN concat('crosscut-', o.o_orderkey % 4) ELSE concat('stage-', n.n_regionkey + 1, '.', n.n_nationkey) END AS stage, o.o_orderkey AS ord, f.qualname,
          CASE WHEN o.o_orderstatus = 'F' THEN 'function' ELSE 'region' END AS type, f.file, CAST(f.line_start + o.o_orderkey % 7 AS INT) AS line_start, CAST(f.line_end + o.o_orderkey % 7 AS INT) AS line_end,
          concat('Purpose ', o.o_orderkey % 90, '. More ', o.o_orderkey) AS purpose
        FROM {orders} o JOIN {functions} f ON f.ord = o.o_custkey JOIN {nation} n ON n.n_nationkey = o.o_orderkey % 25""",
    "cards": """
        SELECT doc_id AS ord, concat(source, '/', lang, '/', doc_id, '.py') AS file, CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('Purpose ', repeat('x', CAST(doc_id % 40 AS INT))) END AS purpose,
          CASE doc_id % 7 WHEN 0 THEN 'entrypoint' WHEN 1 THEN 'domain_logic' WHEN 2 THEN 'io_transport' WHEN 3 THEN 'data_model' WHEN 4 THEN 'config' WHEN 5 THEN 'test' ELSE 'other' END AS role,
          CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(lang, doc_id % 3) END AS lifecycle, CASE WHEN doc_id % 4 = 0 THEN 'text' ELSE '' END AS description, n_chars % 9 AS n_functions
        FROM {documents}""",
    "contents": "SELECT doc_id AS ord, concat(source, '/', lang, '/', doc_id, '.py') AS file, concat(coalesce(text, ''), '') AS content FROM {documents}",
    "registers": """
        SELECT CAST(n_nationkey AS BIGINT) AS ord, concat('reg-zone', n_nationkey % 7, '-state') AS id, concat('State of stage-', n_regionkey + 1, ' and more') AS semantics,
          split(concat('stage-', n_regionkey + 1, ',stage-', n_regionkey + 1, '.', n_nationkey, ',stage-99'), ',') AS stages FROM {nation}
        UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), concat('reg-desk', s_suppkey % 400, '-Queue'), concat('Queue of stage-c', s_suppkey, ' and more'),
          split(concat('stage-', s_nationkey % 5 + 1, ',stage-c', s_suppkey), ',') FROM {supplier}""",
    "verdicts": """
        SELECT conv_id AS proposal, CAST(turn + 1 AS INT) AS round, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS INT) AS role_ord, role,
          CASE (conv_id * 7 + turn * 3 + length(role)) % 5 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'REVISE' WHEN 2 THEN 'REVISE' ELSE 'APPROVE' END AS decision,
          CASE WHEN (conv_id + turn) % 3 = 0 THEN split('a,b', ',') ELSE split('c', ',') END AS concerns
        FROM {conversations}""",
    "rounds": """
        SELECT conv_id AS unit, CAST(turn + 1 AS INT) AS round, CAST(min(length(text)) % 40 AS DOUBLE) / 8.0 AS overall, min(length(text)) % 40 >= 32 AS passed FROM {conversations} GROUP BY conv_id, turn""",
    "scores": """
        SELECT l_orderkey AS unit, CASE l_linenumber WHEN 1 THEN 'accuracy' WHEN 2 THEN 'io_params_precision' WHEN 3 THEN 'register_accuracy' WHEN 4 THEN 'code_detail_fidelity' WHEN 5 THEN 'non_obvious_surfaced' ELSE 'section_purity_style' END AS criterion,
          CASE WHEN l_suppkey % 11 = 0 THEN 'bad' ELSE concat('', l_suppkey % 8) END AS score FROM {lineitem}""",
    "rubric": """
        SELECT 'accuracy' AS criterion, 'gate' AS kind, CAST(0.25 AS DOUBLE) AS weight, 3 AS floor UNION ALL SELECT 'io_params_precision', 'gate', CAST(0.25 AS DOUBLE), 3
        UNION ALL SELECT 'register_accuracy', 'gate', CAST(0.15 AS DOUBLE), 3 UNION ALL SELECT 'code_detail_fidelity', 'soft', CAST(0.15 AS DOUBLE), 3
        UNION ALL SELECT 'non_obvious_surfaced', 'soft', CAST(0.12 AS DOUBLE), 3 UNION ALL SELECT 'section_purity_style', 'soft', CAST(0.08 AS DOUBLE), 3""",
    "spans": """
        SELECT user_id % 40 AS fn, CAST(event_id % 300 AS INT) AS s, CAST(event_id % 300 + user_id % 9 AS INT) AS e FROM {events}""",
    "requests": """
        SELECT event_id AS req, user_id % 45 AS fn, CAST(event_id % 290 AS INT) AS a, CAST(event_id % 290 + event_id % 23 AS INT) AS b FROM {events}""",
}
_NAME = re.compile(r"\{(\w+)\}")


class Relations:
    """Views over the tables of a folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.made:
            if name in VIEWS:
                used = set(_NAME.findall(VIEWS[name]))
                self.made[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in used})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]


def sql(query: str) -> str:
    """A DuckDB query whose `{view}` names are defined before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in need:
                visit(VIEWS[n])
                need.append(n)

    visit(query)
    parts = [f"{n} AS ({_NAME.sub(r'\1', VIEWS[n])})" for n in need]
    body = _NAME.sub(r"\1", query).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*parts, body[len("WITH RECURSIVE") :].strip()])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:].strip()])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
