"""Graph assembly (GR): kept and dropped calls, degrees, derived endpoints, node table, cross-reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: names that count as built-in functions when a call to them stays unresolved
BUILTINS = (
    "len isinstance range enumerate zip list dict tuple set str int float bool type id print repr min max sum abs any all sorted reversed "
    "getattr setattr hasattr callable open iter next map filter "
    "RuntimeError ValueError TypeError TimeoutError Exception KeyError IndexError StopIteration NotImplementedError"
).split()
UNRESOLVED, BOUNDARY, INIT = "unresolved:", "boundary:", ".__init__"


def kept_calls(calls: DataFrame) -> DataFrame:
    """GR-1: calls whose target is known."""
    return calls.where(F.col("call_type") != "unresolved")


def dropped_calls(calls: DataFrame) -> DataFrame:
    """GR-1, GR-2: calls whose target is not known, with the raw target and a category."""
    raw = F.regexp_replace("callee_id", f"^{UNRESOLVED}", "")
    return calls.where("call_type = 'unresolved'").select(
        drop_category(raw).alias("category"), F.col("caller_id").alias("caller"), raw.alias("callee_raw"), "is_await", "line", "raw", "ord"
    )


def drop_category(target: Column) -> Column:
    """GR-2: the first rule that fits names the category."""
    head = F.trim(F.split_part(F.split_part(target, F.lit("."), F.lit(1)), F.lit("("), F.lit(1)))
    return (
        F.when(target.startswith("self.logger") | target.startswith("self._logger"), "inherited_method")
        .when(target.startswith("self."), "self_attr_unknown")
        .when(target.startswith("'") | target.startswith('"'), "string_literal_method")
        .when(head.isin(BUILTINS), "builtin")
        .when(target.contains("."), "local_var_method")
        .otherwise("bare_name")
    )


def degrees(kept: DataFrame) -> DataFrame:
    """GR-3: calls out of and into every id, every call counted: (id, n_callees, n_callers).

    One shuffle: both ends are exploded and counted together, with partial counts first.
    """
    ends = kept.select(
        F.explode(F.array(F.struct(F.col("caller_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("callee_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    ).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("n_callees"), F.sum("i").alias("n_callers"))


def last_definition(functions: DataFrame) -> DataFrame:
    """Of functions that share an id, the last one (the largest ord)."""
    cols = [c for c in functions.columns if c != "id"]
    return functions.groupBy("id").agg(F.max_by(F.struct(*cols), "ord").alias("f")).select("id", "f.*")


def missing_endpoints(functions: DataFrame, kept: DataFrame) -> DataFrame:
    """GR-4: ids that kept calls name and no function defines."""
    ends = kept.select(F.explode(F.array("caller_id", "callee_id")).alias("id")).distinct()
    return ends.join(functions.select("id"), "id", "left_anti")


def boundary_parts(qualname: Column) -> Column:
    """GR-5: (module, class_name, name): split at the first capitalised segment that is not the last; else all but the last is the module."""
    parts = F.split(qualname, r"\.")
    n = F.size(parts)
    upper = F.array_position(F.transform(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda p: p.rlike(r"^\p{Lu}")), True)
    join = lambda a, k: F.array_join(F.slice(parts, a, k), ".")
    return F.struct(
        F.when(upper > 0, join(1, (upper - 1).cast("int"))).otherwise(join(1, F.greatest(n - 1, F.lit(0)))).alias("module"),
        F.when(upper > 0, join(upper.cast("int"), (n - upper).cast("int"))).otherwise(F.lit("")).alias("class_name"),
        F.element_at(parts, -1).alias("name"),
    )


def boundary_nodes(missing: DataFrame) -> DataFrame:
    """GR-5: nodes of calls that leave the code."""
    q = F.regexp_replace("id", f"^{BOUNDARY}", "")
    return missing.where(F.col("id").startswith(BOUNDARY)).withColumn("p", boundary_parts(q)).select("id", q.alias("qualname"), "p.*", F.lit("boundary").alias("kind"))


def constructor_nodes(missing: DataFrame, default_ext: str = ".py") -> DataFrame:
    """GR-6: nodes of constructors that are called and not written out."""
    owner = F.regexp_replace("id", r"\.__init__$", "")
    module, cls = F.regexp_replace(owner, r"\.[^.]*$", ""), F.regexp_extract(owner, r"([^.]*)$", 1)
    return missing.where(F.col("id").endswith(INIT) & ~F.col("id").startswith(BOUNDARY)).select(
        "id", F.lit("__init__").alias("name"), F.concat(cls, F.lit(INIT)).alias("qualname"), F.concat(module, F.lit(default_ext)).alias("file"),
        F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), cls.alias("class_name"), F.lit("internal").alias("kind"), F.lit(True).alias("synthetic"),
    )


def nodes(functions: DataFrame, kept: DataFrame, default_ext: str = ".py") -> DataFrame:
    """GR-7: functions and derived endpoints with their degrees; other dangling ids have no row."""
    missing = missing_endpoints(functions, kept)
    known = last_definition(functions).unionByName(constructor_nodes(missing, default_ext), True).unionByName(boundary_nodes(missing), True)
    return known.join(degrees(kept), "id", "left").fillna(0, ["n_callees", "n_callers"])


def state_xref(functions: DataFrame) -> DataFrame:
    """GR-8: per class and attribute the functions that read and that write it, in function order."""
    f = functions.where("class_name IS NOT NULL")
    use = lambda c, kind: f.select("class_name", F.explode(c).alias("attr"), F.lit(kind).alias("use"), "ord", "id")
    uses = use("used_self_attrs_read", "r").unionByName(use("used_self_attrs_written", "w"))
    ids = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("use") == kind, F.struct("ord", "id")))), lambda s: s["id"])
    return uses.groupBy("class_name", "attr").agg(ids("r").alias("read_in"), ids("w").alias("written_in"))


def call_types(calls: DataFrame) -> DataFrame:
    """GR-9: calls by type."""
    return calls.groupBy("call_type").agg(F.count("*").alias("n"))


def stats(functions: DataFrame, calls: DataFrame, graph: DataFrame) -> DataFrame:
    """GR-9: one row of totals; graph: the node table."""
    c = calls.agg(F.count_if(F.col("call_type") != "unresolved").alias("n_kept"), F.count_if(F.col("call_type") == "unresolved").alias("n_dropped"))
    n = graph.agg(F.count_if(F.col("kind") == "internal").alias("n_internal"), F.count_if(F.col("kind") == "boundary").alias("n_boundary"))
    return functions.agg(F.count("*").alias("n_functions")).crossJoin(c).crossJoin(n)  # one row each
