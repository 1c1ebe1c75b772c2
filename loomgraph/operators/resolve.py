"""Call resolution (RS): call forms to typed edges, as one cascade of joins in which the first match wins.

Records are those of `functions.python_source` and `functions.static_source`: symbols
(free, method, type, field, import) and calls as forms.  Symbol tables are keyed by module
and name; no row is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import BOUNDARY, UNRESOLVED

#: what ends the name of a Rust function that makes an object
CONSTRUCTORS = ("new", "default", "from")


#: what resolution reads of records
COLUMNS = ("lang", "module", "kind", "name", "owner", "target", "form", "head", "id", "class_name", "params_types", "line", "is_await", "raw", "file_ord", "ord")


def _last(c: Column) -> Column:
    return F.regexp_extract(c, r"([^.:]*)$", 1)


def _left(calls: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """calls with what the table has of their keys.

    Symbol tables grow with the code, and their size is guessed far too low behind Python:
    both sides are sorted, nothing is broadcast.  Calls without a key are dealt out.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first, *others = keys
    kept = calls.withColumn("__key", F.when(whole, F.col(first)).otherwise(F.concat(F.lit(" "), "file_ord")))
    return kept.join(table.withColumnRenamed(first, "__key").hint("merge"), ["__key", *others], "left").drop("__key")


def _symbols(records: DataFrame, kind: str, keys: list[str], target: Column, out: str, first: bool) -> DataFrame:
    """One target a key: of the first or the last module; inside a module the last definition counts."""
    at = F.struct(F.col("file_ord") * (-1 if first else 1), "ord")
    return records.where(F.col("kind") == kind).groupBy(*keys).agg(F.max_by(target, at).alias(out))


def _edges(calls: DataFrame, cascade: list[tuple[Column, str, Column]], otherwise: Column) -> DataFrame:
    kind, callee = F.lit("unresolved"), F.concat(F.lit(UNRESOLVED), otherwise)
    for cond, k, target in reversed(cascade):
        kind, callee = F.when(cond, F.lit(k)).otherwise(kind), F.when(cond, target).otherwise(callee)
    return calls.select(F.struct("file_ord", "ord").alias("at"), F.col("id").alias("caller_id"), callee.alias("callee_id"), "is_await", kind.alias("call_type"), "line", "raw")


def resolve_python(records: DataFrame) -> DataFrame:
    """RS-P: edges (at, caller_id, callee_id, is_await, call_type, line, raw) of extracted Python records.

    Bare names: class of the module, function of the module, imported name (a class that
    another module has; anything else starting with a capital outside; a function of a
    module whose id is the first segment; outside).  self.m: method of the class.
    self.a.m: method of the attribute's class.  p.m: method of the parameter's class;
    imported class; imported module.  A class of a name is the last module's that has it.
    Calls of records that repeat are resolved each; without records there are no edges.
    """
    r = records.where("lang = 'python'").select(*COLUMNS)
    modules = r.select("module").distinct().withColumnRenamed("module", "first_part").withColumn("is_module", F.lit(True))
    classes = _symbols(r, "type", ["name"], F.col("module"), "type_module", first=False).withColumnRenamed("name", "type")
    own = r.where("kind = 'type'").select("module", "name").distinct().withColumn("own_class", F.lit(True))
    free = r.where("kind = 'free'").select("module", "name").distinct().withColumn("own_function", F.lit(True))
    methods = r.where("kind = 'method'").select("module", F.col("owner").alias("class_name"), "name").distinct().withColumn("own_method", F.lit(True))
    fields = _symbols(r, "field", ["owner", "name"], F.col("target"), "field_type", first=False).select(F.col("owner").alias("class_name"), F.col("name").alias("slot"), "field_type")

    form = F.col("form")
    c = _left(r.where("kind = 'call'").withColumn("slot", F.when(form == "self_attr", F.col("head"))), fields, ["slot", "class_name"])
    said = F.when(form == "self_attr", F.col("field_type")).when(form == "member", F.try_element_at("params_types", F.col("head")))
    made = _last(F.col("target"))
    c = c.withColumn("said", said).withColumn("type", F.when(form == "bare", F.when(made.rlike(r"^\p{Lu}"), made)).when(F.col("said").isNotNull(), _last(F.col("said"))).when(form == "member", F.col("head")))
    c = c.withColumn("first_part", F.when(form == "bare", F.split_part("target", F.lit("."), F.lit(1))))
    c = _left(_left(c, classes, ["type"]), modules, ["first_part"])
    c = _left(_left(_left(c, own, ["module", "name"]), free, ["module", "name"]), methods, ["module", "class_name", "name"])

    dotted = lambda *parts: F.concat_ws(".", *parts)
    outside = lambda *parts: F.concat(F.lit(BOUNDARY), dotted(*parts))
    bare, member, attr = form == "bare", form == "member", form == "self_attr"
    has_type, typed, imported = F.col("type_module").isNotNull(), F.col("said").isNotNull(), F.col("target").isNotNull()
    upper = F.col("type").rlike(r"^\p{Lu}")
    in_type = dotted("type_module", "type", "name")
    cascade = [
        (bare & F.col("own_class"), "internal_constructor", dotted("module", "name", F.lit("__init__"))), (bare & F.col("own_function"), "internal_func", dotted("module", "name")),
        (bare & imported & upper & has_type & (F.col("type_module") != F.col("module")), "internal_constructor", dotted("type_module", "type", F.lit("__init__"))),
        (bare & imported & upper, "boundary_constructor", outside("target")), (bare & imported & F.col("is_module"), "internal_func", F.col("target")), (bare & imported, "boundary", outside("target")),
        ((form == "self") & F.col("own_method"), "self_method", dotted("module", "class_name", "name")),
        (attr & typed & has_type, "self_attr_method", in_type), (attr & typed, "boundary", outside("said", "name")), (member & typed & has_type, "param_method", in_type), (member & typed, "boundary", outside("said", "name")),
        (member & imported & has_type, "internal_func", in_type), (member & imported, "boundary", outside("target", "name")),
    ]
    return _edges(c, cascade, F.when(bare, F.col("name")).when(attr, dotted(F.lit("self"), "head", "name")).when(form.isin("self", "member"), dotted("head", "name")).otherwise(F.col("raw")))


def unique_match(symbols: DataFrame) -> DataFrame:
    """RS-R2: names (tail, name) that exactly one id has."""
    return symbols.groupBy("tail", "name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def resolve_scripts(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """RS-S: script calls: a function of that name anywhere (the first), else outside; never unresolved."""
    first = functions.groupBy("name").agg(F.min_by("id", "ord").alias("f_id"))
    c = calls.join(first.hint("merge"), "name", "left")  # names grow with the code
    return c.select("ord", "caller_id", F.coalesce("f_id", F.concat(F.lit(BOUNDARY), "name")).alias("callee_id"), F.when(F.col("f_id").isNotNull(), "internal_func").otherwise("boundary").alias("call_type"), "line")


def resolve_forms(records: DataFrame, lang: str, unique: bool = True) -> DataFrame:
    """RS-R, RS-G, RS-T: edges (at, caller_id, callee_id, is_await, call_type, line, raw) of extracted records of one language.

    A method call on a field or parameter whose type some module defines goes to that
    type (the first module's) whether or not it has the method; types defined nowhere are
    outside.  Free functions are looked for in the own module; in Rust, where `unique`,
    also by the last part of a path if exactly one function answers (without it: RS-Rs).
    Files of one Rust module are taken together; of functions with one id there the first file's counts.
    """
    sep = "::" if lang == "rust" else "."
    r = records.where(F.col("lang") == lang).select(*COLUMNS)
    calls, functions = r.where("kind = 'call'"), r.where("kind = 'function'")
    if lang == "rust":  # of the records only these have an id
        kept = functions.groupBy("id").agg(F.min("file_ord").alias("kept"))
        calls, functions = (_left(x, kept, ["id"]).where("kept IS NULL OR kept = file_ord").drop("kept") for x in (calls, functions))
    types = _symbols(r, "type", ["name"], F.col("module"), "type_module", first=True).withColumnRenamed("name", "type")
    free = r.where("kind = 'free'").select("module", "name").distinct().withColumn("own_function", F.lit(True))
    methods = r.where("kind = 'method'").select("module", "owner", "name").distinct().withColumn("own_method", F.lit(True))
    fields = _symbols(r, "field", ["module", "owner", "name"], F.col("target"), "field_type", first=False).withColumnRenamed("name", "slot")
    imports = _symbols(r, "import", ["module", "name"], F.col("target"), "import", first=True).withColumnRenamed("name", "local")

    form = F.col("form")
    bare, path, member, attr = form == "bare", form == "path", form == "member", form == "self_attr"
    c = calls.drop("target").withColumn("local", F.when(bare, F.col("name")).when(member, F.col("head")))
    c = _left(c, imports, ["module", "local"])
    c = _left(c.withColumn("slot", F.when(attr, F.col("head"))), fields, ["module", "owner", "slot"])
    c = c.withColumn("said", F.when(attr, F.col("field_type")).when(member, F.try_element_at("params_types", F.col("head"))))
    part = F.when(path, _last(F.col("head"))).when(bare, F.regexp_extract("import", r"([^:]*)::[^:]*$", 1))
    c = c.withColumns({"type": F.when(bare, F.col("name")).when(path, _last(F.col("head"))).otherwise(F.col("said")), "tail": part, "leaf": F.when(bare, _last(F.col("import"))).when(path, F.col("name"))})
    c = _left(_left(_left(c, types, ["type"]), free, ["module", "name"]), methods, ["module", "owner", "name"])
    if lang == "rust" and unique:
        ids = functions.where("class_name IS NULL").select(F.regexp_extract("module", r"([^:]*)$", 1).alias("tail"), "name", "id")
        c = _left(c, unique_match(ids).select("tail", F.col("name").alias("leaf"), F.col("id").alias("only")), ["tail", "leaf"])
    else:
        c = c.withColumn("only", F.lit(None).cast("string"))

    joined = lambda *parts: F.concat_ws(sep, *parts)
    outside = lambda *parts: F.concat(F.lit(BOUNDARY), joined(*parts))
    has_type, typed, imported = F.col("type_module").isNotNull(), F.col("said").isNotNull(), F.col("import").isNotNull()
    in_type, makes = joined("type_module", "type", "name"), F.col("name").isin(*CONSTRUCTORS)
    cascade = [(bare & F.col("own_function"), "internal_func", joined("module", "name"))]
    if lang == "rust":
        cascade += [
            (form == "macro", "boundary", F.concat(F.lit(BOUNDARY), "name", F.lit("!"))), (bare & imported & has_type, "internal_constructor", joined("type_module", "name", F.lit("new"))),
            (bare & imported & F.col("only").isNotNull(), "internal_func", F.col("only")), (path & has_type & makes, "internal_constructor", in_type), (path & has_type, "internal_func", in_type),
            (path & F.col("only").isNotNull(), "internal_func", F.col("only")), (path & F.col("type").rlike(r"^\p{Lu}") & makes, "boundary_constructor", outside("head", "name")), (path, "boundary", outside("head", "name")),
        ]
    if lang != "go":
        cascade.append((bare & imported, "boundary", outside("import")))
    cascade += [
        ((form == "self") & F.col("own_method"), "self_method", joined("module", "class_name", "name")),
        (attr & typed & has_type, "self_attr_method", in_type), (attr & typed, "boundary", outside("said", "name")), (member & typed & has_type, "param_method", in_type), (member & typed, "boundary", outside("said", "name")),
    ]
    if lang != "rust":
        cascade.append((member & imported, "boundary", F.concat(F.lit(BOUNDARY), "import", F.lit("."), "name")))
    me = F.regexp_extract("raw", r"^(\w+)", 1)
    return _edges(c, cascade, F.when(bare, F.col("name")).when(attr, F.concat_ws(".", me, "head", "name")).when(form.isin("self", "member"), F.concat_ws(".", "head", "name")).otherwise(F.col("raw")))
