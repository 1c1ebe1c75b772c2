"""Artifacts on disk: the graph document, skeleton YAML, bundles, record and card stores, handbook JSON (SC, SK)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from . import markdown

NODE = (
    "name STRING, qualname STRING, file STRING, line_start INT, line_end INT, signature STRING, is_async BOOLEAN, is_method BOOLEAN, class_name STRING, module STRING, decorators ARRAY<STRING>, "
    "kind STRING, synthetic BOOLEAN, used_self_attrs_read ARRAY<STRING>, used_self_attrs_written ARRAY<STRING>, n_callees BIGINT, n_callers BIGINT"
)
EDGE = "caller_id STRING, callee_id STRING, is_await BOOLEAN, call_type STRING, line INT, raw STRING"
GRAPH = f"metadata MAP<STRING, STRING>, nodes MAP<STRING, STRUCT<{NODE}>>, edges ARRAY<STRUCT<{EDGE}>>"


def _quoted(c: Column) -> Column:
    """A text as a JSON string, which YAML reads too."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


# --- graph -------------------------------------------------------------------------


def graph_lines(nodes: DataFrame, kept: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """SK-1: lines (part, k, text) of one JSON document in order of part and k: metadata, nodes by id, edges.

    Nodes are one line each, so nothing is gathered; of nodes with one id the last of the
    order `ord` counts.  Every line but a part's first starts with a comma.
    """
    spark = nodes.sparkSession
    columns = [c for c in re.findall(r"(\w+) \w+(?:<\w+>)?(?:, |$)", NODE) if c in nodes.columns]
    one = nodes.groupBy("id").agg(F.max_by(F.struct(*columns), "ord" if "ord" in nodes.columns else F.lit(0)).alias("v"))
    first = one.agg(F.min("id").alias("first"))
    body = one.crossJoin(F.broadcast(first)).select(  # one row
        F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.when(F.col("id") == F.col("first"), "").otherwise(","), _quoted(F.col("id")), F.lit(": "), F.to_json("v")).alias("text")
    )
    e = kept.select(F.format_string("%019d", "ord").alias("k"), F.to_json(F.struct(*(c for c in kept.columns if c != "ord"))).alias("text"))
    least = e.agg(F.min("k").alias("first"))
    edges = e.crossJoin(F.broadcast(least)).select(F.lit(3).alias("part"), "k", F.concat(F.when(F.col("k") == F.col("first"), "").otherwise(","), "text").alias("text"))
    frame = [(0, "", '{"metadata": ' + json.dumps(metadata, sort_keys=True) + ', "nodes": {'), (2, "", '}, "edges": ['), (4, "", "]}")]
    return spark.createDataFrame(frame, "part int, k string, text string").unionByName(body).unionByName(edges)


def save_lines(lines: DataFrame, path: str) -> None:
    """Write lines (part, k, text) in order as one text file below `path`; one task streams them, as one document has to be one file."""
    lines.orderBy("part", "k").select("text").coalesce(1).write.mode("overwrite").text(path)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC-9: (nodes, edges) of a graph document; nodes keep their id, edges their order.  A broken document gives none."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    nodes = doc.select(F.explode("nodes").alias("id", "n")).select("id", "n.*")
    return nodes, doc.select(F.posexplode("edges").alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")


# --- skeleton YAML -----------------------------------------------------------------


def skeleton_yaml(stages: DataFrame) -> DataFrame:
    """SC-11, MP-19: a YAML list item a stage (ord, text), in the stages' order; short lists in flow style, texts of several lines as blocks."""
    children = tree.linked(stages).where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("children"))
    text = lambda c: F.when(F.col(c).isNull(), "null").when(F.contains(F.col(c), F.lit("\n")), F.concat(F.lit("|-\n    "), F.replace(c, F.lit("\n"), F.lit("\n    ")))).otherwise(_quoted(F.col(c)))
    flow = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("children", F.array().cast("array<string>")), _quoted), ", "), F.lit("]"))
    parts = [F.lit("- id: "), text("id"), F.lit("\n  title: "), text("title"), F.lit("\n  description: "), text("description"), F.lit("\n  parent: "), text("parent"),
             F.lit("\n  crosscut: "), F.coalesce("crosscut", F.lit(False)).cast("string"), F.lit("\n  children: "), flow, F.lit("\n")]
    return stages.join(children, "id", "left").select("ord", F.concat(*parts).alias("text"))


def _scalar(text: str):
    text = text.strip()
    if text.startswith('"'):
        return json.loads(text)
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    if text.startswith("["):
        return [_scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]]+)""", text[1:-1]) if x.strip()]
    return {"null": None, "~": None, "": None, "true": True, "false": False}.get(text, text)


def yaml_items(text: str) -> list[dict]:
    """The mappings of a YAML list in the form that `skeleton_yaml` and like dumpers write: scalars, flow and block lists of scalars, block texts."""
    items: list[dict] = []
    lines, k = text.split("\n"), 0
    while k < len(lines):
        m = re.match(r"(\s*)(- )?([\w-]+):(?:\s+(.*))?$", lines[k])
        k += 1
        if not m:
            continue
        if m[2]:
            items.append({})
        if not items:
            continue
        depth, value = len(m[1]) + 2 * bool(m[2]), (m[4] or "").rstrip()
        if re.fullmatch(r"[|>][-+]?", value):
            own = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
                own.append(lines[k])
                k += 1
            cut = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
            whole = ("\n" if value[0] == "|" else " ").join(x[cut:] for x in own).rstrip("\n ")
            items[-1][m[3]] = whole if value.endswith("-") else whole + "\n"
        elif not value and k < len(lines) and re.match(rf"\s{{{depth},}}- ", lines[k]):
            own = []
            while k < len(lines) and (x := re.match(rf"\s{{{depth},}}- (.*)$", lines[k])) and not re.match(r"\s*- [\w-]+:\s", lines[k] + " "):
                own.append(_scalar(x[1]))
                k += 1
            items[-1][m[3]] = own
        else:
            items[-1][m[3]] = _scalar(value)
    return items


def load_skeleton(docs: DataFrame) -> DataFrame:
    """SC-11: stages (doc, ord, id, title, description, parent, crosscut, children) of YAML documents (doc, text); a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc", "ord", "id", "title", "description", "parent", "crosscut", "children"]
        for b in batches:
            rows = [
                (doc, k, i.get("id"), i.get("title"), i.get("description"), i.get("parent"), bool(i.get("crosscut")), i.get("children") or [])
                for doc, text in zip(b["doc"], b["text"], strict=True) for k, i in enumerate(yaml_items(text or ""))
            ]
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInPandas(run, "doc string, ord long, id string, title string, description string, parent string, crosscut boolean, children array<string>")


# --- bundles, records, cards -------------------------------------------------------


def load_bundle(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """SC-15: the tables of a folder by name; an error names every one that is missing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = {}
    for n in names:
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet")
        there[n] = where.getFileSystem(conf).exists(where)
    missing = [n for n in names if not there[n]]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC-23: cached records, a JSON file each: files whose name starts with an underscore and broken ones are left out."""
    raw = spark.read.schema(f"{schema}, _corrupt STRING").option("recursiveFileLookup", True).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    kept = raw.withColumn("record", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)).where(~F.col("record").startswith("_"))
    return kept.where("_corrupt IS NULL").drop("_corrupt")


def changed_cards(cards: DataFrame, stored: DataFrame) -> DataFrame:
    """SK-5: cards that the store (file, content_sha1) lacks or has otherwise, with their hash, so that a run appends only those."""
    hashed = cards.withColumn("content_sha1", F.sha1(F.to_json(F.struct(*sorted(cards.columns)))))
    return hashed.join(stored.select("file", "content_sha1"), ["file", "content_sha1"], "left_anti")


def append_cards(cards: DataFrame, path: str, version: int) -> None:
    """SK-5: append cards under a version; `latest_cards` reads the last of each file."""
    cards.withColumn("version", F.lit(version)).write.mode("append").json(path)


def latest_cards(stored: DataFrame) -> DataFrame:
    """The card of highest version of each file."""
    rest = [c for c in stored.columns if c not in ("file", "version")]
    return stored.groupBy("file").agg(F.max_by(F.struct(*rest), "version").alias("c")).select("file", "c.*")


# --- recovery and handbook JSON ----------------------------------------------------


def recover_registers(docs: DataFrame) -> DataFrame:
    """SC-21: registers (doc, ord, id, semantics, stages) from rendered tables whose rows are id, semantics and stage ids."""
    rows = markdown.table_rows(docs, "reg")
    stages = F.regexp_extract_all(F.coalesce(F.try_element_at("cells", F.lit(2)), F.lit("")), F.lit(r"(?:stage|side|crosscut)-[\w.]+"), 0)
    return rows.select("doc", F.col("line").cast("long").alias("ord"), "id", F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit("")).alias("semantics"), stages.alias("stages"))


def recover_summaries(docs: DataFrame) -> DataFrame:
    """SC-21: (doc, id, summary): the first paragraph below each stage heading."""
    return markdown.skeleton(docs).select("doc", "id", F.col("description").alias("summary"))


def document_json(stages: DataFrame, units: DataFrame) -> DataFrame:
    """SK-11: a JSON text a stage (ord, json) with its functions (stage, ord, qualname, text) in order; a stage without any has an empty list."""
    own = units.groupBy(F.col("stage").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "qualname", "text"))).alias("functions"))
    rows = stages.join(own, "id", "left").withColumn("functions", F.coalesce("functions", F.array().cast("array<struct<ord: bigint, qualname: string, text: string>>")))
    return rows.select("ord", F.to_json(F.struct("id", "title", "description", "parent", "functions")).alias("json"))


def document_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SK-11, back: (stages, units) of `document_json`; broken texts are left out."""
    d = docs.withColumn("d", F.from_json("json", "id string, title string, description string, parent string, functions array<struct<ord: bigint, qualname: string, text: string>>")).where("d.id IS NOT NULL")
    return d.select("ord", "d.id", "d.title", "d.description", "d.parent"), d.select(F.col("d.id").alias("stage"), F.explode("d.functions").alias("f")).select("stage", "f.*")
