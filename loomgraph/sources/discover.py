"""Source discovery (SC-1 to SC-8) and text access (SC-16 to SC-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: directories that hold no source of their own
COMMON_SKIP = (
    ".git .hg .svn node_modules vendor target build dist out __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox venv .venv env .env site-packages .idea .vscode"
).split()
#: per language: extensions in order, directories to skip, endings to drop
LANGUAGES: dict[str, dict] = {
    "go": {"ext": [".go"], "skip": [".git", "vendor"], "drop": ["_test.go"]},
    "python": {"ext": [".py"], "skip": COMMON_SKIP, "drop": []},
    "powershell": {"ext": [".ps1", ".psm1", ".psd1"], "skip": COMMON_SKIP, "drop": []},
    "rust": {"ext": [".rs"], "skip": ["target", ".git", "node_modules"], "drop": []},
    "shell": {"ext": [".sh", ".bash"], "skip": COMMON_SKIP, "drop": []},
    "starlark": {"ext": [".star", ".bzl", ".bazel"], "skip": COMMON_SKIP, "drop": []},
    "typescript": {"ext": [".ts", ".tsx"], "skip": ["node_modules", ".git", "dist", "build"], "drop": [".d.ts"]},
}


def language_table(spark: SparkSession) -> DataFrame:
    """(lang, ext, ext_ord): SC-6, the registry as a relation."""
    rows = [(lang, e, k) for lang, spec in sorted(LANGUAGES.items()) for k, e in enumerate(spec["ext"])]
    return spark.createDataFrame(rows, "lang string, ext string, ext_ord int")


def wanted(lang: Column, file: Column) -> Column:
    """Whether a path belongs to a language's sources."""
    dirs = F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)
    cond = F.lit(False)
    for name, spec in LANGUAGES.items():
        ok = ~F.arrays_overlap(dirs, F.array(*map(F.lit, spec["skip"])))
        for ending in spec["drop"]:
            ok = ok & ~file.endswith(ending)
        cond = F.when(lang == name, ok).otherwise(cond)
    return cond


def discover(spark: SparkSession, root: str, lang: str | None = None, files: list[str] | None = None) -> DataFrame:
    """Source files under a root as (lang, file, source, ord): extension order, then path; all languages alphabetically where none is named.

    files: relative paths to read instead; a missing one is an error.
    """
    load = spark.read.format("binaryFile")
    where = [f"{root}/{f}" for f in files] if files else root
    raw = (load if files else load.option("recursiveFileLookup", True)).load(where)
    base = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    rel = F.substring_index(F.regexp_replace("path", "^[a-z]+:/+", ""), base, -1)
    table = language_table(spark)
    table = table.where(F.col("lang") == lang) if lang else table
    ext = F.concat(F.lit("."), F.lower(F.substring_index(rel, ".", -1)))
    found = raw.select(rel.alias("file"), ext.alias("ext"), F.decode("content", "UTF-8").alias("source")).join(F.broadcast(table), "ext")  # a dozen rows
    found = found.where(wanted(F.col("lang"), F.col("file")))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("lang").orderBy("ext_ord", "file")) - 1
    return found.withColumn("ord", order).select("lang", "file", "source", "ord")


def excerpt(source: Column, most: int) -> Column:
    """SC-16: the whole text where most is 0 or less, else its head and a note."""
    if most <= 0:
        return source
    return F.when(F.length(source) > most, F.concat(F.substr(source, F.lit(1), F.lit(most)), F.lit("\n… (truncated)"))).otherwise(source)


def verified_range(source: Column, first: Column, last: Column, sha1: Column | None = None) -> Column:
    """SC-17: (text, error) of lines first..last, from 1; the hash must match where it is given."""
    lines = F.split(source, "\n")
    text = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")
    error = F.when(source.isNull(), "no such file").when(first < 1, "start below 1").when(last < first, "end before start").when(last > F.size(lines), "end past the file")
    if sha1 is not None:
        error = error.when(sha1.isNotNull() & (sha1 != F.sha1(text)), "hash differs")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def numbered(source: Column, first: Column, last: Column) -> Column:
    """SC-18: lines first..last with their numbers, the end clamped to the file."""
    lines = F.split(source, "\n")
    part = F.slice(lines, first, F.greatest(F.least(last, F.size(lines)) - first + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda x, i: F.format_string("%5d: %s", i + first, x)), "\n")


def load_cards(spark: SparkSession, path: str) -> DataFrame:
    """SC-10: cards from JSON files below a directory: broken ones and those without a file are left out, the last of a file by path stays."""
    schema = "file string, purpose string, role string, lifecycle string, description string, _corrupt string"
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.withColumn("at", F.col("_metadata.file_path")).where("file IS NOT NULL")
    return rows.groupBy("file").agg(F.max_by(F.struct("purpose", "role", "lifecycle", "description"), "at").alias("c")).select("file", "c.*")
