"""Static facts of a source tree: files with kinds and hashes, Python symbols and imports, Gherkin scenarios."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 and kind of every file below `root`; credentials and keys are listed but marked sensitive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.lower("path")
    kind = F.when(name.rlike(r"/tests?/|/test_[^/]*\.py$"), "test").when(name.endswith(".py"), "source").when(name.endswith(".feature"), "scenario").when(name.rlike(r"\.(md|rst|txt)$"), "document").when(name.rlike(r"\.(json|toml|ya?ml|ini|cfg)$"), "config").otherwise("other")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), name.rlike(r"(\.env|\.pem|\.key|credentials|secret)").alias("sensitive"), "content")


def python_facts(files: DataFrame) -> DataFrame:
    """path, fact (function, class, import, entrypoint or error), name, line for each Python file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    module = ast.parse(content)
                except (SyntaxError, ValueError) as problem:
                    rows.append((path, "error", type(problem).__name__, getattr(problem, "lineno", 0) or 0))
                    continue
                for node in ast.walk(module):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        rows.append((path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno))
                    elif isinstance(node, ast.Import):
                        rows += [(path, "import", a.name, node.lineno) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        rows.append((path, "import", node.module or ".", node.lineno))
                    elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and ast.unparse(node.test.left) == "__name__":
                        rows.append((path, "entrypoint", "__main__", node.lineno))
            yield pd.DataFrame(rows, columns=["path", "fact", "name", "line"])

    return files.select("path", "content").mapInPandas(run, "path string, fact string, name string, line long")


def scenarios(files: DataFrame) -> DataFrame:
    """path, line, title and tags of Gherkin scenarios; a feature's tags are inherited."""
    lines = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    order = Window.partitionBy("path").orderBy("line")
    tagged = lines.withColumn("own", F.when(F.col("text").startswith("@"), F.col("text"))).withColumn("above", F.lag("own").over(order))
    marked = tagged.withColumn("feature_tags", F.last(F.when(F.col("text").startswith("Feature:"), F.coalesce("above", F.lit(""))), ignorenulls=True).over(order))
    rows = marked.filter(F.col("text").rlike("^Scenario( Outline)?:"))
    tags = F.array_sort(F.array_distinct(F.filter(F.split(F.concat_ws(" ", "feature_tags", "above"), " +"), lambda t: t != "")))
    return rows.select("path", (F.col("line") + 1).cast("long").alias("line"), F.trim(F.regexp_replace("text", "^Scenario( Outline)?:", "")).alias("title"), tags.alias("tags"))


def missing_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (name, sha256) to files that are not there, or there with other bytes."""
    held = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("sha256").alias("found"))
    both = references.join(held, "name", "left")
    return both.select("name", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("bound").alias("status"))
