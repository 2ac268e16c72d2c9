"""Finding the source files of a tree: pruned folders, ignore patterns, sizes, languages, and why a file is left out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import classify_language

# Folders never entered, and the largest file read.
SKIP_DIRS = ["vendor", "node_modules", ".git", "dist", "build", ".idea", ".vscode"]
MAX_BYTES = 500 * 1024


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, size, content of the files below a folder, in any file system Spark reads; it leaves out hidden and empty ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.lit("^" + re.escape(root.rstrip("/")) + "/"), F.lit(""))
    return raw.select("path", rel.alias("rel_path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, int, str]]:
    """(folder, line number, pattern) of all .gitignore files below a folder.

    Spark's readers pass over hidden files, so the file system lists them; only
    the ignore files themselves, small and few, are read on the driver.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(path).getPath().toString().rstrip("/")
    out, files = [], fs.listFiles(path, True)
    while files.hasNext():
        f = files.next().getPath()
        if f.getName() == ".gitignore":
            folder = f.getParent().toString()[len(base) :].strip("/")
            stream = fs.open(f)
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            stream.close()
            out += [(folder, i, line) for i, line in enumerate(text.splitlines())]
    return out


class IgnoreRules:
    """Git's ignore patterns: anchored or not, folders, negation, `*`, `?`, `[...]` and `**`; the last match wins.

    Built from (folder, line number, pattern) rows of all ignore files, sorted
    by depth of the folder, folder and line. A file below an ignored folder
    stays ignored, whatever a later negation says.
    """

    def __init__(self, rules: list[tuple[str, int, str]]) -> None:
        self.rules = []
        for folder, _, line in sorted(rules, key=lambda r: (r[0].count("/") + (r[0] != ""), r[0], r[1])):
            p = self._parse(folder.strip("/"), line.rstrip("\r\n"))
            if p:
                self.rules.append(p)

    @staticmethod
    def _parse(folder: str, line: str) -> tuple[re.Pattern[str], bool, bool] | None:
        text = re.sub(r"(?<!\\) +$", "", line)
        if not text.strip() or text.startswith("#"):
            return None
        negated = text.startswith("!")
        text = text[1:] if negated else text
        text = text[1:] if text[:1] == "\\" and text[1:2] in "#!" else text
        only_dir = text.endswith("/")
        text = text.rstrip("/") if only_dir else text
        anchored = "/" in text
        text = text.lstrip("/")
        out, i = "", 0
        while i < len(text):
            c = text[i]
            if text.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
                continue
            if text.startswith("/**", i) and i + 3 == len(text):
                out, i = out + "/.+", i + 3
                continue
            if c == "*":
                out += "[^/]*"
                while text.startswith("*", i + 1):
                    i += 1
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in text[i + 2 :]:
                j = text.index("]", i + 2)
                body = text[i + 1 : j].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", j
            elif c == "\\" and i + 1 < len(text):
                i += 1
                out += re.escape(text[i])
            else:
                out += re.escape(c)
            i += 1
        root = re.escape(folder) + "/" if folder else ""
        return re.compile(f"{root}{'' if anchored else '(?:.*/)?'}{out}"), negated, only_dir

    def matches(self, path: str, is_dir: bool) -> bool:
        for pattern, negated, only_dir in reversed(self.rules):
            if (is_dir or not only_dir) and pattern.fullmatch(path):
                return not negated
        return False

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        if ".git" in parts:
            return True
        return any(self.matches("/".join(parts[:i]), True) for i in range(1, len(parts))) or self.matches(path, False)


def ignore_filter(rules: list[tuple[str, int, str]]):  # noqa: ANN201
    """A vectorised predicate on relative paths; the patterns of a tree are few."""
    known = IgnoreRules(rules)

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: known.ignored(p) if isinstance(p, str) else False)

    return ignored


def skip_reason(rel: Column, size: Column, language: Column, ignored: Column | None = None, include_tests: bool = False, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is left out, the first that holds: pruned, ignored, ignore_file, test, size, unclassified; null if it is kept.

    Files below a pruned folder are never visited and count nowhere. A null size counts as 0.
    """
    dirs = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    name = F.element_at(F.split(rel, "/"), -1)
    out = F.when(F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS])), "pruned")
    if ignored is not None:
        out = out.when(ignored, "ignored")
    out = out.when(name == ".gitignore", "ignore_file")
    if not include_tests:
        out = out.when(name.endswith("_test.go"), "test")
    return out.when(F.coalesce(size, F.lit(0)) > max_bytes, "size").when(language == "", "unclassified")


def discover(files: DataFrame, ignored: Column | None = None, include_tests: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (rel_path, size, content, ...) with `found_language` and `skip_reason`."""
    rows = files.withColumn("found_language", classify_language(F.col("rel_path"), F.col("content")))
    return rows.withColumn("skip_reason", skip_reason(F.col("rel_path"), F.col("size"), F.col("found_language"), ignored, include_tests, max_bytes))


def discovery_stats(found: DataFrame, keys: list[str]) -> DataFrame:
    """Kept files and those left out by reason; pruned ones are not counted."""
    r = F.col("skip_reason")
    return found.filter(r.isNull() | (r != "pruned")).groupBy(*keys).agg(
        F.count_if(r.isNull()).alias("total"),
        F.count_if(r.isNotNull()).alias("skipped"),
        F.count_if(r == "size").alias("by_size"),
        F.count_if(r == "ignored").alias("by_ignore"),
        F.count_if(r == "test").alias("by_test"),
    )
