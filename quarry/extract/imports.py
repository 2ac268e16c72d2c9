"""Imports of source files by the patterns of each language, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One pattern a language, the first group is the imported path.
PATTERNS = {
    "Go": r'(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$',
    "Python": r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)",
    "Rust": r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;{\n]+)",
    "C#": r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+);",
    "JavaScript": r"require\(['\"]([^'\"\n]+)['\"]\)",
}


def lines_unified(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def imports(files: DataFrame, language: str = "language", content: str = "content", keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(keys, import_path), each once a file; null contents and other languages give no row."""
    text = lines_unified(F.col(content))
    found = F.array().cast("array<string>")
    for lang, pattern in PATTERNS.items():
        found = F.when(F.col(language) == lang, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(found)
    rows = files.select(*keys, F.explode(F.array_distinct(found)).alias("import_path"))
    return rows.select(*keys, F.trim("import_path").alias("import_path")).filter("import_path <> ''").distinct()
