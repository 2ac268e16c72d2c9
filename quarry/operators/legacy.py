"""Rules on lines of code, without a parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# What is called without looking at its error, as an expression of both regex dialects in use.
SAFE_CALLEES = [
    "recover", "time.Now", "copy", "append", "delete", "close", "fmt.Print", "fmt.Println", "fmt.Printf", "fmt.Fprint", "fmt.Fprintln", "fmt.Fprintf", "fmt.Sprint", "fmt.Sprintln", "fmt.Sprintf",
    "log.Print", "log.Println", "log.Printf", "atomic.AddInt", "hash.Write", "hasher.Write", "h.Write", "io.Copy", "response.Body.Close", "req.Body.Close", "res.Body.Close",
]
SAFE = r"_\s*:?=\s*(" + "|".join(c.replace(".", r"\.") for c in SAFE_CALLEES) + r")\("
# Methods that take SQL. A statement is built if it is formatted, or joined with what is no literal; placeholders speak against the latter.
DB_CALL = r"\b(Query|QueryRow|Exec|Prepare)(Context)?\s*\("
FORMATTED = DB_CALL + r"\s*fmt\.Sprintf\s*\("
JOINED = DB_CALL + r"[^)]*\"[^\"]*\"\s*\+\s*[^\"\s]"
PLACEHOLDER = r"\?\s*[,)]|\$[0-9]"


def ignored_error(line: Column) -> Column:
    """A call whose last result is assigned to the blank name, other than of a callee that cannot fail."""
    return line.rlike(r"(?:^|[,\s])_\s*:?=\s*[\w.]+\(") & ~line.rlike(SAFE)


def sql_by_concatenation(line: Column) -> Column:
    """A database call whose statement is joined with a variable or formatted from parts."""
    return line.rlike(FORMATTED) | (line.rlike(JOINED) & ~line.rlike(PLACEHOLDER))


def nil_dereference(lines: DataFrame) -> DataFrame:
    """Assignments of a result and an error whose value is used within four lines, before the error is looked at.

    lines: file_id, n, line, in order of n without gaps.
    """
    w = Window.partitionBy("file_id").orderBy("n")
    rows = lines.withColumn("v", F.nullif(F.regexp_extract("line", r"^\s*(\w+),\s*err\s*:?=", 1), F.lit("")))
    rows = rows.withColumn("after", F.array(*[F.coalesce(F.lead("line", i).over(w), F.lit("")) for i in range(1, 5)])).filter("v is not null")
    use = F.transform("after", lambda x: F.coalesce(F.regexp_like(x, F.concat(F.lit(r"\b"), F.col("v"), F.lit(r"\."))), F.lit(False)))
    check = F.transform("after", lambda x: x.contains("err != nil") | x.contains("err == nil"))
    first = lambda a: F.array_position(a, True)
    return rows.filter((first(use) > 0) & ((first(check) == 0) | (first(use) < first(check)))).select("file_id", "n", F.col("v").alias("symbol"))


def in_loops(lines: DataFrame) -> DataFrame:
    """The lines with `plain`, without literals and comments, `depth`, the braces open before the line, and `inside`, whether a loop's are among them.

    lines: file_id, n, line. A loop's head is a `for` whose line ends with its brace.
    """
    w = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.regexp_replace("line", "\"[^\"]*\"|'[^']*'|`[^`]*`|//.*$", "")
    opened, closed = F.length(F.regexp_replace(plain, r"[^{]", "")), F.length(F.regexp_replace(plain, r"[^}]", ""))
    rows = lines.withColumn("depth", F.coalesce(F.sum(opened - closed).over(w), F.lit(0)))
    rows = rows.withColumn("loop", F.when(plain.rlike(r"^\s*for\b.*\{\s*$"), F.col("depth"))).withColumn("plain", plain)
    rows = rows.withColumn("at", F.last("loop", ignorenulls=True).over(w))
    return rows.withColumn("inside", F.coalesce(F.col("depth") > F.col("at"), F.lit(False))).drop("loop", "at")


def leaks(lines: DataFrame) -> DataFrame:
    """(file_id, n, leak): timers and goroutines started in loops, and contexts whose cancel function no line of the file calls."""
    rows = in_loops(lines)
    timer = rows.filter(F.col("inside") & F.col("plain").rlike(r"\btime\.After\(")).select("file_id", "n", F.lit("timer").alias("leak"))
    started = rows.filter(F.col("inside") & F.col("plain").rlike(r"\bgo\s+(?:func|[\w.]+\s*\()")).select("file_id", "n", F.lit("goroutine").alias("leak"))
    made = rows.withColumn("name", F.regexp_extract("plain", r"(\w+)\s*:?=\s*context\.With(?:Cancel|Timeout|Deadline)\w*\(", 1)).filter("name not in ('', '_')")
    called = rows.select("file_id", F.explode(F.regexp_extract_all("plain", F.lit(r"(\w+)\(\)"), F.lit(1))).alias("name")).distinct()
    return timer.unionByName(started).unionByName(made.join(called, ["file_id", "name"], "left_anti").select("file_id", "n", F.lit("context").alias("leak")))
