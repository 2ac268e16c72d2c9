"""Scalar functions on names, paths, code and text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file suffix and by file name; interpreters of a first line, in order.
LANGUAGES = {
    "Go": ["go"], "TypeScript": ["ts", "tsx"], "JavaScript": ["js", "jsx", "mjs", "cjs"], "Python": ["py", "pyw"], "Rust": ["rs"], "C": ["c", "h"], "C++": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"], "C#": ["cs"],
    "Java": ["java"], "Kotlin": ["kt", "kts"], "Lua": ["lua"], "PHP": ["php"], "Ruby": ["rb"], "Swift": ["swift"], "Shell": ["sh", "bash"], "YAML": ["yaml", "yml"], "JSON": ["json"], "TOML": ["toml"],
    "Markdown": ["md", "markdown"], "SQL": ["sql"], "Protobuf": ["proto"], "Dockerfile": ["dockerfile"], "Makefile": ["makefile"],
}
BASENAMES = {"dockerfile": "Dockerfile", "makefile": "Makefile", "gnumakefile": "Makefile"}
INTERPRETERS = [("python", "Python"), ("node", "JavaScript"), ("ruby", "Ruby"), ("bash", "Shell"), ("sh", "Shell"), ("perl", "Perl")]
# Import path to ecosystem, exact or as a prefix.
ECOSYSTEMS = [
    ("net/http", "net/http", ""), ("database/sql", "database/sql", ""), ("os/exec", "os/exec", ""), ("crypto", "", "crypto/"), ("template", "html/template", ""), ("template", "text/template", ""),
    ("filesystem", "os", ""), ("filesystem", "path/filepath", ""), ("gin", "github.com/gin-gonic/gin", ""), ("fiber", "", "github.com/gofiber/fiber/v"), ("gorm", "gorm.io/gorm", ""),
    ("flask", "flask", "flask."), ("fastapi", "fastapi", "fastapi."), ("django", "django", "django."), ("sqlalchemy", "sqlalchemy", "sqlalchemy."), ("pytorch", "torch", "torch."), ("opencv", "cv2", "cv2."),
    ("ultralytics", "ultralytics", "ultralytics."), ("aspnetcore", "", "Microsoft.AspNetCore"), ("efcore", "Microsoft.EntityFrameworkCore", "Microsoft.EntityFrameworkCore."), ("tokio", "tokio", "tokio::"),
    ("axum", "axum", "axum::"), ("actix", "actix_web", "actix_web::"), ("sqlx", "sqlx", "sqlx::"), ("diesel", "diesel", "diesel::"), ("reqwest", "reqwest", "reqwest::"), ("tonic", "tonic", "tonic::"),
]
# What marks a path as presentation layer and an import as data layer.
UPPER_LAYER = ["/handler", "/handlers", "/controller", "/controllers", "/transport", "/api/", "/http/", "/grpc/", "/rest/"]
DATA_LAYER = ["/db", "/database", "/dao", "/persistence"]
# Credential patterns, the assignment first.
CREDENTIAL_VALUE = r"(?i)((?:password|passwd|api[_-]?key|secret|token)\s*(?::=|=|:)\s*[\"'])([^\"']{8,})([\"'])"
CREDENTIALS = [
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bsk-(?:proj-)?[A-Za-z0-9_-]{16,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
]
# The mark of text left out; shares of an item and a batch in the token estimate, and of answers in the output.
TRUNCATED = "\u2026<TRUNCATED>"
ITEM_TOKENS, BATCH_TOKENS, OUTPUT_BASE, OUTPUT_EACH = 64, 32, 64, 384
LEVELS = {"critical": "error", "high": "error", "medium": "warning"}


def classify_language(path: Column, content: Column) -> Column:
    """By file name, then suffix, then the interpreter in the first 256 characters; '' if none fits."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.when(base.contains("."), F.element_at(F.split(base, r"\."), -1)).otherwise("")
    by_suffix = F.create_map(*[F.lit(x) for lang, ss in LANGUAGES.items() for s in ss for x in (s, lang)])
    by_name = F.create_map(*[F.lit(x) for kv in BASENAMES.items() for x in kv])
    first = F.substring_index(F.substring(content, 1, 256), "\n", 1)
    shebang = F.lit("")
    for word, lang in reversed(INTERPRETERS):
        shebang = F.when(first.contains(word), F.lit(lang)).otherwise(shebang)
    return F.coalesce(by_name[base], by_suffix[suffix], F.when(first.startswith("#!"), shebang).otherwise(""), F.lit(""))


def ecosystem(path: Column, known: list[tuple[str, str, str]] = ECOSYSTEMS) -> Column:
    """The ecosystem of an import path, or null."""
    out = F.lit(None).cast("string")
    for name, exact, prefix in reversed(known):
        hit = F.lit(False)
        if exact:
            hit = hit | (path == exact)
        if prefix:
            hit = hit | path.startswith(prefix)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def first_keyword(text: Column, keywords: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        out = F.when(text.contains(k), F.lit(k)).otherwise(out)
    return out


def redact(text: Column, mark: str = "<REDACTED_SECRET>") -> Column:
    """All known credential forms replaced by one mark."""
    out = F.regexp_replace(text, CREDENTIAL_VALUE, f"$1{mark}$3")
    for p in CREDENTIALS:
        out = F.regexp_replace(out, p, mark)
    return out


def last_selector(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\."), -1)


def unquote(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^[\"'`]+|[\"'`]+$", "")


def is_literal(text: Column) -> Column:
    return F.trim(text).rlike("^(?:\".*\"|'.*'|`.*`)$")


def parameterized(query: Column) -> Column:
    return query.contains("?") | query.rlike(r"\$[1-9]")


def mode_bits(literal: Column) -> Column:
    """A mode literal, octal, hexadecimal or binary, as a number; null if it is none."""
    t = F.lower(F.regexp_replace(F.trim(literal), "_", ""))
    octal = F.when(t.rlike("^0o[0-7]+$"), F.substring(t, 3, 30)).when(t.rlike("^0[0-7]+$"), F.substring(t, 2, 30))
    return (
        F.when(octal.isNotNull(), F.conv(octal, 8, 10))
        .when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 30), 16, 10))
        .when(t.rlike("^0b[01]+$"), F.conv(F.substring(t, 3, 70), 2, 10))
        .when(t.rlike("^(?:0|[1-9][0-9]*)$"), t)
        .cast("bigint")
    )


def other_writable(literal: Column) -> Column:
    return F.coalesce(mode_bits(literal).bitwiseAND(2) != 0, F.lit(False))


def limit_lines(text: Column, n: int) -> Column:
    """At most n lines, with a mark where more are left out; '' for n below 1."""
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit(f"\n{TRUNCATED}"))).otherwise(text)


def excerpt(text: Column, start: Column, end: Column, most: int) -> Column:
    """Lines start..end, at most `most`; an end before the start is the start, a start before 1 is 1; null places give null."""
    if most <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    first = F.greatest(start, F.lit(1))
    n = F.least(F.greatest(end, first) - first + 1, F.lit(most))
    return F.when(start.isNotNull() & end.isNotNull(), F.array_join(F.slice(F.split(text, "\n"), first, n.cast("int")), "\n"))


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n")))


def truncate_bytes(text: Column, n: int) -> Column:
    """The first n bytes and an ellipsis where the text is longer; a character that the limit cuts is left out."""
    cut = F.substring(text.cast("binary"), 1, n).cast("string")
    whole = F.when(F.is_valid_utf8(cut), cut).otherwise(F.regexp_replace(F.make_valid_utf8(cut), "\ufffd+$", ""))
    return F.when(F.octet_length(text) > n, F.concat(whole, F.lit("\u2026"))).otherwise(text)


def tokens_flat(text: Column, per_item: int = ITEM_TOKENS) -> Column:
    """Estimate A: a token for four bytes, and a share for the item."""
    return F.floor((F.octet_length(text) + 3) / 4) + per_item


def batch_input_tokens(items: Column) -> Column:
    """Estimate A of a batch from the sum of its items' estimates."""
    return items + BATCH_TOKENS


def batch_output_tokens(n: Column) -> Column:
    """Tokens planned for the answers to n items of a batch."""
    return n * OUTPUT_EACH + OUTPUT_BASE


def tokens_by_class(text: Column) -> Column:
    """Estimate B: the greater of half the bytes, rounded up, and twice the ASCII bytes that are no letter or digit plus the non-ASCII bytes; at most all bytes."""
    size = F.octet_length(text)
    structural = F.length(F.regexp_replace(text, r"[A-Za-z0-9]|[^\x00-\x7F]", ""))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.least(size, F.greatest(F.ceil(size / 2), 2 * structural + (size - ascii_))).cast("bigint")


def report_level(severity: Column) -> Column:
    """error, warning or note."""
    s = F.lower(F.trim(severity))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[s], F.lit("note"))


def title_metric(title: Column) -> Column:
    """The number that opens the last parentheses of a title, else 0."""
    return F.coalesce(F.regexp_extract(title, r"\((\d+)[^()]*\)[^()]*$", 1).try_cast("int"), F.lit(0))
