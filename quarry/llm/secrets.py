"""Credentials in source text: where they stand, and what is none.

A candidate is a literal near an assignment-like context: a name that says
password, token or key; a command-line flag; an Authorization header; the
user part of a URL; the arguments of a login call. Its text is segmented into
dictionary words; what the words leave unexplained decides. Plain words
("changeme", "token expired") leave nothing and are no secrets. Known hash
formats count only where the name says that the value is a key. Without a
context only tokens count that carry their issuer's prefix, and signed tokens.
"""

from __future__ import annotations

import re

from quarry.llm.words import residual

# Parts of names that say that the value is a credential.
_NAME = r"(?:[\w.-]*?(?:pass(?:word|wd|phrase|wort|code)?|pwd|secret|token|api[_-]?key|apikey|credentials?|auth|contrase[nñ]a|mot_de_passe|(?:access|signing|private|secret|encryption|master|shared|account|service)[_-]?key|[_-]pw|seed|hmac_key))(?:[_-]?(?:hash|id))?"
_NAME_AT = rf"(?<![\w-]){_NAME}(?![\w-])"
#: Names that hold credential words but count, name or describe something.
_NOT_NAME = re.compile(r"(?i)(?:max|min|num|count|n)_?tokens?$|tokeniz|tokens$|author|(?:_|-)(?:hash|id)$|passed|passing|bypass|compass|passenger|oauth_?(?:url|host)$|(?:checksum|digest|fingerprint|etag|sha\d+|md5)(?:[_-]?token)?$")
_VALUE = r"[^\s\"'`<>]{6,}"
#: Wrappers that only convert the literal they hold.
_WRAP = r"(?:(?:\[\]byte|bytes\.fromhex|fromhex|hex!|mustHex|Some|String::from|bytes|b64decode|Buffer\.from|SecretStr|str)\s*\(\s*)?"
_QUOTED = r"(?:[@bfru$]{0,2})(?P<q>[\"'`])(?P<v>(?:(?!(?P=q)).)+?)(?P=q)"

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----.*?-----END \1-----", re.S)
_RULES = [
    # name = "value", name: "value", "name": "value", name := []byte("value"), const name: &str = "value", NAME "value"
    re.compile(rf"(?i)(?P<name>{_NAME_AT})[\"'`]?\]?\s*(?::\s*&?(?:'static\s+)?\w+(?:<\w+>)?\s*=|\bstring\s*=|:=|=>|={{1,2}}|:|,|\s)\s*{_WRAP}{_QUOTED}"),
    # <add key="Name" value="value" />
    re.compile(rf"(?i)(?:key|name)\s*=\s*[\"'](?P<name>{_NAME})[\"']\s+value\s*=\s*{_QUOTED}"),
    # NAME=value, name: value to the end of the line or the next separator
    re.compile(rf"(?im)(?:^|[;?&,\s\"'])(?P<name>{_NAME_AT})(?:=|[ \t]*:[ \t]+|[ \t]+=[ \t]+)(?P<v>[^\s\"'`<>;&,(){{}}\[\]]{{4,}})(?=[;&,\"'`]|[ \t]*\*/|[ \t]*\r?$|[ \t]*\Z)"),
    # --password value, --token=value, -pvalue, sshpass -p value
    re.compile(rf"(?i)--(?P<name>{_NAME})[= ](?P<v>{_VALUE}?)(?=[\s\"',]|$)"),
    re.compile(r"\bsshpass\s+-p\s*(?P<v>[^\s\"'`]{4,})"),
    re.compile(r"\b(?:mysql|mysqldump|mysqladmin|psql)\b[^\n|]*?\s-p(?P<v>[^\s\"'`$=][^\s\"'`]{3,})"),
    # old login ...: user / value, temp pw is value
    re.compile(r"(?i)\b(?:login|credentials?)\b[^\n:]*:\s*[\w.-]+\s*/\s*(?P<v>\S{6,})"),
    re.compile(r"(?i)\b(?:pw|password|passwd|passphrase|token|secret)\s+(?:is|was)\s+(?P<v>[^\s,;\"'`]{6,})"),
]
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@\"'`]*:(?P<v>[^\s/@\"'`]+)@")
_HEADER = re.compile(r"(?i)\b(?P<scheme>bearer|basic)[ \t]+(?P<v>[A-Za-z0-9+/_.~=-]{8,})")
_CALL = re.compile(r"(?i)\b(?:\w*login|connect|PlainAuth|basic_?auth|NetworkCredential|\w*Credentials?|(?:static|creds?)\.New|authenticate)\s*\((?P<args>[^\n]*)")
_LITERAL = re.compile(r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)")
_COMPARE = re.compile(rf"==\s*{_QUOTED}[^\n]*(?://|#)[^\n]*?{_NAME_AT}", re.I)
_HEXKEY = re.compile(r"(?i)\b(?:hmac|seed|sign\w*|\w*key)\b[^\n]*?(?:mustHex|hex!|fromhex|unhex|hex\.DecodeString|hex::decode)\s*\(\s*[\"'](?P<v>[0-9a-f]{32,})[\"']")
_AKIA = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")
_JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PREFIXED = re.compile(r"(?<![\w./+-])(?:[a-z]{2,10}(?:[-_](?:live|test|prod|proj|pat|key|sec))?[-_.])(?P<tail>[A-Za-z0-9]{20,})(?![\w/+=-])")

_HOLDER = re.compile(r"(?i)^(?:[x*.•#0-]+|<.*>|\[.*\]|\$\{.*\}?|\{\{.*|\{.*\}|%[sdv({].*|\$\(?\w+\)?|%\w+%|![A-Za-z]*|null|none|nil|true|false|undefined|string|required|optional)$")
#: Words of placeholders; a value that holds one is a secret only if much more than words is left of it.
_STAND_IN = re.compile(r"(?i)redacted|your|example|dummy|sample|placeholder|changeme|change[-_]me|todo|fixme|insert|replace")
#: Names whose value may be all digits or look like a host name.
_PASS = re.compile(r"(?i)pass|pwd|pw$|contrase|mot_de_passe|secret")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_HASHED = re.compile(r"(?i)^(?:sha\d*[-:]|md5[-:]|h1:|\$2[aby]\$|\$argon2|\$pbkdf2|W/|data:)")
_HOST = re.compile(r"(?i)^(?:[\w-]+\.)+[a-z]{2,12}(?::\d+)?$")
_CODE = re.compile(r"^[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+$|^[\w.]+\(|^&?\w+\[")

#: Characters that words must leave unexplained in a value that holds a placeholder's word, and in one that looks like a host name; digits of a password.
STAND_IN_LEAST, HOST_LEAST, DIGITS_LEAST = 10, 4, 8

#: One expression of the RE2 dialect that is true of every text with a candidate: cheap, and wider than the rules.
SIEVE = (
    r"(?i)pass|pwd|[_-]pw|secret|token|api[_-]?key|credential|auth|contrase|mot_de_passe|access[_-]?key|signing|private|\bpw\b|seed|hmac|login|connect|bearer|basic[ \t]|akia|asia[0-9a-z]{16}|eyj|encryption|master|shared[_-]?key|account[_-]?key|service[_-]?key|secret|://[^/\s:@]*:[^/\s@]+@|\b[a-z]{2,10}(?:[-_](?:live|test|prod|proj|pat|key|sec))?[-_.][a-z0-9]{20,}|mysql|psql|static\.new|creds?\.new|musthex|hex!|fromhex|unhex|hex\.decodestring|hex::decode"
)


def _secret(value: str, words: dict[str, float], least: int, name: str = "password") -> bool:
    """A value in a credential's place is a secret unless it holds a place, names a look-up, or is made of plain words.

    name: what the value is assigned to. Digits alone and host names count only
    where the name says password or secret and words leave much unexplained.
    """
    if len(value) < 6 or _HOLDER.match(value) or _UUID.match(value) or _HASHED.match(value):
        return False
    if _STAND_IN.search(value):
        least = max(least, STAND_IN_LEAST)
    elif value.isdigit():
        return len(value) >= DIGITS_LEAST and _PASS.search(name) is not None
    elif _HOST.match(value):
        if not _PASS.search(name) and not _random(value):
            return False
        least = max(least, HOST_LEAST)
    return residual(value, words) >= least


def _random(tail: str) -> bool:
    """Capitals, small letters and digits mixed, as a generator draws them."""
    return any(c.isdigit() for c in tail) and any(c.isupper() for c in tail) and any(c.islower() for c in tail)


def find_secrets(text: str, words: dict[str, float], least: int = 2) -> list[tuple[int, int]]:
    """Spans of the credentials in `text`, in order and without overlap.

    words: see `quarry.llm.words.dictionary`. least: characters that the words
    must leave unexplained in a value with a context.
    """
    spans: list[tuple[int, int]] = []
    blocked: list[tuple[int, int]] = []
    for m in _PEM.finditer(text):
        (spans if "PRIVATE KEY" in m[1] else blocked).append(m.span())
    taken = spans + blocked

    def add(a: int, b: int) -> None:
        if a < b and not any(a < y and x < b for x, y in taken):
            spans.append((a, b))
            taken.append((a, b))

    for m in _JWT.finditer(text):
        add(*m.span())
    for m in _AKIA.finditer(text):
        add(*m.span())
    for m in _URL.finditer(text):
        v = m["v"]
        if not _HOLDER.match(v) and len(v) >= 3 and not v.startswith(("%", "{", "$", "<")):
            add(*m.span("v"))
    for m in _HEADER.finditer(text):
        v = m["v"]
        if m["scheme"].lower() == "basic":
            if residual(v, words) >= 4:
                add(*m.span("v"))
        elif not _HOLDER.match(v) and not _CODE.match(v) and residual(v, words) >= 4:
            add(*m.span("v"))
    for m in _HEXKEY.finditer(text):
        add(*m.span("v"))
    for rule in _RULES:
        for m in rule.finditer(text):
            if "name" in rule.groupindex and _NOT_NAME.search(m["name"]):
                continue
            bare = "q" not in rule.groupindex
            if bare and _CODE.match(m["v"]) and not (_random(m["v"]) and residual(m["v"], words) >= HOST_LEAST and m["v"][-1] != "("):
                continue
            if _secret(m["v"], words, least, m["name"] if "name" in rule.groupindex else "password"):
                add(*_inside(m, text))
    for m in _CALL.finditer(text):
        last = None
        for x in _LITERAL.finditer(m["args"]):
            if x["v"]:
                last = x
        if last is not None and "://" not in last["v"] and _secret(last["v"], words, least):
            at = m.start("args")
            add(at + last.start("v"), at + last.end("v"))
    for m in _COMPARE.finditer(text):
        if _secret(m["v"], words, least):
            add(*m.span("v"))
    for m in _PREFIXED.finditer(text):
        if _random(m["tail"]) and residual(m["tail"], words) >= 8:
            add(*m.span())
    return sorted(spans)


def _inside(m: re.Match[str], text: str) -> tuple[int, int]:
    """The value without an authorization scheme before it."""
    a, b = m.span("v")
    s = re.match(r"(?i)(?:bearer|basic|token)\s+", text[a:b])
    return (a + s.end(), b) if s else (a, b)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<REDACTED_SECRET_%d>") -> str:
    """The text with each distinct secret replaced by its own mark, numbered by first appearance; all else stays."""
    seen: dict[str, str] = {}
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], seen.setdefault(text[a:b], mark % (len(seen) + 1))]
        at = b
    return "".join([*out, text[at:]])
