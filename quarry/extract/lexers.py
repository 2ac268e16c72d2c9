"""Lexers of Go, Rust, C# and JavaScript: one alternation each, blanks and comments before a token in its match.

Kinds: w word, s string or character, n number, b bracket, o operator, nl line
break where it matters, life lifetime, pp preprocessor line, t template mark,
cm opening of a nested comment, bad anything that fits no token.
"""

from __future__ import annotations

import re

def number() -> str:
    return r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])[\d_]*|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)"


def lexer(blank: str, *parts: tuple[str, str]) -> re.Pattern[str]:
    """Blanks before a token belong to its match, so that they cost no match of their own."""
    return re.compile(f"(?:{blank})*+(?:" + "|".join(f"(?P<{k}>{p})" for k, p in parts) + r"|(?P<end>\Z))", re.S)


WORD = r"[^\W\d]\w*"

GO = lexer(
    r"[ \t\r]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/",
    ("w", WORD),
    ("nl", r"\n\s*|/\*.*?\*/"),
    ("s", r'`[^`]*`|"(?:[^"\\\n]|\\[^\n])*"' + r"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"),
    ("n", number() + r"i?(?!\w)"),
    ("b", r"[()\[\]{}]"),
    ("o", r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!.,;:~]"),
    ("bad", r"."),
)
RUST = lexer(
    r"\s+|//[^\n]*",
    ("cm", r"/\*"),
    ("s", r'b?c?r(?P<h>#*)".*?"(?P=h)|[bc]?"(?:[^"\\]|\\.)*"' + r"|b?'(?:[^'\\\n\t\r]|\\(?:[nrt0\\'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'"),
    ("life", r"'[^\W\d]\w*(?!')"),
    ("w", r"(?:r#)?" + WORD),
    ("n", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?(?!\w)"),
    ("b", r"[()\[\]{}]"),
    ("o", r"<<=|>>=|\.\.=|\.\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|=>|::|\.\.|[-+*/%&|^<>=!.,;:?@#$]"),
    ("bad", r"."),
)
CS = lexer(
    r"\s+|//[^\n]*|/\*.*?\*/",
    ("s", r'\$*(?P<q>"{3,}).*?(?P=q)(?!")|(?:@\$|\$@|@)"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\[^\n])*"(?:u8)?' + r"|'(?:[^'\\\n]|\\(?:['\"\\0abefnrtv]|x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"),
    ("w", r"@?" + WORD),
    ("n", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?(?!\w)"),
    ("pp", r"\#[^\n]*"),
    ("b", r"[()\[\]{}]"),
    ("o", r"<<=|>>=|\?\?=|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|=>|::|\?\?|\.\.|[-+*/%&|^<>=!.,;:?~]"),
    ("bad", r"."),
)
JS = lexer(
    r"[ \t\r\v\f\u00a0\ufeff]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/",
    ("nl", r"\n\s*|/\*.*?\*/"),
    ("w", r"\#?(?:[$]|[^\W\d])[$\w]*"),
    ("s", r'"(?:[^"\\\n]|\\(?:\r\n|.))*"' + r"|'(?:[^'\\\n]|\\(?:\r\n|.))*'"),
    ("t", r"`"),
    ("n", number() + r"n?(?![\w$])"),
    ("b", r"[()\[\]{}]"),
    ("o", r">>>=|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|===|!==|\.\.\.|=>|\*\*|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^<>=!.,;:?~]"),
    ("bad", r"."),
)
