"""How a text ends: complete, cut, or open to evidence from the rest of the corpus."""

from __future__ import annotations

import re

# Marks that cutters leave.
_MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|truncated|cut|snip(?:ped)?|more)\s*\]|\(\s*(?:\.\.\.|…|truncated|cut off|cut|snip(?:ped)?|more|continued)\s*\)|<\s*(?:snip(?:ped)?|cut|truncated|more)\s*>|-{2,}\s*(?:snip|cut|truncated)\s*-{2,})$", re.I)
_DOTS = re.compile(r"\s*(?:\.{3,}|…)$")
_HALF = re.compile(r"(?:&(?:[a-z]{1,6}|#\w{0,5})?|�+|[\\%]u?[0-9a-fA-F]{0,3})$")
_STOP = re.compile(r"[.!?。！？](?:[\"'”’»)\]*_`]|\s»)*$")
_HALF_PATH = re.compile(r"[\w-]+/[\w/-]*\.$")
_FENCE = re.compile(r"^\s{0,3}(?:```|~~~)", re.M)
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_PATH = re.compile(r"(?<!\S)(?:[\w.-]+/)+[\w.-]*\w\.[A-Za-z]{1,5}(?!\S)")
_CODE = re.compile(r"\b[A-Z]{2,4}-(?:[A-Z]{2,4}-)?\d+\b")

#: Words of the longest line that can be complete without an end mark.
SHORT = 6


def ending(text: str) -> tuple[str, str, str] | None:
    """(verdict, unit, shape) of a text, None for a null, empty or blank one.

    verdict: complete; cut; or open, if the last line bears no end mark but may be
    whole: a list entry, signature, reference, status line. unit: that line
    without its list mark. shape: the line with numbers, codes and paths
    generalised; equal shapes at the ends of several texts speak for a whole line.
    """
    if not text:
        return None
    t = text.rstrip()
    if not t:
        return None
    tail = t[t.rfind("\n") + 1 :]
    if tail.strip() in ("```", "~~~"):
        return ("complete" if len(_FENCE.findall(t)) % 2 == 0 else "cut"), "", ""
    if _MARK.search(tail[-40:]):
        return "cut", "", ""
    if len(_FENCE.findall(t)) % 2 if "```" in t or "~~~" in t else False:
        return "cut", "", ""
    line = tail.strip()
    if _DOTS.search(line[-40:]):
        own = len(t) > len(tail) and t[: len(t) - len(tail)].endswith(("\n\n", "\n\r\n"))
        return ("open" if own and len(line.split()) <= 10 and not _LIST.match(line) else "cut"), line, line
    if _HALF.search(line[-8:]):
        return "cut", "", ""
    if _STOP.search(line[-12:]):
        return ("cut" if _HALF_PATH.search(line[-80:]) else "complete"), "", ""
    if line[0] == "|" and line[-1] == "|" and len(line) > 1:
        return "complete", "", ""
    if line[0] == "(" and line[-1] == ")":
        return "complete", "", ""
    unit = _LIST.sub("", line)
    if len(unit.split()) > SHORT or line[-1] in ",;:(/-&[{=" or _open_bracket(line):
        return "cut", "", ""
    if _LIST.match(tail):
        return "list", unit, ""
    shape = re.sub(r"\d+", "0", _CODE.sub("CODE", _PATH.sub("PATH", line)))
    return "open", unit, shape


def _open_bracket(line: str) -> bool:
    return line.count("(") > line.count(")") or line.count("[") > line.count("]")
