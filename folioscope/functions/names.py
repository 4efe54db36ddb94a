"""Names, keys and ids on the driver and in tasks; ``columns`` has the same as Column functions."""

from __future__ import annotations

import re
from typing import Any

import regex

#: Fixed value: the white space of ECMAScript's ``\s``.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_WS = re.compile(WS)
_PARTS = regex.compile(r"[\p{L}\p{N}]+")


def camel_key(name: str) -> str:
    """Words of letters and digits: the first in lower case, the others capitalised; empty if there are none."""
    words = _PARTS.findall(name)
    return "".join(w.lower() if k == 0 else w[:1].upper() + w[1:].lower() for k, w in enumerate(words))


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")


def words(text: str) -> list[str]:
    return [w for w in _WS.split(text) if w]


def utf16(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def base36(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + out
    return out or "0"


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[k : k + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return h


def text_rule_id(kind: str, scope: str, spec: Any) -> str:
    """text/kind/scope/hash, where the hash is of the needle and of the flags that change what it matches."""
    fold = "i" if spec.ignore_case else ""
    if spec.regex is not None:
        key = f"regex|{spec.regex}|{fold}"
    else:
        needle = " ".join(words(spec.pattern)) if spec.normalize else spec.pattern
        key = f"pattern|{'n' if spec.normalize else 'x'}|{needle}|{fold}"
    return f"text/{kind}/{scope}/{base36(fnv1a(key))}"


def needle_regex(spec: Any) -> str:
    """The regular expression of a text rule, in the dialect that Java and Python share; empty: matches nothing."""
    if spec.regex is not None:
        return translate(spec.regex)
    if not spec.normalize:
        return re.escape(spec.pattern)
    return f"{WS}+".join(re.escape(w) for w in words(spec.pattern))


def translate(pattern: str) -> str:
    """An ECMAScript pattern: ``$`` is the very end, and ``\\s`` has its wider meaning."""
    out, k, inside = "", 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two[0] == "\\":
            out += {"\\s": WS[1:-1] if inside else WS, "\\S": "[^" + WS[1:] if not inside else "\\S", "\\d": "0-9" if inside else "[0-9]", "\\/": "/"}.get(two, two)
            k += 2
            continue
        if two[0] == "[" and not inside:
            inside = True
        elif two[0] == "]" and inside:
            inside = False
        out += "(?![\\s\\S])" if two[0] == "$" and not inside else two[0]
        k += 1
    return out


def did_you_mean(name: str, known: list[str]) -> str | None:
    """The nearest known name at an edit distance of one or two."""
    best = min(((_distance(name, x), x) for x in known), default=(9, ""))
    return best[1] if 1 <= best[0] <= 2 else None


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]
