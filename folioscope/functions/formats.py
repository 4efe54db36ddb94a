"""String formats of the schema language.

Each is a regular expression that Java and Python read alike, so it serves ``rlike`` and the tasks; three need code.
"""

from __future__ import annotations

import ipaddress
import re

import regex

from .names import utf16

#: What each format's name means.  Digits are [0-9], as \d takes those of other scripts in Python.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DATE = "(?:(?:[0-9]{2}[2468][048]|[0-9]{2}[13579][26]|[0-9]{2}0[48]|[02468][048]00|[13579][26]00)-02-29|[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8])))"
_TIME = "(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\\.[0-9]+)?)?"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"

PATTERNS = {
    "email": r"(?!\.)(?!.*\.\.)[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "url": r"[A-Za-z][A-Za-z0-9+.-]*:(?://)?[^\s/?#][^\s]*",
    "uuid": r"(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}|00000000-0000-0000-0000-000000000000|ffffffff-ffff-ffff-ffff-ffffffffffff)",
    "hostname": r"(?=.{1,253}\.?(?![\s\S]))[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.?",
    "datetime": rf"{_DATE}T{_TIME}Z",
    "date": _DATE,
    "time": _TIME,
    "duration": r"P(?:(?:[0-9]+W)|(?=[0-9T])(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:[.,][0-9]+)?S)?)?)",
    "ipv4": _V4,
    "cidrv4": rf"{_V4}/(?:[0-9]|[12][0-9]|3[0-2])",
    "nanoid": r"[a-zA-Z0-9_-]{21}",
    "cuid": r"[cC][^\s-]{8,}",
    "cuid2": r"[0-9a-z]+",
    "ulid": r"[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{26}",
    "base64": r"(?:(?:[0-9a-zA-Z+/]{4})*(?:(?:[0-9a-zA-Z+/]{2}==)|(?:[0-9a-zA-Z+/]{3}=))?)",
    "e164": r"\+[1-9][0-9]{6,14}",
}
CODED = ("ipv6", "cidrv6", "emoji")
NAMES = (*PATTERNS, *CODED)

_EMOJI = regex.compile(r"(?:\p{Extended_Pictographic}|\p{Emoji_Component})+")


def java_pattern(name: str) -> str:
    """The pattern of a format for ``rlike``, anchored at both ends."""
    return rf"\A(?:{PATTERNS[name]})\z"


def _v6(text: str) -> bool:
    try:
        return "%" not in text and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _cidr6(text: str) -> bool:
    host, slash, bits = text.partition("/")
    return bool(slash) and _v6(host) and bits.isascii() and bits.isdigit() and str(int(bits)) == bits and int(bits) <= 128


def matches(name: str, text: str) -> bool:
    if name in PATTERNS:
        return re.fullmatch(PATTERNS[name], text) is not None
    return {"ipv6": _v6, "cidrv6": _cidr6, "emoji": lambda t: _EMOJI.fullmatch(t) is not None}[name](text)


__all__ = ["CODED", "NAMES", "PATTERNS", "java_pattern", "matches", "utf16"]
