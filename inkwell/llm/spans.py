"""Character spans found in texts: base patterns, their digest and the printed form."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Sequence

Span = tuple[str, int, int]

#: Possessive and anchored forms of the contract's patterns: the same matches in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Only documents that contain one of these can hold an assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether a string of digits passes the card checksum."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost email matches, found from their @ signs."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def personal(text: str) -> list[Span]:
    """Base matches of emails, addresses, card and phone numbers."""
    out = emails(text)
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            number = digits(m[0])
            if 12 <= len(number) <= 19 and luhn(number):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def secret(text: str) -> list[Span]:
    """Base matches of assignments, access keys and hexadecimal strings."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # maximal runs of at least 32, so a shorter pattern need not be tried at every letter
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{32,}", text)]
    return out


def printed(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apart(found: Sequence[Span], base: Sequence[Span]) -> list[Span]:
    """Found spans that touch no base span nor an earlier found one."""
    starts, ends = [], []  # the base spans' union
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out: list[Span] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        before = bisect_left(starts, e) - 1  # the last base span that starts before this one ends
        if (before < 0 or ends[before] <= s) and (not out or out[-1][2] <= s):
            out.append((kind, s, e))
    return out
