"""Leftmost non-overlapping spans of fixed kinds in a text, in time linear in its length."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

#: kind:start:end, code points, end exclusive.
Span = tuple[str, int, int]


def write_spans(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_HEX = re.compile(r"[0-9a-f]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def assigns(text: str, raw_lower: bytes) -> Iterator[Span]:
    """Secrets assigned to a telling name. raw_lower: the text's bytes, A-Z lower-cased."""
    if any(w in raw_lower for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                yield "assign", m.start(), m.end()


def access_ids(text: str) -> Iterator[Span]:
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", m.start(), m.end()


def hex_runs(text: str) -> Iterator[Span]:
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """From each @ to the left as far as the local part goes, to the right over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
