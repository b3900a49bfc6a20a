"""Secret scans: keywords by one Aho-Corasick automaton, anchored expressions at the hits, checksums inside the tokens.

A text is scanned as UTF-8 with A-Z lowered by one automaton that holds every keyword; an expression is tried only
where its keyword starts, anchored there, on the bytes as they are. Runs of hexadecimal digits have no keyword: their
hits are places where a class map of the bytes (digit or not) holds a run of the least length. Tokens of the checked
kinds carry a checksum of their own, and only those whose checksum holds are reported.

Kinds, in their order: ``assign`` (a credential's name, a separator, a value of 6 characters or more), ``access``
(access key ids of 20 characters or more), ``hex`` (24 digits or more); then, beyond these, ``prefixed`` (tokens
``ghp_ gho_ ghu_ ghs_ ghr_ npm_``: 30 characters and their CRC-32 in base 62), ``xprv`` (extended private keys: Base58
with a double SHA-256 check), ``bech32`` (``nsec1`` and ``AGE-SECRET-KEY-1`` keys with the Bech32 check). Within a kind
matches are leftmost and do not overlap; one that is too short still uses up its characters.

Cases: a null or empty text has no span; a match may follow any character, also a letter; repeated rows are scanned one
by one; a text of any length is scanned whole (its bytes and a lowered copy stand in memory); ties of two kinds at one
start follow the order of the kinds; an empty table gives no rows; other columns pass through as ``row``.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_rows

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "prefixed", "xprv", "bech32")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# Keywords, shapes and alphabets of public token formats.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "prefixed": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "xprv": ("xprv",),
    "bech32": ("nsec1", "age-secret-key-1"),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

SHAPES = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "prefixed": re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})"),
    "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}"),
    "bech32": re.compile(rb"(nsec|AGE-SECRET-KEY-)1([a-zA-Z0-9]{58})"),
}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HEX = bytes(120 if chr(c) in "0123456789abcdef" else 46 for c in range(256))


def _digits(number: int, alphabet: bytes, width: int) -> bytes:
    out = bytearray()
    for _ in range(width):
        number, rest = divmod(number, len(alphabet))
        out.append(alphabet[rest])
    return bytes(out[::-1])


def checked_prefixed(body: bytes, check: bytes) -> bool:
    return _digits(zlib.crc32(body), BASE62, 6) == check


def checked_base58(token: bytes) -> bool:
    """82 bytes whose last four are the start of the double SHA-256 of the others."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes(96, "big")[-82:]
    return number < 256**82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def checked_bech32(prefix: bytes, body: bytes) -> bool:
    """The polynomial check of a string that is wholly lower or upper case."""
    if body not in (body.lower(), body.upper()) or prefix != (prefix.lower() if body == body.lower() else prefix.upper()):
        return False
    prefix, values = prefix.lower(), [BECH32.find(c) for c in body.lower()]
    if min(values) < 0:
        return False
    state = 1
    for v in [*(c >> 5 for c in prefix), 0, *(c & 31 for c in prefix), *values]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for bit, factor in enumerate(BECH32_GENERATOR):
            if top >> bit & 1:
                state ^= factor
    return state == 1


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= LEAST_VALUE
    if kind == "access":
        return len(m[0]) >= LEAST_ACCESS
    if kind == "prefixed":
        return checked_prefixed(m[1], m[2])
    return checked_base58(m[0]) if kind == "xprv" else checked_bech32(m[1], m[2])


def automaton():
    """All keywords; a hit gives the kind and the keyword's length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans_of(text: str | None, keywords) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the kinds."""
    if not text:
        return []
    raw = text.encode("utf-8")
    found: list[tuple[int, int, int]] = []
    used = dict.fromkeys(KINDS, 0)
    # No keyword of a kind holds another of that kind, so their hits come in the order of their starts.
    for end, (kind, length) in keywords.iter(raw.translate(_LOWER).decode("latin-1")):
        start = end - length + 1
        if start >= used[kind] and (m := SHAPES[kind].match(raw, start)):
            good = _holds(kind, m)
            if good or kind in BASE_KINDS:
                used[kind] = m.end()
            if good:
                found.append((start, KINDS.index(kind), m.end()))
    digits, least, at = raw.translate(_HEX), b"x" * LEAST_HEX, 0
    while (at := digits.find(least, at)) >= 0:
        m = SHAPES["hex"].match(raw, at)
        found.append((at, KINDS.index("hex"), m.end()))
        at = m.end()
    found.sort()
    if found and len(raw) != len(text):
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        return [(KINDS[k], int(points[a]), int(points[b])) for a, k, b in found]
    return [(KINDS[k], a, b) for a, k, b in found]


def scan(df: DataFrame, text: Column | str, keep: Column | None = None) -> DataFrame:
    """``row`` and ``spans``: an array of (kind, start, end), offsets in code points, the end exclusive."""

    def run(batch, state=[]):  # noqa: B006  one automaton a worker
        if not state:
            state.append(automaton())
        found = [spans_of(t, state[0]) for t in batch["text"]]
        return {"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]}

    return map_rows(df, run, {"text": text}, "spans array<struct<kind:string,start:bigint,end:bigint>>", keep)


def listed(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
