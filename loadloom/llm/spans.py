"""Span finders for personal data and secrets, and their digests. Offsets are code points, ends exclusive."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from hashlib import sha256
from itertools import accumulate

Span = tuple[str, int, int]

PERSONAL_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
#: A leftmost match always starts where its run of digits starts, so later starts needn't be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @ outwards, which finds the leftmost matches in one pass even through very long words."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            back = text[floor:at][::-1]
            start = at - _LOCAL.match(back).end()
            if start < at:
                found.append(("email", start, m.end()))
                floor = m.end()
            else:
                floor = at + 1
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))
    return found


def personal(text: str) -> list[Span]:
    """Base spans of personal data, by start, then kind as listed."""
    found = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return in_order(found, PERSONAL_KINDS)


def secrets(text: str) -> list[Span]:
    """Base spans of secrets, by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(found, SECRET_KINDS)


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank.get(s[0], len(kinds)), s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return sha256(joined(spans).encode()).hexdigest()


# Structural confirmation of secrets

#: The armour of a PEM block; between the lines may stand headers, and line feeds may be escaped, as in JSON or env files.
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
_LINE_END = re.compile(r"(?:\\r)?\\n|\r\n|\n|\r")
_HEADER = re.compile(r"[A-Za-z0-9-]{1,40}:")
_BASE64_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Base64 in either alphabet, also wrapped over lines, and hexadecimal in either case.
_RADIX64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:(?:\\n|\r?\n)[A-Za-z0-9+/_-]+)*={0,2}")
_RADIX16 = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-fA-F]{2}){16,}(?![0-9A-Fa-f])")
_WRAP = re.compile(r"\\n|\r?\n")
_OPENSSH = b"openssh-key-v1\0"
#: Object identifiers of key algorithms in PKCS #8 (fixed values): RSA, EC, Ed25519, X25519, DSA.
_KEY_OIDS = tuple(map(bytes.fromhex, ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401")))


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run (either alphabet, padding optional), or nothing."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Length of the value whose length octets start at ``at``, and where the value starts; nothing if it would pass ``end``."""
    if at >= end:
        return None
    first = data[at]
    if first < 0x80:
        size, start = first, at + 1
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + 1 + n > end:
            return None
        size, start = int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n
    return (size, start) if start + size <= end else None


def der_tree(data: bytes, at: int, end: int, depth: int = 8) -> list | None:
    """Tags and contents of the values that fill ``data[at:end]`` exactly; constructed ones are read down to their leaves."""
    found = []
    while at < end:
        tag = data[at]
        if tag & 0x1F == 0x1F or (head := der_length(data, at + 1, end)) is None:
            return None
        size, start = head
        if tag & 0x20:
            inner = der_tree(data, start, start + size, depth - 1) if depth else None
            if inner is None:
                return None
            found.append((tag, inner))
        else:
            found.append((tag, data[start : start + size]))
        at = start + size
    return found


def der_kind(data: bytes) -> str | None:
    """``private`` for the structures of private keys, ``other`` for any other well-formed SEQUENCE (public keys, certificates)."""
    if len(data) < 16 or data[0] != 0x30 or (tree := der_tree(data, 0, len(data))) is None or len(tree) != 1:
        return None
    parts = tree[0][1]
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and len(parts[0][1]) == 1 and parts[0][1][0] <= 1:
        if tags[:3] == [0x02, 0x30, 0x04] and algorithm(parts[1][1]):  # PKCS #8: version, algorithm, key
            return "private"
        if tags[:2] == [0x02, 0x04] and 16 <= len(parts[1][1]) <= 66 and set(tags[2:]) <= {0xA0, 0xA1}:  # EC: version, key
            return "private"
        if len(parts) >= 9 and set(tags[:9]) == {0x02}:  # RSA: version, modulus, exponents, primes, exponents, coefficient
            return "private"
        if len(parts) == 6 and set(tags) == {0x02}:  # DSA: version, three parameters, public, private
            return "private"
    if tags[:2] == [0x30, 0x04] and len(parts) == 2 and algorithm(parts[0][1]):  # PKCS #8, encrypted
        return "private"
    return "other"


def algorithm(parts: list) -> bool:
    """The algorithm of a key, or of its encryption (PKCS #5 and #12)."""
    if not parts or parts[0][0] != 0x06:
        return False
    oid = parts[0][1]
    return oid in _KEY_OIDS or oid.startswith((bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")))


def wire_strings(data: bytes, at: int, most: int) -> tuple[list[bytes], int] | None:
    """Up to ``most`` length-prefixed strings from ``at`` on, and where they end; nothing if one passes the end."""
    found = []
    while len(found) < most:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if n > len(data) - at:
            return None
        found.append(data[at : at + n])
        at += n
    return found, at


def ssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that the data starts with: cipher, key derivation, its options, a number of keys, then as many
    public keys and one private part."""
    if not data.startswith(_OPENSSH) or (head := wire_strings(data, len(_OPENSSH), 3)) is None:
        return None
    names, at = head
    keys = int.from_bytes(data[at : at + 4], "big")
    if not (names[0] and names[1] and 1 <= keys <= 16) or (rest := wire_strings(data, at + 4, keys + 1)) is None:
        return None
    return rest[1] if len(rest[0][-1]) >= 32 else None


def key_kind(data: bytes | None) -> str | None:
    """``der`` or ``ssh`` for a private key in that encoding."""
    if not data:
        return None
    return "ssh" if ssh_length(data) == len(data) else "der" if der_kind(data) == "private" else None


def signed_token(header: str, payload: str) -> bool:
    """The header is a JSON object that names an algorithm, and the payload decodes to a JSON object."""
    try:
        h, p = json.loads(decoded(header) or b""), json.loads(decoded(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def armoured(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """PEM blocks of private keys, and the places of all PEM blocks. The label must name a private key; the body must decode to one, or,
    where headers say that it is encrypted, to whole cipher blocks."""
    found, blocks, at = [], [], 0
    while m := _BEGIN.search(text, at):
        closing = f"-----END {m[1]}-----"
        following = text.find("-----BEGIN ", m.end())
        end = text.find(closing, m.end(), following if following >= 0 else len(text))
        if end < 0:
            at = m.end()
            continue
        at = end + len(closing)
        blocks.append((m.start(), at))
        if m[1].endswith("PRIVATE KEY") and private_body(text[m.end() : end]):
            found.append(("pem", m.start(), at))
    return found, blocks


def private_body(inside: str) -> bool:
    lines = [x.strip() for x in _LINE_END.split(inside)]
    headers = [x for x in lines if _HEADER.match(x)]
    body = [y for x in lines if x and not _HEADER.match(x) for y in x.split()]
    if not body or not all(_BASE64_LINE.fullmatch(x) for x in body):
        return False
    data = decoded("".join(body))
    if data is None:
        return False
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers):
        return len(data) >= 16 and len(data) % 8 == 0
    return key_kind(data) is not None


def run_keys(run: str) -> list[Span]:
    """Private keys in a base64 run that may be wrapped over lines. A key starts with a line, and its own lengths tell where it ends, so
    each line is tried once and must end a key exactly."""
    lines, ends, at = [], [], 0  # the lines with their places, and how many characters stand up to each one's end
    for m in [*_WRAP.finditer(run), None]:
        lines.append((at, m.start() if m else len(run)))
        at = m.end() if m else at
    whole = "".join(run[a:b] for a, b in lines).rstrip("=")
    ends = list(accumulate(min(b, len(run.rstrip("="))) - a for a, b in lines))
    found, at = [], 0
    while at < len(lines):
        before = ends[at - 1] if at else 0
        need = key_chars(whole, before) if whole[before : before + 1] in ("M", "b") else 0  # a SEQUENCE, or "openssh"
        last = bisect_left(ends, before + need) if need else len(ends)
        kind = key_kind(decoded(whole[before : before + need])) if last < len(ends) and ends[last] == before + need else None
        if kind:
            found.append((kind, lines[at][0], lines[last][1]))
            at = last
        at += 1
    return found


def key_chars(whole: str, at: int) -> int:
    """Base64 characters, without padding, of the key that starts at ``at`` by its own account, or 0."""
    head = decoded(whole[at : at + 8])
    if head is None:
        return 0
    if head[:1] == b"\x30" and len(head) > 5:
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        if n > 4:
            return 0
        size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    elif _OPENSSH.startswith(head):
        rest = whole[at:]
        size = ssh_length(decoded(rest[: len(rest) // 4 * 4]) or b"") or ssh_length(decoded(rest) or b"") or 0
    else:
        return 0
    return -(-size * 4 // 3)


def confirmed(text: str, base: list[Span]) -> list[Span]:
    """Spans that decode to something with the structure of a private key or signed token: pem, jwt, der, ssh.

    Candidates are the method's own: PEM blocks, tokens, base64 (also wrapped over lines) and hexadecimal of either case. Public
    keys, certificates and other data of the same encodings are parsed and not reported, nor what stands in a block of another label.
    """
    found, taken = armoured(text) if "-----BEGIN " in text else ([], [])
    if "eyJ" in text:
        tokens = [("jwt", m.start(), m.end()) for m in _TOKEN.finditer(text) if signed_token(m[1], m[2])]
        found, taken = found + tokens, sorted(taken + [(a, b) for _, a, b in tokens])
    starts = [a for a, _ in taken]
    free = lambda a: not (k := bisect_right(starts, a)) or taken[k - 1][1] <= a
    for m in _RADIX16.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and free(m.start()) and (k := key_kind(bytes.fromhex(m[0]))):
            found.append((k, m.start(), m.end()))
    for m in _RADIX64.finditer(text):
        if free(m.start()):
            found += [(k, m.start() + a, m.start() + b) for k, a, b in run_keys(m[0])]
    return found
