"""Secrets in texts, confirmed by structure.

Plain patterns give the base spans. Beyond them, base64 and hexadecimal runs are decoded and reported
only if what they hold parses to the last byte: nested DER lengths of a key, the length-prefixed
fields of an SSH key, a PEM block around either, or the header of a signed token.

Everything happens within one text, in one pass, without a shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerproof.llm import common

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
KEYWORDS = ("passw", "secret", "token", "api")
# a run is one match of the plain pattern; shorter ones fail its length and take nothing else along
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\\-]*")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
KINDS = ("assign", "access", "hex", "pem", "der", "sshkey", "signed")
BASE_KINDS = KINDS[:3]
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
MIN_KEY_BYTES = 24
DEEPEST = 12

FOUND = (
    "struct<n_assign: long, n_access: long, n_hex: long, base_sha256: string, spans: string, confirmed: int>"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return spans


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run of either alphabet, padding optional."""
    run = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and contents if ``data`` is DER values and nothing else."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if n == 0 or n > 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills the bytes, whose constructed values nest without a remainder, and that
    holds what keys hold: a version or modulus (INTEGER), an algorithm (OBJECT IDENTIFIER), or a bit
    or octet string, at least two of these."""
    if len(data) < MIN_KEY_BYTES or data[0] != 0x30:
        return False
    seen, work = set(), [(data, 0)]
    while work:
        part, depth = work.pop()
        items = der_items(part)
        if items is None or depth > DEEPEST or (depth == 0 and len(items) != 1):
            return False
        for tag, content in items:
            seen.add(tag)
            if tag == 0x02 and not content or tag == 0x06 and not content:
                return False
            if tag & 0x20:
                work.append((content, depth + 1))
    return len(seen & {0x02, 0x03, 0x04, 0x06}) >= 2 or (0x02 in seen and len(data) >= 64)


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields to the last byte, the first one a key type; or the private key format."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        data = data[len(magic) :]
        fields = 0
        while fields < 3 and len(data) >= 4:
            size = int.from_bytes(data[:4], "big")
            if size > len(data) - 4:
                return False
            data, fields = data[4 + size :], fields + 1
        return fields == 3 and len(data) >= 4
    at, first = 0, None
    fields = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        if first is None:
            first = data[at + 4 : at + 4 + size]
        at, fields = at + 4 + size, fields + 1
    return first is not None and first.startswith(SSH_TYPES) and fields >= 2


def _object(run: str) -> dict | None:
    data = decoded(run)
    if not data or data[:1] != b"{":
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def pem_spans(text: str) -> list[tuple[int, int, str]]:
    """Blocks between a BEGIN mark and the END mark of the same label that comes next. Marks are found
    in one pass, so headers without an end cost no more than other text."""
    spans, begun = [], None
    for mark in PEM_MARK.finditer(text):
        if mark[1] == "BEGIN":
            begun = mark
            continue
        if begun is not None and begun[2] == mark[2] and PEM_BODY.fullmatch(text, begun.end(), mark.start()):
            # in strings of other formats line ends are written as escapes
            block = text[begun.end() : mark.start()].replace("\\r", "").replace("\\n", "\n")
            # header lines of an encrypted block are no base64
            data = decoded("".join(x for x in block.strip().splitlines() if ":" not in x))
            enciphered = "ENCRYPTED" in block and data is not None and len(data) >= MIN_KEY_BYTES
            if data and (enciphered or is_der_key(data) or is_ssh_key(data)):
                spans.append((begun.start(), mark.end(), "pem"))
        begun = None
    return spans


def signed_spans(text: str) -> list[tuple[int, int, str]]:
    """Header, payload and signature, parted by dots, wherever they begin in a dotted run."""
    spans = []
    for m in DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        starts = []
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        while i + 2 < len(parts):
            # the first character of an encoded "{" is always this one
            head = _object(parts[i]) if parts[i][:1] == "e" and len(parts[i]) >= 8 and len(parts[i + 1]) >= 4 else None
            if head is not None and isinstance(head.get("alg"), str) and _object(parts[i + 1]) is not None:
                spans.append((starts[i], starts[i + 2] + len(parts[i + 2]), "signed"))
                i += 3
            else:
                i += 1
    return spans


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    spans = pem_spans(text) if "-----BEGIN " in text else []
    if "." in text:
        spans += signed_spans(text)
    inside = sorted(s[:2] for s in spans)
    known = set(spans)
    for pattern in (ENCODED, HEX):
        nth, until = 0, -1  # runs come in order, so what lies around them is found by going along
        for m in pattern.finditer(text):
            while nth < len(inside) and inside[nth][0] <= m.start():
                until = max(until, inside[nth][1])
                nth += 1
            if m.start() < until:
                continue
            run, data = m[0], None
            if pattern is HEX or re.fullmatch(r"[0-9A-Fa-f]+", run):
                if len(run) % 2 == 0 and len(run) >= 2 * MIN_KEY_BYTES:
                    data = bytes.fromhex(run)
            else:
                data = decoded(run)
            if not data:
                continue
            kind = "sshkey" if is_ssh_key(data) else "der" if is_der_key(data) else None
            if kind and (*m.span(), kind) not in known:
                known.add((*m.span(), kind))
                spans.append((*m.span(), kind))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered)


def find(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in common.texts_of(text):
        base, more = base_spans(t), confirmed_spans(t)
        count = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        rows.append((*count, digest, joined(base + more), len(more)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "confirmed"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and how many were
    confirmed by structure. One row for each row of ``docs``; a missing text is an empty one."""
    return docs.select("doc_id", F.pandas_udf(find, FOUND)("text").alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced; overlapping spans become one mark."""

    @F.pandas_udf("string")
    def covered(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            if not isinstance(t, str):
                out.append(None)
                continue
            at, parts = 0, []
            for a, b, _ in sorted(base_spans(t) + confirmed_spans(t)):
                if b <= at:
                    continue
                if a >= at:
                    parts += [t[at:a], mark]
                at = b
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", covered("text"))
