"""Secrets in texts: fixed patterns, and literals assigned to names that sound secret.

Texts are lexed for name-literal pairs of source and configuration syntax (=, :=, :, =>, quoted keys,
declaration keywords, quoted or bare values, sums of literals and names).  Constants propagate: a literal
bound to a harmless name counts under every name it is passed on to.  A literal's score is the
sensitivity of the best name that it reaches plus what its form tells.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")

_PAIR = re.compile(r"""(?<![\w$.-])([A-Za-z_$][\w$.-]*)["'`]?[ \t]*(?::[ \t]*[A-Za-z_][\w<>\[\]]*[ \t]*(?==[^=>]))?(:=|=>|=(?![=~])|:(?![:/]))[ \t]*""", re.A)
_TERM = re.compile(r"""(?P<q>["'`])(?P<lit>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<name>[A-Za-z_$][\w$.]*(?![\w$.+/=-]))|(?P<bare>[^\s"'`,;(){}\[\]<>]+)""", re.A)
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|<>|&)[ \t]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)
#: What a name's parts say about it, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "signature": 0.5, "private": 0.5, "access": 0.4, "key": 0.5, "salt": 0.5, "pin": 0.4,
}
PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|-+|none|null|nil|true|false|test|changeme|example|placeholder|password|secret|token|your[\w-]*|todo|undefined|\$\{.*|\{\{.*|%\w+%?|<.*)\Z", re.I)
THRESHOLD = 1.0


def sensitivity(name: str) -> float:
    """How much a target name speaks of a secret: its parts' weights added, 1 at most."""
    parts = [p.lower() for p in _PART.findall(name.rpartition(".")[2] or name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined}))


def form(literal: str) -> float:
    """What a literal's form says: from -1 (placeholder, prose, too short) to about 0.6."""
    if len(literal) < 6 or any(c.isspace() for c in literal) or PLACEHOLDER.match(literal):
        return -1.0
    n, counts = len(literal), Counter(literal)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(0.3, 0.08 * entropy) + 0.1 * (classes - 1)


def lex(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(target name, spans of its literals, names it refers to) of each assignment, in order."""
    out = []
    for m in _PAIR.finditer(text):
        spans, names, at = [], [], m.end()
        while t := _TERM.match(text, at):
            if t["lit"] is not None:
                spans.append(t.span("lit"))
            elif t["name"] is not None:
                names.append(t["name"])
                if not spans and len(names) == 1 and m[2] in (":", "="):
                    spans.append(t.span("name"))  # a bare word may also be a configuration value
            else:
                spans.append(t.span("bare"))
            plus = _PLUS.match(text, t.end())
            if not plus:
                break
            at = plus.end()
        if spans or names:
            out.append((m[1], spans, names))
    return out


def named(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose names, own or propagated, make them likely secrets."""
    if "=" not in text and ":" not in text:
        return []
    pairs = lex(text)
    reach: dict[str, float] = {}
    for name, _, _ in pairs:
        reach[name] = max(reach.get(name, 0.0), sensitivity(name))
    uses = [(name, other) for name, _, names in pairs for other in names if other in reach and other != name]
    changed = bool(uses)
    while changed:  # a constant is as sensitive as the most sensitive name it flows into
        changed = False
        for name, other in uses:
            if reach[name] > reach[other]:
                reach[other], changed = reach[name], True
    found = set()
    for name, spans, names in pairs:
        known = any(n in reach for n in names)
        for a, b in spans:
            literal = text[a:b]
            if known and literal in reach:
                continue  # a reference, not a value
            if reach[name] >= 0.5 and reach[name] + form(literal) >= THRESHOLD:
                found.add((a, b))
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def _join(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = Counter(kind for _, kind, _ in base)
    spans = _join(base + [(a, "named", b) for a, b in named(text)])
    return n["assign"], n["access"], n["hex"], hashlib.sha256(_join(base).encode()).hexdigest(), spans


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    spans are kind:start:end in code points (end exclusive) by start, then kind.  A null text is empty and
    has none; null ids and repeated rows are kept as they are; further columns are ignored.  One pass over
    the texts, no shuffle; memory holds one batch.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            got = [scan_text(t if isinstance(t, str) else None) for t in batch["text"]]
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_assign": cols[0], "n_access": cols[1], "n_hex": cols[2], "base_sha256": cols[3], "spans": cols[4]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, FOUND).withColumnRenamed("doc_id", id_col)


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """`docs` with every found span replaced by `mark`."""

    def run(batches):
        for batch in batches:
            texts = []
            for t in batch[text_col]:
                if isinstance(t, str):
                    merged: list[tuple[int, int]] = []
                    for a, b in sorted([(a, b) for a, _, b in base_spans(t)] + named(t)):
                        if merged and a < merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                        else:
                            merged.append((a, b))
                    for a, b in reversed(merged):
                        t = t[:a] + mark + t[b:]
                texts.append(t)
            batch[text_col] = texts
            yield batch

    return docs.mapInPandas(run, docs.schema)
