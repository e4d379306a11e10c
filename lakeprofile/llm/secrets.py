"""Finds secrets in texts: three fixed patterns, and literals that source or configuration syntax gives to a sensitive name.

The lexer reads ``name = literal`` pairs as programming languages, shells, JSON, YAML and INI files write them. A name may be
given another name; such constants are followed to the literal they stand for, over any number of names: to what the name was
given last before its use or, where it is given nothing before, last in the text. A literal is reported if the name it reaches
and its own make-up score high enough together: a password called ``x`` counts once ``db_password = x`` is read. Names and
literals may have any length.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run's leftmost match is the whole run
)
KINDS = ("assign", "access", "hex", "named")

# Fixed weights: how sensitive a part of a name is.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "credential": 0.8, "credentials": 0.8,
    "bearer": 0.8, "signature": 0.5, "private": 0.5, "auth": 0.5, "salt": 0.5, "key": 0.5, "apikey": 1.0, "api": 0.3, "access": 0.3,
    "client": 0.2, "session": 0.3, "encryption": 0.5, "signing": 0.5, "webhook": 0.3, "pin": 0.4,
}
THRESHOLD = 0.5
_NAME_FIRST = frozenset(string.ascii_letters + "_$")
_NAME_CHARS = _NAME_FIRST | frozenset(string.digits + ".-")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>#]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z")
_JOIN = re.compile(r"""["'`][ \t]*\+[ \t]*["'`]""")
_OPERATOR = re.compile(r"[:=]")
_HINTS = r"change_?me|example|placeholder|your[_-]|xxx|\*\*\*|<.*>|\$\{|\{\{"
_WORDS = r"none|null|true|false|undefined|password|secret|token"
_PLACEHOLDER = re.compile(rf"(?i){_HINTS}|^({_WORDS})$")
_HINT_STARTS = re.compile(r"(?i)(?=change_?me|example|placeholder|your[_-]|xxx|\*\*\*)")  # those a bare literal may hold


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    for kind, pattern, group, least in BASE:
        spans += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return spans


def _literal(text: str, at: int, bare_end: int) -> tuple[int, int, bool] | None:
    """Start, end and whether quoted, of the literal that begins at ``at``; quoted parts joined by ``+`` are one literal.

    ``bare_end`` is the end of the last bare literal: what begins inside it ends there too.
    """
    if at >= len(text):
        return None
    if text[at] not in "\"'`":
        if at < bare_end:
            return at, bare_end, False
        found = _BARE.match(text, at)
        return (at, found.end(), False) if found else None
    start, end = at + 1, None
    while at < len(text) and text[at] in "\"'`":
        quote, at = text[at], at + 1
        while at < len(text) and text[at] not in (quote, "\n"):
            at += 2 if text[at] == "\\" else 1
        if at >= len(text) or text[at] == "\n":
            return None if end is None else (start, end, True)
        end, at = at, at + 1
        while at < len(text) and text[at] in " \t":
            at += 1
        if at >= len(text) or text[at] != "+":
            break
        at += 1
        while at < len(text) and text[at] in " \t":
            at += 1
    return start, end, True


def pairs(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Names with the start and end of what they are given, and whether it is quoted."""
    bare_end = 0
    for found in _OPERATOR.finditer(text):
        at = found.start()
        before, after = text[at - 1: at], text[at + 1: at + 2]
        if after == "=" and found[0] == "=" or before in ("=", "!", "<", ">", ":") and before or found[0] == ":" and after in (":", "/"):
            if not (before == ":" and found[0] == "="):  # := assigns
                continue
        elif found[0] == ":" and after == "=":
            continue  # its = is read
        end, blanks = at, ": \t" if before == ":" else " \t"
        while end and text[end - 1] in blanks:
            end -= 1
        end -= text[end - 1: end] == "]"
        end -= text[end - 1: end] in ("\"", "'", "`")
        start = end
        while start and text[start - 1] in _NAME_CHARS:
            start -= 1
        while start < end and text[start] not in _NAME_FIRST:
            start += 1
        if start == end:
            continue
        at += 2 if after == ">" else 1
        while text[at: at + 1] in (" ", "\t"):
            at += 1
        literal = _literal(text, at, bare_end)
        if literal and literal[1] > literal[0]:
            bare_end = bare_end if literal[2] else literal[1]
            yield (text[start:end], *literal)


def name_score(name: str) -> float:
    return min(1.0, sum(NAME_WEIGHTS.get(part.lower(), 0.0) for part in set(_PARTS.findall(name))))


def _make_up(counts: Counter, size: int) -> float:
    """How much a literal of these characters looks like a secret, up to 1."""
    entropy = -math.fsum(n / size * math.log2(n / size) for n in counts.values())
    classes = any(c.isdigit() for c in counts) + any(c.isupper() for c in counts) + any(c.islower() for c in counts) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy / 3.0) * (0.4 if classes < 2 else 1.0)


def literal_score(value: str) -> float:
    """0 for placeholders, short and monotonous literals, up to 1."""
    if len(value) < 6 or any(c.isspace() for c in value) or _PLACEHOLDER.search(value):
        return 0.0
    return _make_up(Counter(value), len(value))


def bare_scores(text: str, starts: list[int], end: int) -> dict[int, float]:
    """``literal_score`` of bare literals that end together, each a tail of the longest: one pass from their end."""
    starts = sorted(starts)
    hint = max((m.start() for m in _HINT_STARTS.finditer(text[starts[0]: end])), default=-1) + starts[0]
    scores, counts, counted = {}, Counter(), end
    for start in reversed(starts):
        counts.update(text[start:counted])
        counted = start
        short = end - start < 20 and literal_score(text[start:end]) == 0.0
        scores[start] = 0.0 if short or start <= hint else _make_up(counts, end - start)
    return scores


def _reached(follows: list[int | None]) -> list[int]:
    """The last of each chain of assignments; an assignment whose names lead in a circle stays where it is."""
    reached: list[int | None] = [None] * len(follows)
    circle = -1
    for first in range(len(follows)):
        path, seen, at = [], set(), first
        while reached[at] is None and at not in seen and follows[at] is not None:
            path.append(at)
            seen.add(at)
            at = follows[at]
        last = circle if at in seen else at if reached[at] is None else reached[at]
        for i in path:
            reached[i] = last
    return [i if last is None or last == circle else last for i, last in enumerate(reached)]


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants."""
    found = list(pairs(text))
    if not found:
        return []
    longest = max(len(name) for name, _, _, _ in found)
    values = [None if quoted or end - start > longest else text[start:end] for _, start, end, quoted in found]
    given: dict[str, int] = {}  # the assignment that a name was last given something in
    follows = []
    for i, (name, _, _, _) in enumerate(found):
        follows.append(given.get(values[i]))
        given[name] = i
    reached = _reached([given.get(value) if at is None else at for value, at in zip(values, follows)])
    sensitive: dict[tuple[int, int, bool], float] = {}
    for (name, _, _, _), last in zip(found, reached):
        score = name_score(name)
        if score:
            literal = found[last][1:]
            sensitive[literal] = max(score, sensitive.get(literal, 0.0))
    spans, tails = [], defaultdict(list)
    for start, end, quoted in sensitive:
        if quoted:
            if sensitive[start, end, True] * literal_score(_JOIN.sub("", text[start:end])) >= THRESHOLD:
                spans.append((start, end, "named"))
        elif not _IDENTIFIER.match(text, start, end) or any(c.isdigit() for c in text[start:end]):  # else a name or a word
            tails[end].append(start)
    for end, starts in tails.items():
        spans += [(start, end, "named") for start, score in bare_scores(text, starts, end).items() if sensitive[start, end, False] * score >= THRESHOLD]
    return spans


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: Column) -> Column:
    """A struct of counts per fixed kind, the digest of the fixed kinds' spans, and all spans.

    Null texts count as empty: no spans. Spans are ``kind:start:end`` in code points, the end exclusive.
    """
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                text = text or ""
                base = base_spans(text)
                kinds = Counter(kind for _, _, kind in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(base + named_spans(text))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run(text)
