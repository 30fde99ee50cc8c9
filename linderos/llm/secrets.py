"""Secret scan with multipart credential linking.

Three base kinds are always reported: `assign` (a secret-like name with a value), `access` (access-key identifiers) and
`hex` (long lower-case hexadecimal runs).  Three weak kinds alone mean nothing and are reported only when complementary
parts lie in the same scope:

* `login`: a client, user or key identifier with a value; needs a secret part.
* `secret_key`: a run of 40 base64 characters or more, up to two `=` behind it included, with capitals, small letters and
  digits; needs an identifier.
* `endpoint`: a URL with scheme; needs an identifier and a secret.

A scope is a block of text between blank lines, and the interval that parts are joined over: all parts of a scope are
complementary, however far apart.  With `reach` only those are whose spans, widened by so many code points, meet.  Roles
are swept in order of position with binary search, so no pairs are listed.  Every weak span is itself subject to the same test, from strong to weak, in one fixed order: logins
and secret keys are judged against base spans and each other, endpoints against what was kept.

Positions are code points, ends exclusive.  Null text counts as empty.  Each row is scanned whole and on its own, so
repeated rows and ids give repeated results, and other columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from linderos.llm.common import spare_name

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("login", "secret_key", "endpoint")
KIND_ORDER = {kind: n for n, kind in enumerate(BASE_KINDS + WEAK_KINDS)}

_FLAGS = re.IGNORECASE | re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LEAST = 6
# A maximal run of the class of at least that length: the same as every run with the shorter ones dropped.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LOGIN = re.compile(r"""(client_?id|access_?key_?id|key_?id|user_?name|account|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", _FLAGS)
_LOGIN_NAMES = ("client", "keyid", "key_id", "username", "user_name", "account", "login")
_SECRET_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}+(?!=)")
_ENDPOINT = re.compile(r"""(?:https?|wss?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+""", _FLAGS)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str, lowered: str) -> list[Span]:
    found = []
    if any(name in lowered for name in _ASSIGN_NAMES):
        found += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def weak_spans(text: str, lowered: str) -> list[Span]:
    found = []
    if any(name in lowered for name in _LOGIN_NAMES):
        found += [Span("login", *m.span()) for m in _LOGIN.finditer(text)]
    for m in _SECRET_KEY.finditer(text):
        value = m[0]
        if any(c.isupper() for c in value) and any(c.islower() for c in value) and any(c.isdigit() for c in value):
            found.append(Span("secret_key", *m.span()))
    if "://" in text:
        found += [Span("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return found


class _Near:
    """Spans of one role, to ask whether one lies in a scope within reach of an interval."""

    def __init__(self, spans: list[Span], breaks: list[int], reach: float) -> None:
        self.breaks, self.reach = breaks, reach
        self.spans = sorted(spans, key=lambda s: s.start)
        self.starts = [s.start for s in self.spans]
        self.ends = []  # the furthest end so far: spans of different kinds may lie in each other
        furthest = -1
        for s in self.spans:
            furthest = max(furthest, s.end)
            self.ends.append(furthest)

    def meets(self, span: Span) -> bool:
        scope = bisect_right(self.breaks, span.start)
        left = self.breaks[scope - 1] if scope else 0
        right = self.breaks[scope] if scope < len(self.breaks) else float("inf")
        low, high = max(left, span.start - self.reach), min(right, span.end + self.reach)
        last = bisect_left(self.starts, high)  # spans that begin before `high` and end after `low`
        return last > 0 and self.ends[last - 1] > low


def link(base: list[Span], weak: list[Span], breaks: list[int], reach: float = float("inf")) -> list[Span]:
    """The weak spans that have their complementary parts in their scope, within reach."""
    of = lambda spans, *kinds: [s for s in spans if s.kind in kinds]
    secrets = _Near(of(base, "assign", "hex") + of(weak, "secret_key"), breaks, reach)
    identifiers = _Near(of(base, "access") + of(weak, "login"), breaks, reach)
    kept = [s for s in of(weak, "login") if secrets.meets(s)] + [s for s in of(weak, "secret_key") if identifiers.meets(s)]
    secrets = _Near(of(base, "assign", "hex") + of(kept, "secret_key"), breaks, reach)
    identifiers = _Near(of(base, "access") + of(kept, "login"), breaks, reach)
    return kept + [s for s in of(weak, "endpoint") if secrets.meets(s) and identifiers.meets(s)]


def scan(text: str | None) -> list[Span]:
    """All reported spans of one text, by start, then kind."""
    if not text:
        return []
    lowered = text.lower()
    base = base_spans(text, lowered)
    weak = weak_spans(text, lowered)
    if weak:
        weak = link(base, weak, [m.end() for m in _BLANK_LINE.finditer(text)])
    return sorted(base + weak, key=lambda s: (s.start, KIND_ORDER[s.kind], s.end))


@F.pandas_udf(ArrayType(SPAN))
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([scan(text) for text in texts], dtype=object)


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redact(text) for text in texts], dtype=object)


def redact(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by [REDACTED:kind of its first span]."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at:span.start], f"[REDACTED:{span.kind}]"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text column; empty where nothing is found."""
    return _spans(text)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced."""
    return docs.withColumn(text, _redacted(F.col(text)))


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, one row per row."""
    spans = spare_name([doc_id], "spans")
    return docs.select(F.col(doc_id).alias("doc_id"), _spans(F.col(text)).alias(spans)).withColumnRenamed(spans, "spans")
