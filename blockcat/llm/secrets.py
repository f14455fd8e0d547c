"""Secret scan with multipart credential linking.

Three kinds of finding stand alone: ``assign`` (a value given to a name such as password or token), ``access`` (access
key ids) and ``hex`` (long hexadecimal runs). Three more are weak: ``id`` (a user, account or client name given a value,
or a short access key id), ``key`` (a word of mixed characters and high entropy) and ``url`` (an endpoint). A weak one is
reported only with its complement near it: an identifier with a secret, a secret with an identifier or an endpoint, an
endpoint with both an identifier and a secret. Near means: within ``reach`` characters and in the same scope (text
between blank lines).

The linking is an interval join, each candidate's interval widened by the reach and cut to its scope, against the
sorted intervals of each part. All parts of a credential lie in one document, so it runs where the text is: nothing is
shuffled, and a lookup takes the logarithm of the document's candidates, however many there are.

Defined cases: null and empty texts have no findings; a text of any length is read whole; offsets are code points, ends
exclusive; equal spans of one kind are listed as often; a repeated row is reported as often; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 300
#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "id", "key", "url")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}", re.ASCII)
_ID_WORDS = ("user", "login", "account", "client", "access_key")
_ID = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}", re.ASCII)
_URL = re.compile(r"""\b(?:https?|ftp|ssh|s3|amqps?|redis|mysql|postgres(?:ql)?|mongodb(?:\+srv)?|jdbc:[a-z]+)://[^\s"'<>]+""", re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The findings that stand alone: (start, end, kind)."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _mixed(word: str) -> bool:
    """Characters of at least three sorts, at 3.5 bits or more each."""
    sorts = sum(bool(re.search(x, word, re.ASCII)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]"))
    n = len(word)
    return sorts >= 3 and -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.5


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that count only beside a complement. One that only overlaps a base finding is a part like any other; one
    that lies wholly within a base finding is left out, as that finding is itself a part."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ID_WORDS):
        out += [(m.start(), m.end(), "id") for m in _ID.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "id") for m in _ACCESS.finditer(text) if 8 <= m.end() - m.start() < 20]
    out += [(m.start(), m.end(), "key") for m in _KEY.finditer(text) if _mixed(m.group())]
    if "://" in text:
        out += [(m.start(), m.end(), "url") for m in _URL.finditer(text)]
    base = sorted(base)
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    return [x for x in out if (i := bisect.bisect_right(starts, x[0])) == 0 or ends[i - 1] < x[1]]


class _Part:
    """Sorted intervals; asks whether any meets a given one."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts, self.reach = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))

    def meets(self, lo: int, hi: int) -> bool:
        i = bisect.bisect_left(self.starts, hi)
        return i > 0 and self.reach[i - 1] > lo


def linked(text: str, base: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak candidates that have their complement within reach and scope."""
    if not weak:
        return []
    blanks = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    ends, starts = [a for a, _ in blanks], [z for _, z in blanks]
    both = base + weak
    ids, keys, urls = (_Part([x for x in both if x[2] in kinds]) for kinds in (("access", "id"), ("assign", "hex", "key"), ("url",)))
    out = []
    for x in weak:
        i, j = bisect.bisect_right(starts, x[0]), bisect.bisect_left(ends, x[1])
        lo, hi = max(x[0] - reach, starts[i - 1] if i else 0), min(x[1] + reach, ends[j] if j < len(ends) else len(text))
        if {"id": keys.meets(lo, hi), "key": ids.meets(lo, hi) or urls.meets(lo, hi), "url": ids.meets(lo, hi) and keys.meets(lo, hi)}[x[2]]:
            out.append(x)
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (weak findings reported)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = linked(text, base, weak_spans(text, base), reach)
                n = Counter(k for _, _, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
