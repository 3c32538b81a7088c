"""Secret scans with multipart credential linking.

A scan of each whole text yields parts: base secrets (``assign``, ``access``,
``hex``), which always stand, and weak candidates: ``token`` (a long mixed run
that may be a secret), ``identifier`` (a user or client name) and ``endpoint``
(a service address). Parts of one scope (a paragraph between blank lines) are
interval-joined: those that begin within ``REACH`` code points of each other
meet. A weak token is reported where an identifier is near, a weak identifier
where a secret is near, an endpoint where both are near. The user and password
of a URL are an identifier and a token that complete each other.

A scope never leaves its text, so the join is made where the text is: the starts
of a scope's identifiers and secrets are sorted, and each weak part looks its
interval up in them. No pairs are built, and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: In the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "token", "identifier", "endpoint")
REACH = 400

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_USERS = "|".join(map(_any_case, ("username", "user", "login", "account")))
IDENTIFIER = re.compile(rf"""(?<![A-Za-z])(?:{_USERS}|{_any_case('client')}_?{_any_case('id')})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}}""")
ENDPOINT = re.compile(r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ssh)://[^\s"'<>]+""")
#: User and password of a URL: up to the last @ before its path.
USERINFO = re.compile(r"""(?<=[A-Za-z0-9])://([^\s"'<>/?#:@]*):([^\s"'<>/?#]+)@""")
_BLANK = re.compile(r"\n[ \t\r]*\n")

SPANS = "array<struct<start:int,ord:int,kind:string,end:int,cls:string,weak:boolean>>"


def parts_of(text: str | None) -> list[tuple[str, str, bool, int, int, bool, int]]:
    """The parts of a text: kind, class, whether weak, start, end (code points), whether its complement is in the same URL, scope."""
    if not text:
        return []
    found: list[tuple[str, str, bool, int, int]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", "secret", False, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", "identifier", False, *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", "secret", False, *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for *_, a, b in found)
    ends = [max(b for _, b in base[: i + 1]) for i in range(len(base))] if len(base) < 64 else _running_max(base)
    paired: set[tuple[str, int, int]] = set()
    for m in USERINFO.finditer(text) if "://" in text else ():
        for kind, cls, (a, b) in (("identifier", "identifier", m.span(1)), ("token", "secret", m.span(2))):
            i = bisect_right(base, (a, len(text))) - 1
            if a < b and (i < 0 or ends[i] < b):
                paired.add((kind, a, b))
                found.append((kind, cls, True, a, b))
    inside = sorted((a, b) for kind, a, b in paired if kind == "token")
    for m in TOKEN.finditer(text):
        a, b = m.span()
        i = bisect_right(inside, (a, len(text))) - 1
        if i >= 0 and inside[i][1] >= b:
            continue
        i = bisect_right(base, (b, -1)) - 1
        said = m[0]
        if (i < 0 or ends[i] <= a) and any(c.isdigit() for c in said) and any(c.isupper() for c in said) and any(c.islower() for c in said):
            found.append(("token", "secret", True, a, b))
    if any(cls == "secret" for _, cls, *_ in found):  # else no weak part can be complete
        found += [("identifier", "identifier", True, *m.span()) for m in IDENTIFIER.finditer(text)]
        if "://" in text:
            found += [("endpoint", "endpoint", True, *m.span()) for m in ENDPOINT.finditer(text)]
    if not found:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    return [(*p, (p[0], p[3], p[4]) in paired, bisect_right(blanks, p[3])) for p in found]


def _running_max(spans: list[tuple[int, int]]) -> list[int]:
    out, most = [], 0
    for _, b in spans:
        most = max(most, b)
        out.append(most)
    return out


def linked(parts: list[tuple[str, str, bool, int, int, bool, int]], reach: int = REACH) -> list[tuple[int, int, str, int, str, bool]]:
    """The reported of a text's parts, as sorted (start, ord, kind, end, cls, weak): base ones, and weak ones with their complements within reach in the same scope. ord is the kind's place in KINDS."""
    starts: dict[tuple[int, str], list[int]] = defaultdict(list)
    for _, cls, _, a, _, _, scope in sorted(parts, key=lambda p: p[3]):
        starts[scope, cls].append(a)

    def meets(a: int, scope: int, cls: str) -> bool:
        there = starts.get((scope, cls), [])
        i = bisect_left(there, a - reach)
        return i < len(there) and there[i] <= a + reach

    wanted = {"token": ("identifier",), "identifier": ("secret",), "endpoint": ("identifier", "secret")}
    return sorted((a, KINDS.index(kind), kind, b, cls, weak) for kind, cls, weak, a, b, paired, scope in parts if not weak or paired or all(meets(a, scope, c) for c in wanted[kind]))


def find_secrets(text: Column, reach: int = REACH) -> Column:
    """The reported spans of each whole text, sorted: (start, ord, kind, end, cls, weak). Null and empty texts have none; rows with equal texts have equal spans."""

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "ord", "kind", "end", "cls", "weak")
        for texts in batches:
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in linked(parts_of(x), reach)] for x in texts], dtype=object)

    return spans(text)


def without_secrets(text: Column, mark: str = "[SECRET]", reach: int = REACH) -> Column:
    """Each text with its reported spans replaced by mark (overlapping ones by a single mark); endpoints, which hold no secret by themselves, stay. Null texts stay null."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x if not x else _cut(x, [(s[0], s[3]) for s in linked(parts_of(x), reach) if s[2] != "endpoint"], mark) for x in texts], dtype=object)

    return cut(text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each reported span of text replaced by mark: see without_secrets(). Every row and column stays, whatever their names; nothing is shuffled."""
    return docs.withColumn(text, without_secrets(F.col(text), mark))


def _cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end in spans:  # by start
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all reported spans, of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", find_secrets(F.col("text")).alias("spans"))
    base = F.filter("spans", lambda s: ~s["weak"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
