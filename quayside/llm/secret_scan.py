"""Secret scans by multipart credential linking.

A credential often has several parts: an access identifier, a secret and an
endpoint.  Strong parts are reported wherever they stand (an assigned secret,
an access key id, a long hexadecimal run).  Weak parts are candidates only: a
user or client id, a short or unnamed secret, a host or connection URL.  A weak
part is reported when a part of another role stands in the same scope, which is
a span of the text: two parts are in one scope when at most ``SCOPE`` code
points lie between the end of one and the start of the next (``from_ends``, as
the registered query has it), or between both starts.  A plain web address is no
endpoint of a login written as prose ("account: details"), so these two do not
complement each other; either still goes with any other part.

Texts are scanned once.  The parts become rows; each is dealt to the cells of
``SCOPE`` code points that it touches and to one cell more on either side, and
the interval join of parts is an equi-join on (document, cell) done by grouping:
a cell holds the parts within three scopes only, however long the document is.

Defined results: a null text counts as empty and has no spans; each row is
scanned on its own, also repeated rows and rows with a null id; the same span
is reported once per kind; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import spans as S

KINDS = ("assign", "access", "hex", "user", "key", "host")
#: Code points between two parts of one credential, at most.
SCOPE = 160
#: Bits a character that an unnamed secret has at least.
MIN_ENTROPY = 3.5

_USER = re.compile(r"\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.A | re.I)
_WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_SHORT_KEY = re.compile(r"\b(?:pwd|pass|password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([^\s\"']{4,})", re.A | re.I)
_NAMED_HOST = r"(?:host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?"
_HOST = re.compile(rf"\b(?:(?:{_NAMED_HOST})?[a-z][a-z0-9+.-]{{1,20}}://[^\s\"'<>]{{4,}}|{_NAMED_HOST}[A-Za-z0-9.:/_@?=&%+-]{{4,}})", re.A | re.I)
_HINTS = (b"user", b"login", b"account", b"client", b"access", b"pwd", b"pass", b"secret", b"token", b"api", b"host", b"endpoint", b"server", b"url", b"://")
#: A login as prose writes it: letters only, after a colon and a space.
_PROSE = re.compile(r"[a-z_-]+:\x20+[a-z]+\Z", re.A | re.I)
_PLAIN_URL = re.compile(r"https?://[^@?=]*\Z", re.A | re.I)
_ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "user": "id", "host": "endpoint"}


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def scan(text: str) -> tuple[list[S.Span], list[S.Span]]:
    """Strong parts, which are spans by themselves, and weak ones."""
    low = text.encode("utf-8", "surrogatepass").lower()
    strong = [*S.assigns(text, low), *S.access_ids(text), *S.hex_runs(text)]
    weak: list[S.Span] = []
    if strong or any(h in low for h in _HINTS):
        weak += [("user", m.start(), m.end()) for m in _USER.finditer(text)]
        weak += [("host", m.start(), m.end()) for m in _HOST.finditer(text)]
        weak += [("key", m.start(), m.end()) for m in _SHORT_KEY.finditer(text)]
    if strong or weak:
        for m in _WEAK_KEY.finditer(text):
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and entropy(s) >= MIN_ENTROPY:
                weak.append(("key", m.start(), m.end()))
        taken = [(a, b) for _, a, b in strong]
        weak = [w for w in set(weak) if not any(a <= w[1] < b or w[1] <= a < w[2] for a, b in taken)] if len(taken) < 64 else _free(set(weak), taken)
    return strong, weak


def is_loose(kind: str, text: str) -> bool:
    """Whether a part is a login in prose or a plain web address."""
    return bool(kind == "user" and _PROSE.match(text) or kind == "host" and _PLAIN_URL.match(text))


def _free(weak: set[S.Span], taken: list[tuple[int, int]]) -> list[S.Span]:
    """The weak parts that touch no strong one, by bisection for texts with many."""
    ends: list[tuple[int, int]] = []
    for a, b in sorted(taken):  # disjoint covers
        if ends and a < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    starts = [a for a, _ in ends]
    out = []
    for w in weak:
        i = bisect.bisect_left(starts, w[2])
        if not i or ends[i - 1][1] <= w[1]:
            out.append(w)
    return out


_PART = "struct<kind:string,role:string,start:bigint,end:bigint,strong:boolean,loose:boolean>"


def parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, parts) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.struct([("kind", pa.string()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strong", pa.bool_()), ("loose", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                text = t.as_py() or ""
                strong, weak = scan(text)
                found.append([{"kind": k, "role": _ROLE[k], "start": a, "end": b, "strong": s, "loose": is_loose(k, text[a:b])} for ps, s in ((strong, True), (weak, False)) for k, a, b in ps])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], names=["doc_id", "parts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, parts array<{_PART}>").withColumn("row", F.monotonically_increasing_id())


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, from_ends: bool = False) -> DataFrame:
    """(doc_id, spans): array<struct<kind, start, end, linked>> of each row's strong parts and linked weak parts, by start.

    ``linked`` tells whether parts of another role stand in the span's scope, which
    is counted from a part's end if ``from_ends``, else from its start.
    """
    far = "end" if from_ends else "start"
    first, last = F.expr(f"p.start div {scope}"), F.expr(f"p.{far} div {scope}")
    each = parts(docs, id_col, text_col).select("row", "doc_id", F.explode_outer("parts").alias("p"))
    # Each part stands in the cells it touches, where it is judged, and in the ones beside them, where it is a partner only.
    cells_of = F.when(F.col("p").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(first - 1, last + 1))
    cells = each.select("row", "doc_id", "p", F.explode(cells_of).alias("cell")).groupBy("row", "doc_id", "cell").agg(F.collect_list("p").alias("ps"))
    near = lambda p, q: (p["role"] != q["role"]) & ~(p["loose"] & q["loose"]) & (q["start"] - p[far] <= scope) & (p["start"] - q[far] <= scope)
    own = F.filter("ps", lambda p: F.col("cell").between(F.floor(p["start"] / scope), F.floor(p[far] / scope)))
    judged = F.transform(own, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), p["strong"].alias("strong"), F.exists("ps", lambda q: near(p, q)).alias("linked")))
    key = ("start", "end", "kind", "strong")
    one = cells.select("row", "doc_id", F.explode_outer(judged).alias("s")).groupBy("row", "doc_id", *[F.col(f"s.{c}").alias(c) for c in key]).agg(F.max("s.linked").alias("linked"))
    kept = F.when(F.col("strong") | F.col("linked"), F.struct(*key, "linked"))
    return one.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(kept)).alias("spans")).select("doc_id", "spans")


def span_text(spans: F.Column, strong_only: bool = False) -> F.Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda s: s["strong"]) if strong_only else spans
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
