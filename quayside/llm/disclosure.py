"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, network addresses, payment cards
and phone numbers of the corpus, each by its normalised value.  Other words can
reveal an entity as well: a name that only ever stands beside one address gives
it away.  How much a term t tells about an entity e is measured over the whole
corpus as pointwise mutual information against the entity's own information,

    PMI(e; t) = log(p(e, t) / (p(e) p(t))),   IC(e) = -log p(e),

with document frequencies for p: a term and an entity stand together in the
documents that hold both, wherever in the text.  A term discloses e when PMI >=
``SHARE`` * IC and both stand together in at least ``MIN_TOGETHER`` documents.

Entities are removed (replaced by their kind).  A disclosing term is
generalised to its word class (a name, a number, a word), which stands beside
so many entities that it tells about none of them.  That is done wherever the
term stands, in documents without the entity too.

The first pass over the texts yields entities, the words of the documents with
entities, and the document frequencies of all words.  PMI >= share * IC means
n_term <= n_both * (n_all / n_entity) ** (1 - share), and n_both <= n_entity, so
words that are too frequent for every entity of their document are left out
before pairs are made.  The second pass finds the disclosing terms in all
texts.  Where they are few enough to be sent to every task, they are looked up
there; else a bitmap of their hashes (``BITS``, 1 MB) drops most other words at
once, the rest by an equi-join.

Defined results: a null text counts as empty and has no spans; each row is a
document of its own, also repeated rows and rows with a null id; terms that
overlap an entity are covered by it; other columns are not read.  An entity with
fewer than ``MIN_TOGETHER`` documents has no disclosing terms: a word cannot be
told from chance by them.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quayside.llm import spans as S
from quayside.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "term")
SHARE = 0.9
MIN_TOGETHER = 3
MIN_TERM_CHARS = 3
#: Distinct terms that one task of the counting pass keeps before it passes its counts on, and those of one row.
TASK_TERMS, ROW_TERMS = 200_000, 10_000
#: Bits of the bitmap of disclosing terms, and those of one of its pieces.
BITS, PIECE = 1 << 23, 1 << 15
#: Most disclosing terms, and the most code points of one, that are sent to every task (under 8 MB of text).
MOST_TERMS, TERM_CHARS = 100_000, 80
#: Parts in which the rows of one term are joined.
SALT = 16

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_FIND = (S.emails, S.ips, S.cards, S.phones)


def entities(text: str) -> list[S.Span]:
    return [s for find in _FIND for s in find(text)]


def word_class(term: str) -> str:
    """What a term is generalised to."""
    return "<number>" if term[:1].isdigit() else "<name>" if term[:1].isupper() else "<word>"


def free_words(text: str, found: list[S.Span]) -> Iterator[tuple[str, int, int]]:
    """The words that touch no span, in lower case."""
    covers: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if covers and a < covers[-1][1]:
            covers[-1][1] = max(b, covers[-1][1])
        else:
            covers.append([a, b])
    starts = [c[0] for c in covers]
    for m in _WORD.finditer(text):
        if m.end() - m.start() >= MIN_TERM_CHARS:
            i = bisect.bisect_left(starts, m.end())
            if not i or covers[i - 1][1] <= m.start():
                yield m[0].lower(), m.start(), m.end()


def terms_of(text: str, found: list[S.Span]) -> set[str]:
    if found:
        return {w for w, _, _ in free_words(text, found)}
    return {w.lower() for w in set(_WORD.findall(text)) if len(w) >= MIN_TERM_CHARS}


_SEEN = "entities array<string>, terms array<string>, counts array<struct<term:string,n:bigint>>"
_COUNT = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))


def seen_terms(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, entities, terms, counts): the distinct entities of each document and, if it has any, its words.

    Further rows have counts only: in how many documents of a task's run each word stands.
    """

    def told(entities: list, terms: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string())), pa.array(counts, _COUNT)], names=["entities", "terms", "counts"])

    def counted(counts: Counter) -> Iterator[pa.RecordBatch]:
        every = [{"term": t, "n": n} for t, n in counts.items()]
        for i in range(0, len(every), ROW_TERMS):
            yield told([None], [None], [every[i : i + ROW_TERMS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            held, words = [], []
            for t in batch.column(0):
                text = t.as_py() or ""
                found = entities(text)
                terms = terms_of(text, found)
                counts.update(terms)
                held.append(sorted({k + ":" + _normal(k, text[a:b]) for k, a, b in found}))
                words.append(list(terms) if found else [])
                if len(counts) >= TASK_TERMS:
                    yield from counted(counts)
                    counts = Counter()
            yield told(held, words, [None] * len(held))
        yield from counted(counts)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, _SEEN).withColumn("row", F.monotonically_increasing_id())


def _normal(kind: str, value: str) -> str:
    return value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit())


def disclosing_terms(docs: DataFrame, text_col: str, share: float = SHARE, together: int = MIN_TOGETHER) -> DataFrame:
    """(entity, term, bits): terms that reveal an entity over the threshold."""
    seen = stored(seen_terms(docs, text_col), "pii-seen")
    rows = seen.where(F.col("counts").isNull())
    holders = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = rows.agg(F.count(F.lit(1)).alias("n_all"))  # one row
    # The most documents that a disclosing term of the entity can stand in; the last factor is for rounding.
    most = F.col("n_entity") * F.pow(F.col("n_all") / F.col("n_entity"), F.lit(1 - share)) * F.lit(1 + 1e-9)
    known = holders.where(F.col("n_entity") >= together).join(F.broadcast(total)).where(F.col("n_all") > F.col("n_entity")).withColumn("most", most)
    held = stored(rows.select("row", F.explode("entities").alias("entity")).join(known, "entity"), "pii-held")
    reach = held.groupBy("row").agg(F.max("most").alias("reach"))
    words = rows.join(reach, "row").select("row", "reach", F.explode("terms").alias("term"))
    counts = seen.where(F.col("counts").isNotNull()).select(F.inline("counts")).groupBy("term").agg(F.sum("n").alias("n"))
    widest = known.agg(F.max("most").alias("widest"))  # one row
    rare = counts.where(F.col("n") >= together).join(F.broadcast(widest)).where(F.col("n") <= F.col("widest"))
    salted = rare.select("term", "n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    near = words.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["term", "salt"]).where(F.col("n") <= F.col("reach")).select("row", "term", "n")
    pairs = near.join(held, "row").where(F.col("n") <= F.col("most"))
    rated = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), *[F.first(c).alias(c) for c in ("n", "n_entity", "n_all")]).where(F.col("n_both") >= together)
    pmi = F.log2(F.col("n_both") * F.col("n_all") / (F.col("n_entity") * F.col("n")))
    own = F.log2(F.col("n_all") / F.col("n_entity"))
    return rated.where(pmi >= share * own).select("entity", "term", pmi.alias("bits"))


def bitmap_of(terms: DataFrame) -> dict[int, bytes]:
    """The pieces of a bitmap with the hash of each term set: ``BITS`` bits at most reach the driver."""
    at = terms.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BITS)).alias("at"))
    pieces = at.groupBy(F.expr(f"at div {PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE).alias("bits"))
    return {r["piece"]: bytes(r["bits"]) for r in pieces.collect()}


_HIT = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def wanted_words(is_wanted: Callable[[str], bool]) -> Callable[[str, list[S.Span]], list[tuple[str, int, int]]]:
    """A function of a text and its entities' spans to its free words that are wanted; answers for words are remembered up to a bound."""
    known: dict[str, bool] = {}

    def of(text: str, found: list[S.Span]) -> list[tuple[str, int, int]]:
        if len(known) >= TASK_TERMS:
            known.clear()
        some = False
        for w in set(_WORD.findall(text)):
            if w not in known:
                known[w] = is_wanted(w.lower())
            some = some or known[w]
        return [x for x in free_words(text, found) if known.get(text[x[1] : x[2]])] if some else []

    return of


def _added(docs: DataFrame, text_col: str, per_row: Callable[[], Callable], names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """``docs`` with further columns of a function of each text, run in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = per_row()
        for batch in batches:
            made = [per(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, {schema}")


def _span(kind: str, start: int, end: int) -> dict:
    return {"start": start, "end": end, "kind": kind}


def found_spans(docs: DataFrame, text_col: str, bitmap: dict[int, bytes]) -> DataFrame:
    """``docs`` with base and hits: the spans of each row's entities, and its words whose hash is set in ``bitmap``."""

    def per_row():
        def is_set(word: str) -> bool:
            at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BITS
            piece = bitmap.get(at // PIECE)
            return piece is not None and bool(piece[at % PIECE // 8] >> at % 8 & 1)

        words = wanted_words(is_set)

        def of(text: str | None) -> tuple:
            found = entities(text or "")
            return [_span(*f) for f in found], [{"term": w, "start": a, "end": b} for w, a, b in words(text or "", found)] if bitmap else []

        return of

    return _added(docs, text_col, per_row, ["base", "hits"], [pa.list_(_SPAN), pa.list_(_HIT)], f"base {_SPANS}, hits array<struct<term:string,start:bigint,end:bigint>>")


def _marked_by_set(rows: DataFrame, text_col: str, terms: frozenset[str]) -> DataFrame:
    """``rows`` with their spans and clean texts, by the terms themselves."""

    def per_row():
        words = wanted_words(terms.__contains__)

        def of(text: str | None) -> tuple:
            found = entities(text or "")
            spans = [_span(*f) for f in found] + [_span("term", a, b) for _, a, b in words(text or "", found)] if terms else [_span(*f) for f in found]
            spans.sort(key=lambda s: (s["start"], s["end"], s["kind"]))
            return spans, covered(text, spans)

        return of

    return _added(rows, text_col, per_row, ["spans", "clean"], [pa.list_(_SPAN), pa.string()], f"spans {_SPANS}, clean string")


def _marked_by_join(rows: DataFrame, text_col: str, telling: DataFrame) -> DataFrame:
    """``rows`` with their spans and clean texts; only rows with words that may disclose are joined with the terms."""
    found = stored(found_spans(rows, text_col, bitmap_of(telling)).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    some = F.size("hits") > 0
    hits = found.where(some).select("row", F.inline("hits")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    salted = telling.select("term", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    added = hits.join(salted, ["term", "salt"]).groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit("term").alias("kind"))).alias("added"))
    with_terms = found.where(some).join(added, "row", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))))
    plain = found.where(~some).withColumn("spans", F.array_sort("base"))
    both = plain.select(*rows.columns, "spans").unionByName(with_terms.select(*rows.columns, "spans"))
    return both.withColumn("clean", _covered(text_col, "spans"))


def _marked(rows: DataFrame, row_text: str, docs: DataFrame, text_col: str, share: float, together: int) -> DataFrame:
    """``rows``, with the texts of ``docs`` in ``row_text``, and their spans and clean texts.

    Terms that fit into every task (``MOST_TERMS`` of at most ``TERM_CHARS``) are
    sent there; more are joined, behind a bitmap of their hashes.
    """
    telling = stored(disclosing_terms(docs, text_col, share, together).select("term").distinct(), "pii-terms")
    n, widest = telling.agg(F.count(F.lit(1)), F.coalesce(F.max(F.char_length("term")), F.lit(0))).first()
    if n <= MOST_TERMS and widest <= TERM_CHARS:
        return _marked_by_set(rows, row_text, frozenset(r["term"] for r in telling.collect()))
    return _marked_by_join(rows, row_text, telling)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, together: int = MIN_TOGETHER) -> DataFrame:
    """(doc_id, spans, clean) of each row: array<struct<start, end, kind>> of its entities and disclosing terms, and its text without them."""
    text = F.col(text_col).cast("string").alias("text")
    out = _marked(docs.select(F.col(id_col).alias("doc_id"), text), "text", docs, text_col, share, together)
    return out.select("doc_id", "spans", "clean")


def span_text(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda s: s["kind"] != "term") if base_only else spans
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def covered(text: str | None, spans: list[dict]) -> str | None:
    """A text with its spans, in order of their starts, replaced; one that begins inside another is covered by it."""
    if text is None:
        return None
    at, pieces = 0, []
    for m in spans:
        if m["start"] >= at:
            word = text[m["start"] : m["end"]]
            pieces += [text[at : m["start"]], word_class(word) if m["kind"] == "term" else f"<{m['kind']}>"]
            at = m["end"]
    return "".join(pieces) + text[at:]


@pandas_udf(StringType())
def _covered(texts: pd.Series, spans: pd.Series) -> pd.Series:
    order = lambda m: (m["start"], m["end"], m["kind"])
    return pd.Series([covered(t, sorted(marks if marks is not None else (), key=order)) for t, marks in zip(texts, spans, strict=True)], dtype=object)


def sanitise(docs: DataFrame, *, text_col: str = "text", share: float = SHARE, together: int = MIN_TOGETHER) -> DataFrame:
    """``docs`` with personal data replaced by its kind, and disclosing terms by their word class; a null text stays null."""
    columns = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[(F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`")).alias(n) for c, n in columns.items()])
    text = columns[text_col]
    out = _marked(rows, text, docs, text_col, share, together)
    return out.select(*[F.col("clean" if n == text else n).alias(c) for c, n in columns.items()])
