"""Document fingerprints by closed syncmers.

A text is cut into letters, every one of which is hashed.  Words (runs of
anything but ASCII white space) that begin within the first ``ENDS`` code points
of a text, or end within the last, are spelled: each code point is a letter.
Between them words are letters, and words of over ``LONG_WORD`` code points are
spelled too.  So a short text has letters enough to be told from its neighbours,
a long one is not spelled whole, and a text has nearly the letters of the same
text less a code point, whatever its length.
A k-mer of K
consecutive letters is kept when its smallest inner hash stands at its first or
its last letter: a closed syncmer with inner substrings of one letter.  Whether
a k-mer is kept depends on its own letters alone, so an edit elsewhere moves no
anchor.  The fingerprint lists the 32-bit hashes of the kept k-mers in text
order; ``anchors`` has the position of each: its word, and the code point in a
spelled one.

Likeness is the share of distinct anchors that two fingerprints have in common.
Positional matching says how much of that stands in the same place: a shift is
taken from the first, the middle and the last anchor in common, and of the
anchors whose positions differ by that shift the largest share counts.

Everything runs as DataFrame expressions over whole texts.

Defined results: a null text counts as empty; an empty text, or one of white
space only, has no anchor and an empty fingerprint; a text of fewer than K
letters has one anchor over all of them; equal texts have equal fingerprints;
two empty fingerprints are alike (1.0), an empty and another one are not (0.0).
Rows are ordered by descending id, null ids last, rows of one id by a hash of
the text; repeated rows follow one another, so all but the last are followed by
their own text; the last row of all is followed by the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import WHITE, stored

K = 5
#: Code points over which a word counts as so many letters, and that are spelled at either end of a text.
LONG_WORD, ENDS = 16, 80
#: Characters that one task orders, and the most tasks.
RANGE_CHARS, MOST_RANGES = 8_000_000, 100_000
_LEAST = -(1 << 63)
#: Repeated rows from which on they are ordered as one row with a count.
REPEATS = 1_000


#: Positions of one word: its number times this, and the code point in it.
_PLACES = 1 << 20


def _split(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{WHITE}]+", -1), lambda w: w != "")


def with_words(rows: DataFrame, text: str, c: str) -> DataFrame:
    """``rows`` with the words of ``text`` as columns ``c``_head, ``c``_middle and ``c``_tail: those that begin within the first ``ENDS`` code points, or end within the last, stand apart.

    Columns and not fields of one struct: expressions that read them would work a struct out anew for every word.
    """
    first = rf"\A(?s:.){{0,{ENDS}}}[^{WHITE}]*"
    rows = rows.withColumn(f"{c}_first", F.regexp_extract(F.coalesce(text, F.lit("")), first, 0))
    rows = rows.withColumn(f"{c}_rest", F.substring(F.coalesce(text, F.lit("")), F.char_length(f"{c}_first") + 1, F.char_length(text)))
    rows = rows.withColumn(f"{c}_last", F.reverse(F.regexp_extract(F.reverse(f"{c}_rest"), first, 0)))
    between = F.substring(F.col(f"{c}_rest"), F.lit(1), F.char_length(f"{c}_rest") - F.char_length(f"{c}_last"))
    cut = {"head": F.col(f"{c}_first"), "middle": between, "tail": F.col(f"{c}_last")}
    return rows.withColumns({f"{c}_{k}": _split(v) for k, v in cut.items()}).drop(f"{c}_first", f"{c}_rest", f"{c}_last")


def _code_points(w: Column) -> Column:
    return F.filter(F.split(w, "", -1), lambda c: c != "")


def word_hashes(found: Column) -> Column:
    """A hash of each word; the least number for a long one."""
    return F.transform(found, lambda w: F.when(F.char_length(w) > LONG_WORD, F.lit(_LEAST)).otherwise(F.xxhash64(w)))


def _spelled(found: Column) -> Column:
    """Hashes of the code points of words."""
    return F.flatten(F.transform(found, lambda w: F.transform(_code_points(w), lambda c: F.xxhash64(c))))


def _places(found: Column, first: Column, only_long: bool = False) -> Column:
    """Positions of the code points of words, the first of which has number ``first``; of long ones only, others are one letter."""

    def of(w: Column, i: Column) -> Column:
        number = (first + i).cast("long") * _PLACES
        each = F.transform(_code_points(w), lambda c, o: number + o)
        return F.when(F.char_length(w) > LONG_WORD, each).otherwise(F.array(number)) if only_long else each

    return F.flatten(F.transform(found, of))


def with_letters(rows: DataFrame, c: str) -> DataFrame:
    """``rows`` with ``c``_hashes of all letters of the words in ``c``_head, ``c``_middle and ``c``_tail, and their positions as ``c``_places.

    Most texts have no long word between their ends: there a word's hash is the
    letter's, and its position follows from its number.
    """
    head, middle, tail = (F.col(f"{c}_{k}") for k in ("head", "middle", "tail"))
    rows = rows.withColumn(f"{c}_plain", word_hashes(middle))
    long = F.array_min(f"{c}_plain") == _LEAST
    each = F.flatten(F.transform(middle, lambda w: F.when(F.char_length(w) > LONG_WORD, F.transform(_code_points(w), lambda x: F.xxhash64(x))).otherwise(F.array(F.xxhash64(w)))))
    first_of_tail = F.size(head) + F.size(middle)
    one_each = F.when(F.size(middle) > 0, F.sequence(F.size(head).cast("long") * _PLACES, (first_of_tail - 1).cast("long") * _PLACES, F.lit(_PLACES).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    between = F.when(long, _places(middle, F.size(head), only_long=True)).otherwise(one_each)
    hashes = F.concat(_spelled(head), F.when(long, each).otherwise(F.col(f"{c}_plain")), _spelled(tail))
    rows = rows.withColumns({f"{c}_hashes": hashes, f"{c}_places": F.concat(_places(head, F.lit(0)), between, _places(tail, first_of_tail))})
    return rows.drop(*[f"{c}_{k}" for k in ("head", "middle", "tail", "plain")])


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(hashes: Column, place: Callable[[Column], Column], k: int = K) -> Column:
    """array<struct<pos, hash>> of the closed syncmers of letters, in order; hashes: a column; place: position of the i-th letter, from 1."""
    n = F.size(hashes)
    starts = F.when(n >= k, F.sequence(F.lit(1), n - F.lit(k - 1))).otherwise(F.array().cast("array<int>"))

    def closed(i: Column) -> Column:
        first, last = F.element_at(hashes, i), F.element_at(hashes, i + F.lit(k - 1))
        inner = [F.element_at(hashes, i + F.lit(j)) for j in range(1, k - 1)]
        least = F.least(*inner) if len(inner) > 1 else inner[0]
        return (F.least(first, last) <= least)

    def taken(i: Column) -> Column:
        return F.struct(place(i).alias("pos"), _low(F.xxhash64(*[F.element_at(hashes, i + F.lit(j)) for j in range(k)])).alias("hash"))

    short = F.array(F.struct(F.lit(0).cast("long").alias("pos"), _low(F.xxhash64(hashes)).alias("hash")))
    none = F.array().cast("array<struct<pos:bigint,hash:bigint>>")
    return F.when(n >= k, F.transform(F.filter(starts, closed), taken)).when(n > 0, short).otherwise(none)


def fingerprint_text(found: Column) -> Column:
    """The anchors' hashes in order, eight hexadecimal digits each."""
    return F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a["hash"]), 8, "0")), "")


def likeness(n_a: Column, n_b: Column, shared: Column) -> Column:
    """Shared share of two fingerprints' distinct anchors, from the sizes of both and of what they share."""
    either = n_a + n_b - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def shifts(a: str, b: str, in_both: Column) -> Column:
    """How far the first, the middle and the last anchor in common stand apart in two texts.

    a, b: names of the texts, whose columns ``_anchors`` (pos, hash) and ``_hash``
    are read; in_both: their hashes in common, by place in ``a``.
    """
    n = F.size(in_both)

    def first_of(c: str, h: Column) -> Column:
        return F.element_at(F.col(f"{c}_anchors"), F.array_position(f"{c}_hash", h).cast("int"))["pos"]

    picked = [F.element_at(in_both, i) for i in (F.lit(1), F.floor((n + 1) / 2).cast("int"), n)]
    return F.when(n > 0, F.array_distinct(F.array(*[first_of(a, h) - first_of(b, h) for h in picked]))).otherwise(F.array().cast("array<bigint>"))


def numbered(found: Column, shift: Column | int = 0) -> Column:
    """Position and hash of each anchor mixed to one number: sets of structs would be compared pair by pair."""
    return F.transform(found, lambda x: F.xxhash64(x["pos"] + shift, x["hash"]))


def placed(a_numbers: Column, b: Column, tried: Column) -> Column:
    """Share of the anchors of ``a`` or ``b`` that agree on one of the shifts ``tried``.

    ``a_numbers`` and ``tried`` must be columns: lambdas work expressions out anew for every element.
    """
    best = F.array_max(F.transform(tried, lambda shift: F.size(F.array_intersect(a_numbers, numbered(b, shift)))))
    return likeness(F.size(a_numbers), F.size(b), F.coalesce(best, F.lit(0)))


def _split_bounds(docs: DataFrame) -> tuple[list[int], list[tuple[int | None, int]]]:
    """Ids that bound ranges of about ``RANGE_CHARS`` characters, and the ids (None: null) with so many rows that they fill several, with their numbers."""
    sizes = docs.agg(F.sum(F.char_length("text")).alias("chars"), F.count("doc_id").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    ranges = min(MOST_RANGES, max(8, (sizes["chars"] or 0) // RANGE_CHARS + 1))
    hot: list[tuple[int | None, int]] = []
    if n_null := sizes["n"] - sizes["ids"]:
        hot.append((None, max(1, round(ranges * n_null / sizes["n"]))))
    if not sizes["ids"]:
        return [], hot
    at = F.percentile_approx("doc_id", F.array(*[F.lit(i / ranges) for i in range(ranges + 1)]), F.lit(20 * ranges))
    seen = docs.agg(at.alias("b")).first()["b"]  # bounded by MOST_RANGES
    repeats: dict[int, int] = {}
    for b in seen:
        repeats[b] = repeats.get(b, 0) + 1
    return sorted({sizes["low"], sizes["high"], *seen}), hot + [(b, n) for b, n in repeats.items() if n > 2]


def _number(bounds: list[int], hot: list[tuple[int | None, int]]) -> Column:
    """A row's range: numbers grow with the id; ids in ``hot`` are cut by the tie-break into several."""
    wide = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    coarse = below(_longs([c[-1] for c in chunks]))
    chunk = F.get(F.array(*[_longs(c) for c in chunks]) if chunks else F.array(_longs([])), coarse)
    whole = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(coarse * F.lit(wide) + F.coalesce(below(chunk), F.lit(0)))
    # Parts of a hot id: the numbers behind the ids of its range that are smaller, in order of the tie-break.
    parts = F.lit(0)
    for b, n in hot:
        own = F.col("doc_id").isNull() if b is None else F.col("doc_id") == F.lit(b)
        parts = F.when(own, F.lit(1) + F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * n).cast("int")).otherwise(parts)
    return whole.cast("long") * F.lit(1 << 32) + parts


def anchored(rows: DataFrame, text: str, c: str, k: int = K) -> DataFrame:
    """``rows`` with the anchors of ``text`` as ``c``_anchors."""
    out = with_letters(with_words(rows, text, c), c)
    # The positions are read twice: the optimizer would put a column that is read once into the lambda, which then works it out for every letter.
    place = lambda i: F.when(i <= F.size(f"{c}_places"), F.element_at(f"{c}_places", i))
    return out.withColumn(f"{c}_anchors", anchors(F.col(f"{c}_hashes"), place, k)).drop(f"{c}_hashes", f"{c}_places")


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_anchors: bool = False) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by descending id; the last row gets the first's.

    With ``with_anchors`` also a_anchors and n_anchors, those of both texts: each
    row's are worked out once, where it lies, and its neighbour takes them over.

    Rows are dealt into ranges of the id that hold about as many characters, and
    those of an id that fills several ranges are dealt by their tie-break too.
    Each range finds its neighbours alone; what follows a range is the first row
    of the next lower one: one row per range, joined back.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Very often repeated rows stand as one with a count, so none of them fills a range.
    often = stored(rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATS).select("doc_id", "tie"), "syncmer-often")
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if not often.isEmpty():
        same = rows["doc_id"].eqNullSafe(often["doc_id"]) & (rows["tie"] == often["tie"])
        counted = rows.join(often, same, "left_semi").groupBy("doc_id", "text", "tie").agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.join(often, same, "left_anti").unionByName(counted)
    bounds, hot = _split_bounds(rows.select("doc_id", "text"))
    # As many partitions as ranges, so a task's share does not grow with the table.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(bounds) + sum(n for _, n in hot))
    dealt = rows.withColumn("rng", _number(bounds, hot)).repartition(parts, "rng")
    order = Window.partitionBy("rng").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc())
    own = ["text"]
    if with_anchors:
        dealt, own = anchored(dealt, "text", "a"), ["text", "a_anchors"]
    dealt = dealt.withColumn("after", F.lead(F.struct(*own)).over(order))
    # The first row of each range: ids and ties only, then its text.
    top = rows.withColumn("rng", _number(bounds, hot)).groupBy("rng").agg(F.max(F.struct("doc_id", "tie")).alias("top"))
    heads = stored(top.select("rng", "top.*", F.row_number().over(Window.orderBy(F.col("rng").desc())).alias("i")), "syncmer-ranges")  # one row for each range
    many = heads.count()
    first = heads.select(F.col("i").alias("head"), F.col("doc_id").alias("head_id"), F.col("tie").alias("head_tie"))
    texts = rows.join(F.broadcast(first), F.col("head_id").eqNullSafe(rows["doc_id"]) & (F.col("head_tie") == rows["tie"])).groupBy("head").agg(F.max("text").alias("text"))
    if with_anchors:
        texts = anchored(texts, "text", "a")
    texts = texts.select("head", F.struct(*own).alias("head_row"))
    edge = heads.select(F.col("rng").alias("to_rng"), (F.col("i") % F.lit(many) + 1).alias("head")).join(texts, "head").select("to_rng", "head_row")
    out = dealt.join(edge, F.col("rng") == F.col("to_rng"), "left")
    out = out.select("doc_id", *own, "copies", F.coalesce("after", "head_row").alias("following"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("i"))
    last = F.col("i") == F.col("copies")
    new = [F.when(last, F.col(f"following.{c}")).otherwise(F.col(c)).alias(n) for c, n in zip(own, ("next_text", "n_anchors"), strict=False)]
    return out.select("doc_id", *own, *new)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<bigint>")


def compare(rows: DataFrame, k: int = K) -> DataFrame:
    """Adds fingerprints and likenesses to rows of ``with_next``.

    Added: edited_text, fingerprint, edited_fingerprint, near_edited, near_next,
    placed_edited, placed_next (positional matching), and the anchors of the
    text with their positions.
    """
    out = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    names = {"text": "a", "edited_text": "e", "next_text": "n"}
    for source, c in names.items():
        if f"{c}_anchors" not in rows.columns:
            out = anchored(out, source, c, k)
    for c in names.values():
        out = out.withColumn(f"{c}_hash", F.col(f"{c}_anchors.hash"))
    for c in names.values():
        out = out.withColumn(f"{c}_set", F.array_distinct(f"{c}_hash"))
    for c in ("e", "n"):
        out = out.withColumn(f"{c}_shared", F.array_intersect("a_set", f"{c}_set"))
    out = out.withColumn("a_numbers", numbered(F.col("a_anchors")))
    for c in ("e", "n"):
        out = out.withColumn(f"{c}_shifts", shifts("a", c, F.col(f"{c}_shared")))
    return out.select(
        "doc_id",
        "text",
        "edited_text",
        fingerprint_text(F.col("a_anchors")).alias("fingerprint"),
        fingerprint_text(F.col("e_anchors")).alias("edited_fingerprint"),
        likeness(F.size("a_set"), F.size("e_set"), F.size("e_shared")).alias("near_edited"),
        likeness(F.size("a_set"), F.size("n_set"), F.size("n_shared")).alias("near_next"),
        placed(F.col("a_numbers"), F.col("e_anchors"), F.col("e_shifts")).alias("placed_edited"),
        placed(F.col("a_numbers"), F.col("n_anchors"), F.col("n_shifts")).alias("placed_next"),
        F.col("a_anchors").alias("anchors"),
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many, or all, of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
