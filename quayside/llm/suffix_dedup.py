"""Removal of passages that occur earlier, by two-stage sorted suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier:
in a row with a smaller id, or further up in the same text.  Texts are bytes
(UTF-8), and matches never cross rows.

1. Anchors.  In each string of ``LENGTH`` bytes the ``K`` bytes with the smallest
   hash are its anchor, so equal strings have equal anchors.  Neighbouring strings
   with one anchor make a piece: up to ``LENGTH - K + 1`` starts.  Of each piece a
   hash of its anchor and one of its content is kept.
2. Pieces meet by anchor.  Of pieces with equal content the earliest stands for
   all; the starts of the others go.  Where an anchor stands in one content only,
   no other string can be equal.  Pieces with equal anchors and unlike content
   are cut from their texts: they may hold equal strings at other places.
3. Suffix arrays.  Those pieces are dealt by anchor, and each task sorts the
   suffixes of its pieces in two stages: suffixes smaller than their successors
   are sorted directly, the others follow by scanning the buckets of first bytes
   from small to large, each suffix placing the one before it.  Suffixes next to
   each other with a common prefix of ``LENGTH`` bytes or more form a group, of
   which all but the earliest start go.
4. The removed starts are joined back to their texts.

What is sent before step 3 is hashes and places.  A content that many rows share
is one entry for each batch of rows.  An anchor with more than ``MANY`` contents
is dealt anew by the whole string at each start, so its group does not meet in
one task.  Texts of any length are read in parts of a million bytes that overlap
by one string less a byte.

Defined results: null and empty texts keep nothing; texts under ``LENGTH`` bytes
lose nothing; rows with a null id count as the last ones; rows of one id and
other texts are ordered by a hash of the text; rows of one id and text are one
row for all comparisons, so none of them loses what the other has; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stored

#: Bytes of a string that must not repeat, and of an anchor.
LENGTH, K = 100, 32
#: Contents of one anchor that one task sorts at most.
MANY = 100_000
#: Text bytes for each partition of the pieces, at most.
PART_BYTES = 64_000_000

_BITS = 20
_STEP = (1 << _BITS) - LENGTH
_MASK = np.uint64((1 << _BITS) - 1)
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
_BATCH_BYTES = 1 << 24


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full((1 << _BITS) + 1, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of all substrings of one length by prefix sums."""

    def __init__(self) -> None:
        self.up, self.down = _powers()
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def pieces(self, block: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, starts in it, anchor's hash, content's hash) of the pieces of texts that lie behind one another in ``block``; ends: where each text ends."""
        n = len(block)
        none = np.empty(0, dtype=np.int64)
        if n < LENGTH:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.letters[block] * self.up[:n], out=sums[1:])
            h = mixed((sums[K:] - sums[:-K]) * self.down[: n - K + 1])
        low = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
        width, want = 1, LENGTH - K + 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
        anchor = (low & _MASK).astype(np.int64)
        lengths = np.diff(ends, prepend=0)
        room = np.repeat(ends, lengths)[: len(anchor)] - np.arange(len(anchor))
        inside = np.flatnonzero(room >= LENGTH)
        if not len(inside):
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (np.diff(inside) != 1) | (np.diff(anchor[inside]) != 0)
        first = np.flatnonzero(new)
        start, count = inside[first], np.diff(first, append=len(inside))
        with np.errstate(over="ignore"):
            content = mixed((sums[start + count + (LENGTH - 1)] - sums[start]) * self.down[start] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return start, count, h[anchor[start]], content


#: Places and hashes of many pieces as bytes, so that a row holds thousands.
_FIELDS = {"anchor": np.uint64, "content": np.uint64, "did": np.int64, "tie": np.int64, "start": np.int64, "n": np.uint8}
_PACKED = "bucket int, kind int, " + ", ".join(f"{f} binary" for f in _FIELDS)
#: What is known of a text's pieces: kind 0, these starts go; 1 and 2, cut them and compare (2: by whole strings).
_FOUND = "did bigint, tie bigint, kind int, starts array<bigint>, ns array<int>, anchors array<bigint>"


def _packed(bucket: int, kind: int, columns: dict[str, np.ndarray], at: np.ndarray) -> dict:
    return {"bucket": bucket, "kind": kind} | {f: columns[f][at].tobytes() for f in _FIELDS}


def _unpacked(rows: list[dict]) -> dict[str, np.ndarray]:
    return {f: np.frombuffer(b"".join(r[f] for r in rows), dtype=t) for f, t in _FIELDS.items()}


def _firsts(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sorted by anchor, content and place; which is the first of its content; and which stand later than it."""
    order = np.lexsort((c["start"], c["tie"], c["did"], c["content"], c["anchor"]))
    a, b = c["anchor"][order], c["content"][order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = np.zeros(len(order), dtype=bool)
    for f in ("did", "tie", "start"):
        later |= c[f][order] != c[f][lead]
    return order, first, later


def _by_text(c: dict[str, np.ndarray], at: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row of ``_FOUND`` for each text of the chosen places."""
    at = at[np.lexsort((c["start"][at], c["tie"][at], c["did"][at]))]
    did, tie = c["did"][at], c["tie"][at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (did[1:] != did[:-1]) | (tie[1:] != tie[:-1])
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (c["start"][at], c["n"][at].astype(np.int32), c["anchor"][at].view(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(did[first]), pa.array(tie[first]), pa.array(np.full(len(first), kind, dtype=np.int32)), *lists], names=[x.split()[0] for x in _FOUND.split(", ")])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, did, tie, data): the place of each row in the order of rows, and its bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.select("id", F.coalesce(F.col("id").cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("data"))


def _places(texts: DataFrame, buckets: int) -> DataFrame:
    """The pieces of all texts, packed by bucket of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def hashed(parts: list[tuple[int, int, int, np.ndarray]]) -> None:
            ends = np.cumsum([len(p[3]) for p in parts])
            start, count, anchor, content = hasher.pieces(np.concatenate([p[3] for p in parts]), ends)
            if len(start):
                own = np.searchsorted(ends, start, side="right")
                base = np.array([p[2] for p in parts]) - np.append(0, ends[:-1])
                held.append({"anchor": anchor, "content": content, "did": np.array([p[0] for p in parts])[own], "tie": np.array([p[1] for p in parts])[own], "start": start + base[own], "n": count.astype(np.uint8)})

        def flushed() -> pa.RecordBatch | None:
            if not held:
                return None
            c = {f: np.concatenate([h[f] for h in held]) for f in _FIELDS}
            held.clear()
            order, first, later = _firsts(c)
            at, out = order[first], []
            bucket = (c["anchor"][at] >> np.uint64(24)) % np.uint64(buckets)
            at = at[np.lexsort((c["start"][at], c["tie"][at], c["did"][at], bucket))]
            bucket = (c["anchor"][at] >> np.uint64(24)) % np.uint64(buckets)
            cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets), append=np.uint64(buckets)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append(_packed(int(bucket[a]), 1, c, at[a:b]))
            gone = order[later]
            for b in np.unique(c["did"][gone] % buckets):  # dealt by row: an anchor of many rows is no task's alone
                out.append(_packed(int(b), 0, c, gone[c["did"][gone] % buckets == b]))
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(f, pa.binary()) for f in _FIELDS]]))

        parts, length = [], 0
        for batch in batches:
            for did, tie, data in zip(batch["did"].to_pylist(), batch["tie"].to_pylist(), batch["data"], strict=True):
                whole = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                for s in range(0, len(whole) - LENGTH + 1, _STEP):
                    part = whole[s : s + _STEP + LENGTH - 1]
                    if length + len(part) >= 1 << _BITS:
                        hashed(parts)
                        size, parts, length = size + length, [], 0
                    parts.append((did, tie, s, part))
                    length += len(part)
                if size >= _BATCH_BYTES:
                    if (out := flushed()) is not None:
                        yield out
                    size = 0
            if parts:
                hashed(parts)
            size, parts, length = size + length, [], 0
        if (out := flushed()) is not None:
            yield out

    return texts.where(F.octet_length("data") >= LENGTH).select("did", "tie", "data").mapInArrow(run, _PACKED)


def _met(places: DataFrame, many: int) -> DataFrame:
    """What is known of each text's pieces once all pieces of an anchor have met; a partition has whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if gone := [r for r in rows if not r["kind"]]:
            c = _unpacked(gone)
            yield _by_text(c, np.arange(len(c["n"])), 0)
        rows = [r for r in rows if r["kind"]]
        if not rows:
            return
        c = _unpacked(rows)
        del rows
        order, first, later = _firsts(c)
        yield _by_text(c, order[later], 0)
        at = order[first]
        _, which, contents = np.unique(c["anchor"][at], return_inverse=True, return_counts=True)
        n = contents[which]
        yield _by_text(c, at[(n > 1) & (n <= many)], 1)
        yield _by_text(c, at[n > many], 2)

    return places.mapInArrow(run, _FOUND)


_CUT = "bucket int, did binary, tie binary, start binary, n binary, data binary"


def _cut(texts: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the pieces to compare, packed by bucket of their anchors."""
    wanted = found.where("kind = 1").groupBy("did", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ns")).alias("ns"), F.flatten(F.collect_list("anchors")).alias("anchors"))
    kinds = {"did": np.int64, "tie": np.int64, "start": np.int64, "n": np.uint8}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            rows = [{"bucket": b} | {f: np.array([x[i] for x in xs], dtype=t).tobytes() for i, (f, t) in enumerate(kinds.items())} | {"data": b"".join(x[4] for x in xs)} for b, xs in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), *[(f, pa.binary()) for f in kinds], ("data", pa.binary())]))

        for batch in batches:
            for did, tie, data, starts, ns, anchors in zip(*[batch[c] for c in ("did", "tie", "data", "starts", "ns", "anchors")], strict=True):
                data, did, tie = data.as_py(), did.as_py(), tie.as_py()
                dealt = ((anchors.values.to_numpy().view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).tolist()
                for s, n, b in zip(starts.as_py(), ns.as_py(), dealt, strict=True):
                    held.setdefault(b, []).append((did, tie, s, n, data[s : s + n + LENGTH - 1]))
                    size += n + LENGTH
                if size >= _BATCH_BYTES:
                    yield flushed()
                    size = 0
        if held:
            yield flushed()

    return texts.join(wanted, ["did", "tie"]).select("did", "tie", "data", "starts", "ns", "anchors").mapInArrow(run, _CUT)


def suffix_order(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owned: np.ndarray) -> np.ndarray:
    """The first ``owned`` suffixes of each piece of ``text``, in order of their first ``LENGTH`` bytes.

    A piece begins at ``starts`` and has ``lengths`` bytes, the last of its own
    suffixes ``LENGTH`` or more.  Only suffixes smaller than their successors are
    compared; a piece's last bytes take part as far as its own suffixes' order
    depends on them.
    """
    n = len(text)
    ends = starts + lengths
    place = np.arange(n)
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    rises = np.zeros(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    rises &= ~last
    settled = last.copy()
    settled[:-1] |= text[:-1] != text[1:]
    follow = np.minimum.accumulate(np.where(settled, place, n)[::-1])[::-1]  # where the suffix and its successor first differ
    small = rises[follow]
    next_small = np.append(np.minimum.accumulate(np.where(small, place, n)[::-1])[::-1], n)
    reach = np.minimum(next_small[starts + owned - 1], ends - 1)  # up to where suffixes are put in order
    used = np.zeros(n + 1, dtype=np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, reach + 1, -1)
    used = np.cumsum(used[:-1]).astype(bool)
    end_of = np.repeat(ends, lengths)
    begins = np.zeros(n, dtype=bool)
    begins[starts] = True

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def place_before(at: np.ndarray, here: int) -> np.ndarray:
        """Each suffix of ``at`` places the greater one before it; those of bucket ``here`` are returned."""
        before = at[~begins[at]] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        own = before[:0]
        for group in np.split(before, cuts) if len(before) else []:
            if text[group[0]] == here:
                own = group
            else:
                waiting[text[group[0]]].append(group)
        return own

    # Pieces whose rest falls to its end begin the scan there: nothing is smaller than the end.
    closing = (ends - 1)[used[ends - 1] & ~small[ends - 1]]
    first = text[closing]
    for b in np.unique(first):
        waiting[b].append(closing[first == b])
    direct = np.flatnonzero(used & small)
    direct = direct[np.argsort(text[direct], kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    padded, width = np.append(text, np.zeros(LENGTH, dtype=np.uint8)), np.arange(LENGTH)
    out = []
    for b in range(256):
        now = np.concatenate(waiting[b]) if waiting[b] else direct[:0]
        waiting[b] = []
        while len(now):
            out.append(now)
            now = place_before(now, b)
        mine = direct[bounds[b] : bounds[b + 1]]
        if len(mine):
            rows = padded[mine[:, None] + width]
            rows[width >= (end_of[mine] - mine)[:, None]] = 0
            mine = mine[np.argsort(np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel(), kind="stable")]
            out.append(mine)
            place_before(mine, b)
    every = np.concatenate(out) if out else direct
    own = place < np.repeat(starts + owned, lengths)
    return every[own[every]]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in ``order``, counted up to ``LENGTH``; the first has none."""
    out, width = np.zeros(len(order), dtype=np.int64), np.arange(LENGTH)
    for i in range(1, len(order), 100_000):
        a, b = order[i - 1 : i + 99_999], order[i : i + 100_000]
        a = a[: len(b)]
        unlike = text[a[:, None] + width] != text[b[:, None] + width]
        out[i : i + len(b)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), LENGTH)
    return out


def repeated(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owned: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The suffixes (as places in ``text``) whose first ``LENGTH`` bytes an earlier one has; rank: order of the pieces."""
    order = suffix_order(text, starts, lengths, owned)
    if not len(order):
        return order
    group = np.cumsum(common_prefixes(text, order) < LENGTH) - 1
    piece = np.repeat(np.arange(len(starts)), lengths)[order]
    when = rank[piece] * LENGTH + (order - starts[piece])
    earliest = np.minimum.reduceat(when, np.flatnonzero(np.diff(group, prepend=-1)))
    return order[when > earliest[group]]


def _sorted(cut: DataFrame) -> DataFrame:
    """The starts that go among the pieces that were cut; a partition has whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rows.setdefault(r["bucket"], []).append(r)
        while rows:
            _, some = rows.popitem()
            did, tie, start = (np.frombuffer(b"".join(r[f] for r in some), dtype=np.int64) for f in ("did", "tie", "start"))
            n = np.frombuffer(b"".join(r["n"] for r in some), dtype=np.uint8).astype(np.int64)
            text = np.frombuffer(b"".join(r["data"] for r in some), dtype=np.uint8)
            lengths = n + (LENGTH - 1)
            starts = np.cumsum(lengths) - lengths
            order = np.lexsort((start, tie, did))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(did[order]) != 0) | (np.diff(tie[order]) != 0) | (np.diff(start[order]) != 0)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.cumsum(new)  # a piece of repeated rows has one rank, so it is not later than itself
            gone = np.sort(repeated(text, starts, lengths, n, rank))
            if not len(gone):
                continue
            piece = np.searchsorted(starts, gone, side="right") - 1
            fresh = np.ones(len(gone), dtype=bool)
            fresh[1:] = (np.diff(gone) != 1) | (np.diff(piece) != 0)
            first = np.flatnonzero(fresh)
            count, piece = np.diff(first, append=len(gone)), piece[first]
            c = {"did": did[piece], "tie": tie[piece], "start": start[piece] + gone[first] - starts[piece], "n": count.astype(np.uint8), "anchor": np.zeros(len(first), dtype=np.uint64)}
            yield _by_text(c, np.arange(len(first)), 0)

    return cut.mapInArrow(run, _FOUND)


def _by_strings(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The starts that go among pieces whose anchor has very many contents: each whole string meets its equals, counted before it is sent."""
    wanted = found.where("kind = 2").groupBy("did", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ns")).alias("ns"))

    each = F.flatten(F.zip_with("starts", "ns", lambda s, n: F.sequence(s, s + n - F.lit(1))))
    strings = texts.join(wanted, ["did", "tie"]).select("did", "tie", "data", F.explode(each).alias("start"))
    string = F.substring("data", F.col("start").cast("int") + 1, F.lit(LENGTH))
    hashed = strings.select("did", "tie", "start", F.sha2(string, 256).alias("h"))
    hashed = stored(hashed, "suffix-strings")
    first = hashed.groupBy("h").agg(F.min(F.struct("did", "tie", "start")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    later = hashed.join(first, "h").where(F.struct("did", "tie", "start") > F.col("first"))
    one = F.array(F.lit(1))
    return later.select("did", "tie", F.lit(0).alias("kind"), F.array("start").alias("starts"), one.alias("ns"), F.array(F.lit(0).cast("long")).alias("anchors"))


_KEPT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: bytes, removed ones, maximal removed runs, and the bytes that stay."""
    texts = _texts(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    buckets = 4 * parts
    found = stored(_met(_places(texts, buckets).repartition(parts, "bucket"), many), "suffix-places")
    sorted_ = _sorted(_cut(texts, found, buckets).repartition(parts, "bucket"))
    going = found.where("kind = 0").unionByName(sorted_)
    if not found.where("kind = 2").isEmpty():
        going = going.unionByName(_by_strings(texts, found))
    going = going.groupBy("did", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ns")).alias("ns"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for data, starts, ns in zip(batch["data"], batch["starts"], batch["ns"], strict=True):
                data = data.as_py()
                if not starts.is_valid:
                    out.append((len(data), 0, 0, data))
                    continue
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                s = starts.values.to_numpy()
                np.add.at(edge, s, 1)
                np.add.at(edge, s + ns.values.to_numpy() + (LENGTH - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(going, ["did", "tie"], "left").select("id", "data", "starts", "ns")
    return joined.mapInArrow(run, f"doc_id {id_type}, {_KEPT}")
