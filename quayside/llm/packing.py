"""Packing by power-of-two decomposition: no sequence crosses documents.

Every document is tokenised, ended with one separator id and cut into pieces
whose lengths are powers of two: as many pieces of ``max_len`` as fit, then the
binary digits of the rest from the largest down.  Each piece is a sequence of
its own, so nothing is padded.  Sequences of equal length are then brought
together in one bucket: pieces are dealt by their length and a hash, so a bucket
with a third of all pieces is spread over tasks, and sorted, so that a task
holds the sequences of a bucket in one run with consecutive ids.  A trainer
reads a bucket at a time with a batch size that keeps tokens a batch constant.

Token ids are those of the byte-level BPE in the given ``tokenizers`` file.  A
single space between two visible characters always ends a pre-token of this
vocabulary, so texts are cut there.  The distinct chunks of many texts are encoded
once, as one text, and each text takes its ids by chunk; texts with other runs of
white space, or with the special token's own string, take the tokenizer as a whole.

Defined results: a null text counts as empty (its only id is the separator);
repeated rows, repeated and null ids are packed once per row; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEN = 1024
#: Bytes of the texts that are cut into chunks together.
RUN_BYTES = 8_000_000

#: Fixed value: how byte-level tokenizer files cut a text before they merge bytes.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def binary_lengths(total: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of ``total`` ids, largest first."""
    full, rest = divmod(total, max_len)
    out = [max_len] * full
    bit = max_len >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


class TokenBytes:
    """Texts to ids as little-endian uint32 bytes."""

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        added = {t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if i not in added}
        self.id_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.id_bytes[list(ranks.values())] = [len(piece) for piece in ranks]
        cut = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{tokenizer_path}: only byte-level BPE without a normaliser, a prefix space or a pattern of its own")
        coder = tiktoken.Encoding("corpus", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.encode_ids = coder.encode_to_numpy

    def encode(self, text: str) -> bytes:
        return self.encode_ids(text).astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.encode(text)

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order."""
        texts = pc.fill_null(texts, "")
        run = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // RUN_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            if start < stop:
                yield from self._run(texts[start:stop])

    def _run(self, texts: pa.Array) -> Iterator[bytes]:
        cut = pc.split_pattern(texts, " ")
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)))
        first, last = bounds[:-1], bounds[1:] - 1
        coded = cut.flatten().dictionary_encode()
        chunks, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        full = pc.greater(pc.binary_length(chunks), 0)
        opens, closes = (pc.and_(full, pc.equal(trim(chunks), chunks)).to_numpy(zero_copy_only=False) for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        # Each space needs visible characters on both sides; the ends of a text do not.
        uneven_open, uneven_close = ~opens[codes], ~closes[codes]
        ragged = np.flatnonzero(uneven_close[last] & (first < last))
        uneven_open[first] = uneven_close[last] = False
        odd = np.logical_or.reduceat(uneven_open | uneven_close, first)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)

        ids, sizes = self._chunk_ids(chunks, opens & closes)
        own = [b"" if o else self.encode(chunks[c].as_py()) for o, c in zip(odd.tolist(), codes[first].tolist(), strict=True)]
        own += [b"" if odd[d] else self.encode(" " + chunks[codes[last[d]]].as_py()) for d in ragged.tolist()]
        codes[first] = len(sizes) + np.arange(len(first))
        codes[last[ragged]] = len(sizes) + len(first) + np.arange(len(ragged))
        ids = np.concatenate((ids, np.frombuffer(b"".join(own), dtype="<u4")))
        sizes = np.concatenate((sizes, np.array([len(x) // 4 for x in own], dtype=np.int64)))
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), ids)
        flat = lists.take(pa.array(codes)).flatten().to_numpy()
        at = np.concatenate(([0], np.cumsum(sizes[codes])))[bounds].tolist()
        for d, o in enumerate(odd.tolist()):
            yield self(texts[d].as_py()) if o else flat[at[d] : at[d + 1]].tobytes()

    def _chunk_ids(self, chunks: pa.Array, even: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks after a space, in order, and how many each has: none where a chunk is not ``even``, as it begins or ends in white space, or is empty."""
        sizes = np.zeros(len(chunks), dtype=np.int64)
        if not even.any():
            return np.zeros(0, dtype="<u4"), sizes
        whole = chunks.filter(pa.array(even))
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(whole)], whole), " ")[0].as_py()
        ids = self.encode_ids(" " + joined).astype("<u4")
        reached, ends = np.cumsum(self.id_bytes[ids]), np.cumsum(pc.binary_length(whole).to_numpy() + 1, dtype=np.int64)
        stops = np.searchsorted(reached, ends)
        if not (reached[stops] == ends).all():
            raise ValueError("an id crosses a space between visible characters")
        sizes[even] = np.diff(stops, prepend=-1)
        return ids, sizes


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level BPE files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(plain))
    return out


@lru_cache(maxsize=2)
def _coder(tokenizer_path: str) -> TokenBytes:
    return TokenBytes(tokenizer_path)


def pack_power_of_two(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, separator: int = 0, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, bucket, sequence_id, offset.

    ``ids`` (array<int>) is left out with ``with_ids=False``.  ``bucket`` is the
    binary logarithm of the length; ``sequence_id`` is unique over the result,
    and the ids of a bucket are consecutive within a task.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = _coder(tokenizer_path), np.array([separator], dtype="<u4").tobytes()
        for batch in batches:
            keep, rows = [], [[] for _ in range(4 + with_ids)]
            size = 0
            for row, ids in enumerate(coder.many(batch.column(1))):
                ids += end
                total, at = len(ids) // 4, 0
                for n in binary_lengths(total, max_len):
                    piece = ids[4 * at : 4 * (at + n)]
                    keep.append(row)
                    for out, v in zip(rows, (at, n, zlib.crc32(piece), total), strict=False):
                        out.append(v)
                    if with_ids:
                        rows[4].append(np.frombuffer(piece, dtype="<i4"))
                    at += n
                size += len(ids)
                if size > 1 << 25:
                    yield _pieces(batch, keep, rows, with_ids)
                    keep, rows, size = [], [[] for _ in range(4 + with_ids)], 0
            if keep:
                yield _pieces(batch, keep, rows, with_ids)

    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    bucketed = pieces.withColumn("bucket", F.log2("length").cast("int")).repartition("bucket", spread).sortWithinPartitions("bucket", "doc_id", "start", "ids_crc32")
    # Partition number and place in the sorted partition: unique, and the same again when a lost task is run anew.
    return bucketed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _pieces(batch: pa.RecordBatch, keep: list[int], rows: list[list], with_ids: bool) -> pa.RecordBatch:
    cols = [batch.column(0).take(pa.array(keep, pa.int64()))] + [pa.array(r, pa.int64()) for r in rows[:4]]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:
        cols.append(pa.array(rows[4], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write packed sequences with one folder per bucket, as a trainer reads them; tasks write their runs, so few files arise."""
    sequences.write.partitionBy("bucket").parquet(path)
