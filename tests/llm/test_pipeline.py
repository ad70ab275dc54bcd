import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_lines, brute_mix, brute_quality

from quayside.llm import near_dedup, packing
from quayside.llm.common import tokenizer_path, written_so_far


def brute_pipeline(spark, rows):
    """(doc_id, start, length, crc) of every piece, by plain loops over (doc_id, text, source)."""
    from tokenizers import Tokenizer

    good = [r for r in rows if brute_quality(r[1], corpus_pipeline.MIN_WORDS)]
    texts = {}
    for (i, *_, t), (d, _, s) in zip(sorted_lines(good), sorted(good, key=key), strict=True):
        assert i == (-1 if d is None else d)
        texts.setdefault((i, t, s), []).append(d)
    cleaned = [(d, t, s) for (_, t, s), ds in texts.items() for d in ds]
    named = [r for r in cleaned if r[0] is not None and r[1].split()]
    roots = brute_components([(d, t) for d, t, _ in named], near_dedup.PERCENT)
    kept, seen = [r for r in cleaned if r not in named], set()
    for r, (_, _, root, _) in sorted(zip(named, roots, strict=True), key=lambda x: x[0][0]):
        if root not in seen:
            seen.add(root)
            kept.append(r)
    _, copies = brute_mix(spark, [(d, s, t) for d, t, s in kept], None, corpus_pipeline.MAX_REPEATS, 0.95)
    most = {}
    for (d, _, _), n in zip(kept, copies, strict=True):
        most[d] = max(n, most.get(d, 1))
    coder, out = Tokenizer.from_file(tokenizer_path()), Counter()
    for d, t, _ in kept:
        ids = [*coder.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        for n in packing.binary_lengths(len(ids)):
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))
            out[d, at, n, crc] += most[d] if d is not None else 1
            at += n
    return out


def key(r):
    return (-1 if r[0] is None else r[0], r[1] or "", r[2] or "")


def sorted_lines(rows):
    """The rows after line dedup, in the order of ``rows`` sorted by ``key``."""
    rows = sorted(rows, key=key)
    after = brute_lines([(d, t) for d, t, _ in rows])
    by_id = {}
    for r in after:
        by_id.setdefault(r[0], []).append(r)
    out = []
    for d, t, _ in rows:
        mine = by_id[-1 if d is None else d]
        lines = (t or "").split("\n")
        k = next(k for k, r in enumerate(mine) if r[1] == len(lines) and subsequence(r[3].split("\n") if r[1] > r[2] else [], lines))
        out.append(mine.pop(k))
    return out


def subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    folder = str(tmp_path)
    frame = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"), F.lit("clash").alias("copies"))
    more = [(2, "an unlike text that has the id of another one in it", "s9"), (None, "a text without an id stays as it is here", None)]
    frame = frame.union(spark.createDataFrame([(i, t, "en", s, len(t), "x") for i, t, s in more], frame.schema))
    frame.write.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    mark = written_so_far()
    out = corpus_pipeline.run(spark, folder)
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out.collect())
    assert got == brute_pipeline(spark, rows)
    assert written_so_far() == mark + len(corpus_pipeline.STAGES) - 1  # only the stages' own results are left
    assert 0 < len({d for d, *_ in got}) < len(rows)


def test_pipeline_keeps_columns_of_any_name(spark, docs, tmp_path):
    names = ["a.b", "tick`ed", "a b", "copies", "component_id"]
    frame = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"), *[F.lit(n).alias(n) for n in names])
    now = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
    assert {tuple(r) for r in now.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names]).distinct().collect()} == {tuple(names)}
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("rows", [[], [(1, None, None), (1, "", "s"), (None, None, "s")]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns and docs.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
