import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import fingerprints, line_dedup, mixing, near_dedup, packing, quality, registry
from quayside.llm.common import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def collected(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


def brute_lines(rows):
    """doc_id, n_lines, n_dropped, text of each row, by plain loops."""
    key = lambda line: lower(line.strip(WHITE))
    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add((i, n if i is None else -1))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i is not None and max(d for d, _ in holders[key(x)] if d is not None) > i  # noqa: B023, E731
        keep = [x for x in lines if not gone(x)]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_line_dedup_against_brute_force(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs, into="out")
    assert sorted((r.doc_id, r.out.n_lines, r.out.n_dropped, r.out.text) for r in out.collect()) == brute_lines(rows)
    assert sum(w[2] for w in brute_lines(rows)) > 5
    assert line_dedup.replace_text(docs).columns == docs.columns
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "this line is long enough to be counted"
    long = "\n".join(f"line number {i} of a very long text" for i in range(30_000))
    rows = [(1, f"a\n{line}"), (1, f"{line}\nb\n{line}"), (2, line), (3, "other line that three rows hold"), (3, "other line that three rows hold"), (4, "other line that three rows hold")]
    rows += [(None, "a line of rows without any id"), (None, "a line of rows without any id"), (7, "a line of rows without any id"), (8, "A line of rows without any id ")] + [(10 + i, long + f"\n{i}") for i in range(3)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), into="text2").collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text2.n_lines, r.text2.n_dropped, r.text2.text) for r in out)
    assert got == brute_lines(rows)
    assert {r[0] for r in got if r[2]} == {7, 10, 11}


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_against_brute_force(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = near_dedup.near_duplicates(docs, percent=85)
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_components(rows, 85))
    want = brute_components(rows, 80)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == sorted(want)
    assert len({w[2] for w in want}) < len(want) - 20
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[2] for w in want}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_keep_one_judges_rows_not_ids(spark):
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(2, x), (5, x + " end"), (5, y), (7, "seven of one text and one id"), (7, "seven of one text and one id"), (9, ""), (9, ""), (None, x), (11, y + " end"), (5, y)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in kept.collect())
    assert got == sorted([(2, x), (5, y), (7, "seven of one text and one id"), (9, ""), (9, ""), (-1, x)])


def test_near_duplicates_finish_families_and_frequent_shingles(spark, monkeypatch):
    """Families whose members are edited to different degrees, and texts that share passages without being alike, need the second round."""
    import random

    calls = []
    across = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda members, *a: calls.append(members.count()) or across(members, *a))
    rng = random.Random(8)
    fresh = iter(range(10**9))
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(6)]
    rows = []
    base = [f"b{i}" for i in range(100)]
    for n in range(80):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 6))):
            words[rng.randrange(100)] = f"n{next(fresh)}"
        rows.append(" ".join(words))
    for n in range(60):  # one passage of three quarters, another of the rest: alike in part only
        rows.append(" ".join(passages[0] + passages[1] + passages[2] + [f"own{next(fresh)}" for _ in range(35)]))
    for n in range(60):
        rows.append(" ".join(w for k in rng.sample(range(6), 3) for w in passages[k]))
    rows = list(enumerate(rows))
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(rows, 80)) and calls and calls[0] > 10


def test_near_duplicates_null_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert {(4, 2, False), (2, 2, True)} <= got and len(got) == 3


def test_joint_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(3)
    for shared, own in ((900, 50), (500, 250), (100, 900)):
        pool = rng.integers(0, 1 << 63, size=shared + 2 * own, dtype=np.uint64)
        a, b = np.unique(pool[: shared + own]), np.unique(np.concatenate([pool[:shared], pool[shared + own :]]))
        ka, kb = near_dedup.sketch(a), near_dedup.sketch(b)
        j = near_dedup.jaccard_estimate(ka[None], kb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        truth = shared / (shared + 2 * own)
        assert abs(j - truth) < 5 * math.sqrt(truth * (1 - truth) / near_dedup.REGISTERS) + 0.01
        assert (near_dedup.sketch(np.union1d(a, b)) == np.maximum(ka, kb)).all()


def test_quality_against_brute_force(docs, no_docs):
    got = docs.select("doc_id", "text", quality.quality(F.col("text")).alias("q")).collect()
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert (r.q.n_words, r.q.word_chars, r.q.n_dup_lines, r.q.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside))
        assert r.q.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.q.base_failed == failed
        assert not (failed and r.q.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep_good(no_docs).count() == 0


def brute_quality(t, min_words=50):
    """The verdict without labels: base rules, compressed share of the text and of each chunk."""
    import zstandard

    words = WORD.findall(t or "")
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(3)}
    if len(words) < min_words or 100 * len(inside) > 50 * len(words):
        return False
    raw = (t or "").encode()
    share = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    fits = lambda n, r, bands: next(low <= r <= high for most, low, high in bands if n <= most)
    chunks = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
    if len(chunks) > 1 and len(chunks[-1]) < 256:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = sum(not fits(len(c), share(c), ((512, 0.20, 0.95), (1 << 62, 0.12, 0.75))) for c in chunks) if len(chunks) > 1 else 0
    bands = ((512, 0.25, 1.00), (2_048, 0.15, 0.85), (8_192, 0.10, 0.75), (32_768, 0.06, 0.68), (1 << 62, 0.03, 0.65))
    return fits(len(raw), share(raw), bands) and bad <= 0.2 * len(chunks)


@pytest.mark.parametrize("together", [4_000_000, 2_000])
def test_compression_against_brute_force(spark, docs, monkeypatch, together):
    import random

    monkeypatch.setattr(quality, "BATCH_CHARS", together)
    rng = random.Random(6)
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    texts = [" ".join(rng.choice(stems[: rng.choice((3, 30, 900))]) for _ in range(rng.choice((20, 60, 300, 2_000)))) for _ in range(120)]
    texts += ["".join(chr(rng.randrange(33, 127)) + " " * (rng.random() < 0.15) for _ in range(n)) for n in (300, 900, 5_000, 40_000)]
    texts += [texts[3] + " " + texts[-1][:3_000], " ".join(stems) * 40]
    frame = docs.select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = frame.select("text", quality.quality(F.col("text")).alias("q")).collect()
    assert [r.q.kept for r in got] == [brute_quality(r.text) for r in got]
    assert 20 < sum(r.q.kept for r in got) < len(got) - 20


def test_compression_bands_reject_noise_and_repetition():
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(400))
    again = " ".join(f"{i}" for i in range(60)) * 200
    prose = " ".join(rng.choice(["river", "stone", "valley", "crossing", "market", "of", "the", "and", "winter"]) + rng.choice(["", "s", "ing", "ed"]) for _ in range(400))
    assert list(quality.report([noise, again, prose])["kept"]) == [False, False, True]


def labelled(spark, tmp_path):
    """Good prose of two languages with labels, and symbol junk of the same lengths without; the junk's ids."""
    import random

    rng = random.Random(3)
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(stems) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(stems[:60]) if rng.random() < 0.7 else rng.choice("#|*$") * 3 for _ in range(n))
    rows = [(i, prose(rng.randint(300, 340)), "en" if i % 2 else "fr") for i in range(120)] + [(200 + i, junk(350), "en") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_calibrated_bands_decide(spark, tmp_path):
    rows = labelled(spark, tmp_path)
    got = {r.doc_id: r for r in registry.op7_compression_bands(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert not any(r.kept for i, r in got.items() if i >= 200) and all(got[i].kept for i in range(100))
    kept = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_all_rows_labelled_good_set_the_bands(spark, tmp_path):
    import random

    rng = random.Random(8)
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    n = 10_001  # one more than was read at most; the one that was left out is unlike the others
    last = spark.range(n).orderBy(F.xxhash64("id").desc()).first().id
    noise = lambda: " ".join("".join(chr(rng.randrange(48, 123)) for _ in range(5)) for _ in range(72))
    rows = [(i, noise() if i == last else " ".join(rng.choice(stems) for _ in range(60)), "en") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in registry.op7_compression_bands(spark, str(tmp_path)).collect()}
    assert len(got) == n and not any(r.base_failed for r in got.values()) and all(r.kept for r in got.values())
    assert got[last].ratio > max(r.ratio for i, r in got.items() if i != last) + 0.05
    kept = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == n


def test_calibration_against_brute_force(spark):
    import random

    import zstandard

    rng = random.Random(9)
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.choice((60, 200, 210, 380, 700)))), rng.choice(("en", "fr", None))) for i in range(400)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "too short", "en"), (4, rows[3][1] + " again", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = [(i, int(i % 3 != 0), 0) for i in range(300)] + [(4, 1, 1), (500, 1, 0), (501, 1, 0), (502, 1, 0), (None, 1, 0)]
    squeezed = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    good, cells = {i for i, q, _ in labels if q and i is not None and i < 500}, {}
    for i, t, lang in rows:
        if i in good:
            raw, at = t.encode(), 0
            seen = [(False, len(raw), squeezed(raw))]
            for k in quality.chunk_sizes(len(raw)):
                seen.append((True, k, squeezed(raw[at : at + k])))
                at += k
            for c, k, x in seen:
                cells.setdefault((c, lang, sum(e < k for e in quality.EDGES)), []).append(x)
    made = docs.select("doc_id", "lang", quality.measures(F.col("text")).alias("measures"))
    got = quality.calibrate(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for c, limits, generic in zip((False, True), got, quality.GENERIC, strict=True):
        want = quality.limits_of([(lang, b, len(x), min(x), max(x)) for (k, lang, b), x in cells.items() if k == c], generic)
        assert limits.keys() == want.keys()
        assert all((limits[k][j] == want[k][j]).all() for k in want for j in (0, 1))


def test_chunks_cover_the_text():
    import random

    rng = random.Random(4)
    assert all(sum(quality.chunk_sizes(n)) == n for n in range(1300, 9000, 7)) and quality.chunk_sizes(1200) == []
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(stems) for _ in range(n))[:n]
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(3_000))
    out = quality.report([prose(7_000), prose(4_000) + " " + noise, prose(8_192) + noise, prose(8_000) + " " + "again and " * 400])
    assert list(out["kept"]) == [True, False, False, False] and not out["base_failed"].any()
    assert out["chunks_outside"][0] == 0 and out["chunks_outside"][2] == 3 / 11


def test_pieces_of_equal_length_stand_together(spark, docs, tmp_path):
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "no id"), (3, "same id"), (3, "same id")], "doc_id long, text string"))
    out = packing.pack_power_of_two(frame, tokenizer_path())
    packing.write_buckets(out, f"{tmp_path}/packed")
    read = spark.read.parquet(f"{tmp_path}/packed")
    assert read.where("length <> pow(2, bucket) or size(ids) <> length").isEmpty() and read.count() == out.count() > frame.count()
    runs = {}
    for r in out.select(F.spark_partition_id().alias("p"), "sequence_id", "bucket").orderBy("sequence_id").collect():
        if not runs.setdefault(r.p, []) or runs[r.p][-1] != r.bucket:
            runs[r.p].append(r.bucket)
    assert all(len(set(x)) == len(x) for x in runs.values())  # each bucket is one run of consecutive ids in a task
    assert sum(r.length for r in read.where("doc_id is null").collect()) == read.where("doc_id is null").first().doc_tokens


def test_packing_round_trip(docs, no_docs):
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    frame = docs.select("doc_id", "text").dropDuplicates()
    odd = ["<|endoftext|> inside", "two  spaces", "a \n b", " lead", "trail ", "it's we'll", "".join(rng.choice("ab é\t\n'1,") for _ in range(3000))]
    frame = frame.union(frame.sparkSession.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], frame.schema))
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    pieces = packing.pack_power_of_two(frame, tokenizer_path()).collect()
    by_doc = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.length & (p.length - 1) == 0 and p.length <= 1024 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(p.ids)}I", *p.ids))
        by_doc.setdefault(p.doc_id, []).append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for d, t in texts.items():
        own = sorted(by_doc[d], key=lambda p: p.start)
        ids = [i for p in own for i in p.ids]
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert ids == whole.encode(t, add_special_tokens=False).ids + [0] and all(p.doc_tokens == len(ids) for p in own)
    assert packing.pack_power_of_two(no_docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("together", [8_000_000, 500, 1])
def test_chunks_are_encoded_once_for_many_texts(texts, monkeypatch, together):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RUN_BYTES", together)
    rng = random.Random(11)
    odd = ["<|endoftext|>", "a <|endoftext|> b", "a <|endoftext|>", " ", "  ", "   ", "\n", " \n", "\n ", "a ", " a", "a  b", "a \n", "a\n", "\na", "a \nb", "a\n b", "b a\n", "b a\n\n", "b a\n b", "\u3000a b", "a \u3000b", "a\x1c b", "a \x85"]
    odd += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for pieces in (["a", "é", " ", "'s", "1", "\n"], ["it's", "x ", " y", "\t", "\xa0", "日", "\U0001f600", "\x1c", "\u2009"]) for _ in range(400)]
    every = pa.array([*texts, *odd])
    whole, coder = Tokenizer.from_file(tokenizer_path()), packing.TokenBytes(tokenizer_path())
    want = [struct.pack(f"<{len(ids)}I", *ids) for ids in (whole.encode(t or "", add_special_tokens=False).ids for t in every.to_pylist())]
    assert list(coder.many(every)) == want
    assert list(coder.many(every[5:60])) == want[5:60] and list(coder.many(every[:0])) == []
    if together > 500:
        words, seen, encode = ["stone", "rivers,", "Über"], [], coder.encode_ids
        coder.encode_ids = lambda t: (seen.append(t), encode(t))[1]
        list(coder.many(pa.array([" ".join(rng.choice(words) for _ in range(300)) for _ in range(50)])))
        assert sum(map(len, seen)) <= 51 * len(" stone rivers, Über")


def neighbours(spark, rows):
    """(doc_id, text, next text) by plain loops, in the documented order."""
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    return [(d, t, nxt) for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True)]


def brute_anchors(spark, text):
    """Positions and 32-bit hashes of the closed syncmers, by a loop over all k-mers."""
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    head = [w for w in found if w[0] <= 80 and (w[0] < 80 or w[1] > 80)]
    tail = [w for w in found[len(head) :] if w[1] >= len(text) - 80]
    flat, pos = [], []
    for i, (a, b) in enumerate(found):
        spelled = i < len(head) or i >= len(found) - len(tail) or b - a > 16
        flat += list(text[a:b]) if spelled else [text[a:b]]
        pos += [i * (1 << 20) + o for o in range(b - a if spelled else 1)]
    if not flat:
        return []
    h = [r.h for r in spark.createDataFrame([(i, w) for i, w in enumerate(flat)], "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()]
    if len(h) < 5:
        rows = [(0, h)]
        hashed = spark.createDataFrame(rows, "i int, h array<bigint>").select("i", F.xxhash64("h").alias("k"))
    else:
        rows = [(i, h[i : i + 5]) for i in range(len(h) - 4) if min(h[i], h[i + 4]) <= min(h[i + 1 : i + 4])]
        hashed = spark.createDataFrame(rows, "i int, h array<bigint>").select("i", F.xxhash64(*[F.col("h")[j] for j in range(5)]).alias("k"))
    return [(pos[r.i], r.k & 0xFFFFFFFF) for r in sorted(hashed.collect())]


def split_prints(fingerprint):
    return [int(fingerprint[i : i + 8], 16) for i in range(0, len(fingerprint), 8)]


def shares(a, b):
    """Likeness and positional likeness of two lists of (position, hash), by plain sets and loops."""
    x, y = {h for _, h in a}, {h for _, h in b}
    near = len(x & y) / len(x | y) if x | y else 1.0
    common = list(dict.fromkeys(h for _, h in a if h in y))
    best = 0
    for h in [common[0], common[(len(common) + 1) // 2 - 1], common[-1]] if common else ():
        shift = next(p for p, g in a if g == h) - next(p for p, g in b if g == h)
        best = max(best, len(set(a) & {(p + shift, g) for p, g in b}))
    either = len(a) + len(b) - best
    return near, best / either if either else 1.0


def test_fingerprints_against_plain_loops(spark, docs, no_docs, monkeypatch):
    frame = docs.select("doc_id", "text")
    ties = [(7, f"rows of one id number {i} " + "tell more " * i) for i in range(30)] + [(None, "no id"), (None, "no id"), (None, "none either"), (9, None)]
    frame = frame.unionByName(spark.createDataFrame(ties, "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in frame.collect()]
    want = Counter(neighbours(spark, rows))
    for chars, repeats in ((32_000_000, 1_000), (300, 2)):  # one range, and many with ids that fill several
        monkeypatch.setattr(fingerprints, "RANGE_CHARS", chars)
        monkeypatch.setattr(fingerprints, "REPEATS", repeats)
        assert Counter(tuple(r) for r in fingerprints.with_next(frame).collect()) == want
    assert fingerprints.with_next(no_docs).count() == 0
    out = fingerprints.compare(fingerprints.with_next(frame, with_anchors=True)).collect()
    edits = Counter()
    for d, t, nxt in want.elements():
        half = len(t) // 2
        edits[d, t, t[: len(t) - half] + nxt[:half]] += 1
    assert Counter((r.doc_id, r.text, r.edited_text) for r in out) == edits
    following = {(d, t): n for d, t, n in want}
    picked = [r for r in out if len(r.text) > 400][:6] + [r for r in out if "\u65e5" in r.text or r.text in ("", "one", "x" * 5000)] + out[::40]
    for r in picked:
        own, edited = brute_anchors(spark, r.text), brute_anchors(spark, r.edited_text)
        assert [(a.pos, a.hash) for a in r.anchors] == own
        assert split_prints(r.fingerprint) == [h for _, h in own] and split_prints(r.edited_fingerprint) == [h for _, h in edited]
        assert (r.near_edited, r.placed_edited) == pytest.approx(shares(own, edited))
        if want[r.doc_id, r.text, following[r.doc_id, r.text]] == sum(n for k, n in want.items() if k[:2] == (r.doc_id, r.text)):
            assert (r.near_next, r.placed_next) == pytest.approx(shares(own, brute_anchors(spark, following[r.doc_id, r.text])))
    by_text = {}
    for r in out:
        by_text.setdefault(r.text, set()).add(r.fingerprint)
        assert r.text != r.edited_text or (r.near_edited == r.placed_edited == 1.0)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in out if len(r.text) > 400 and len(WORD.findall(r.text)) > 40 and len(set(r.text.split())) > 20]
    assert sum(r.near_edited > 0.15 for r in long) >= 0.95 * len(long)


def test_fingerprints_without_spaces_and_with_shifts(spark):
    cjk = "".join(chr(0x4E00 + 7 * i % 5000) for i in range(400))
    body = " ".join(f"w{i * i % 997}" for i in range(300))
    rows = [(1, cjk, cjk[:200] + "x" * 200), (2, "new words first " + body, body), (3, body, " ".join(reversed(body.split())))]
    got = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string, next_text string")).collect()}
    assert got[1].near_next > 0.3 and got[2].near_next > 0.9 and got[2].placed_next > 0.9 and got[3].placed_next < 0.05


@pytest.mark.parametrize("seed", [1, 2])
def test_no_length_changes_the_alphabet(spark, seed):
    """A text and the same less its last, or first, code point are alike at every length."""
    rng = random.Random(seed)
    prose = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(600))
    sizes = [*range(100, 161), *range(180, 260, 3), 500, 1000, 3000]
    rows = [(n, prose[:n], prose[: n - 1]) for n in sizes] + [(-n, prose[:n], prose[1:n]) for n in sizes]
    got = {r.doc_id: r.near_next for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string, next_text string")).collect()}
    assert min(got[n] for n in range(100, 161)) > 0.9 and min(got.values()) > 0.8 and len(got) == len(rows)


def test_anchor_choice_is_context_free(spark):
    df = spark.createDataFrame([(("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five"),), ("x y alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five",)], "t string")
    words = df.select(F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h"))
    one, two = (r[0] for r in words.select(fingerprints.anchors(F.col("h"), lambda i: (i - 1).cast("long"))).collect())
    assert {(a.pos + 2, a.hash) for a in one} <= {(a.pos, a.hash) for a in two}


@pytest.mark.parametrize(("share", "limit", "evenness"), [(1.0, 4.0, 0.95), (2.0, 2.5, 1.0), (None, 1.5, 1.0), (0.3, 4.0, 0.5)])
def test_mixing(docs, share, limit, evenness):
    out = mixing.mix(docs, budget_share=share, max_repeats=limit, evenness=evenness).collect()
    assert len(out) == docs.count()
    tokens, got, weight, largest = Counter(), Counter(), {}, Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
        got[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
        largest[r.source] = max(largest[r.source], r.n_tokens)
    a, total = out[0].exponent, sum(tokens.values())
    norm = sum((t / total) ** a for t in tokens.values())
    raised = {s: (t / total) ** a / norm for s, t in tokens.items()}
    budget = share * total if share else total / min(raised[s] * total / tokens[s] for s in tokens)
    for s in tokens:
        assert weight[s] == pytest.approx(raised[s])
        assert budget * raised[s] <= (limit + 1e-6) * tokens[s] or a == pytest.approx(1.0)
        assert abs(got[s] - budget * raised[s]) <= largest[s] + 1
    if share is None:
        assert all(r.copies >= 1 for r in out if r.n_tokens)
    again = mixing.mix(docs.repartition(7), budget_share=share, max_repeats=limit, evenness=evenness)
    assert sorted((r.doc_id, r.copies) for r in again.collect()) == sorted((r.doc_id, r.copies) for r in out)


def brute_mix(spark, rows, share, limit, evenness):
    """Exponent, and how often each row (doc_id, source, text) is held, by plain loops; only the hashes are Spark's."""
    tokens = [len(WORD.findall(t or "")) for _, _, t in rows]
    total, of, n_rows = sum(tokens), Counter(), Counter()
    for (_, src, _), n in zip(rows, tokens, strict=True):
        of[src] += n
        n_rows[src] += 1
    p = {s: n / total for s, n in of.items() if n}

    def weights(a):
        norm = sum(x**a for x in p.values())
        return {s: x**a / norm for s, x in p.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def repeats(a):
        ratios = [w / p[s] for s, w in weights(a).items()]
        return max(ratios) / min(ratios) if share is None else share * max(ratios)

    def least(value, target):
        low, high = 0.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if value(mid) > target else (low, mid)
        return high

    a = max(least(entropy, evenness * math.log(len(p))), least(repeats, limit))
    w = weights(a)
    budget = total * share if share is not None else total / min(w[s] / p[s] for s in p) * 1.0
    if share is None:
        budget = total / min(w[s] * total / of[s] for s in p)
    frame = spark.createDataFrame([(i, d, t) for i, (d, _, t) in enumerate(rows)], "i int, doc_id long, text string").withColumn("h", F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text")))
    hashes = {r.i: (r.h, r.g) for r in frame.select("i", "h", F.xxhash64("h", F.lit(17)).alias("g")).collect()}
    copies = [0] * len(rows)
    for src in of:
        if not of[src]:
            continue
        blocks = max(1, -(-of[src] // 32768), -(-n_rows[src] // 4096))
        passes, rest = divmod(math.floor(w[src] * budget + 0.5), of[src])
        own = sorted((hashes[i][1] % blocks, hashes[i][0], i) for i, r in enumerate(rows) if r[1] == src)
        first = 0
        for k, (block, h, i) in enumerate(own):
            if k and own[k - 1][:2] != (block, h):
                first = sum(tokens[j] for *_, j in own[:k])
            copies[i] = passes + (tokens[i] > 0 and first < rest)
    return a, copies


@pytest.mark.parametrize(("share", "limit", "evenness"), [(1.0, 4.0, 0.95), (2.0, 2.5, 1.0), (None, 1.5, 1.0), (0.3, 4.0, 0.5)])
def test_mixing_against_plain_loops(spark, docs, monkeypatch, share, limit, evenness):
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 2)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    rows += [(None, "s1", "no id here"), (None, "s1", "no id here"), (None, "s1", "no id there"), (4, "s1", "another text of one id"), (900, "s2", None)]
    rows += [(1000 + i, "big", f"words of document {i} " * (1 + i % 40)) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    a, copies = brute_mix(spark, rows, share, limit, evenness)
    out = mixing.mix(frame, budget_share=share, max_repeats=limit, evenness=evenness).collect()
    assert out[0].exponent == pytest.approx(a, abs=1e-9)
    want = Counter((i, s, len(WORD.findall(t or "")), c) for (i, s, t), c in zip(rows, copies, strict=True))
    assert Counter((r.doc_id, r.source, r.n_tokens, r.copies) for r in out) == want


def test_mixing_splits_rows_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TIES", 50)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 64)
    rows = [(1, "a", "five words in one row")] * 400 + [(2, "b", "one")] * 40
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), evenness=1.0, max_repeats=9.0).collect()
    per_block = Counter(r.block for r in out if r.source == "a")
    assert len(out) == 440 and len(per_block) > 10 and max(per_block.values()) < 60
    assert abs(sum(r.n_tokens * r.copies for r in out if r.source == "a") - 1680) <= 5  # b stands nine times, a has the rest


def test_mixing_meets_the_target_entropy(spark):
    rows = [(i, "big" if i < 900 else f"s{i % 4}", "w " * 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df, max_repeats=50.0, evenness=0.8).select("source", "weight").distinct().collect()
    assert -sum(r.weight * math.log(r.weight) for r in out) == pytest.approx(0.8 * math.log(5), abs=1e-6)
    assert mixing.mix(df.limit(0)).count() == 0


def test_hash_of_lines_counts_code_points():
    assert line_dedup.line_hashes("é" * 19 + "\n" + "é" * 20, 20) == [None, hashlib.md5(("é" * 20).encode()).digest()]


def test_other_kinds_of_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        json.dump(spec | change, open(tmp_path / "t.json", "w", encoding="utf-8"))
        with pytest.raises(ValueError, match="byte-level"):
            packing.TokenBytes(str(tmp_path / "t.json"))
