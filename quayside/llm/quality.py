"""Quality rules by compression bands.

Each whole text is compressed with zstandard, and so is each of its fixed
chunks.  Text that shrinks far more than prose of its length repeats itself;
text that hardly shrinks is noise.  Both limits depend on the length, as short
texts compress worse, and on the language.  ``calibrate`` sets them from
all texts labelled good; without labels ``BANDS`` hold, which only reject
extremes.  Every text is measured once: what a verdict needs of it is stored, and
serves both the calibration and the verdict.  Word counts and repetition counts
are returned beside the verdict.

Defined results: a null text counts as empty; an empty text has no words and
fails the base rule; very long texts are measured whole, and in chunks of the
same size from the first byte to the last; repeated rows get the same verdict each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from quayside.llm.common import named, stored

#: (bytes up to, least and most compressed share of the whole text) where nothing is calibrated.
BANDS = ((512, 0.25, 1.00), (2_048, 0.15, 0.85), (8_192, 0.10, 0.75), (32_768, 0.06, 0.68), (1 << 62, 0.03, 0.65))
#: Calibrated bands end at these bytes, two an octave; the last one is open.
EDGES = [round(256 * 2 ** (i / 2)) for i in range(17)]
#: Rows labelled good that a band of one language needs at least.
MIN_GOOD = 20
#: A text is cut every so many bytes; a shorter rest than ``MIN_TAIL`` stays with the chunk before it.
CHUNK_BYTES, MIN_TAIL = 1_024, 256
#: Code points of the texts that a task measures together.
BATCH_CHARS = 4_000_000
#: As ``BANDS``, for one chunk, and the share of chunks that may be outside.
CHUNK_BANDS, CHUNK_SHARE = ((512, 0.20, 0.95), (1 << 62, 0.12, 0.75)), 0.2
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

COUNTS = [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
REPORT = StructType([*COUNTS, *[StructField(c, DoubleType()) for c in ("ratio", "chunks_outside")], *[StructField(c, BooleanType()) for c in ("base_failed", "kept")]])
#: What verdicts and calibrations need of a text: its counts and base verdict, the bytes and compressed share of the whole, and the share of each of its chunks.
MEASURES = StructType([*COUNTS, StructField("n_bytes", LongType()), StructField("ratio", DoubleType()), StructField("shares", ArrayType(DoubleType())), StructField("base_failed", BooleanType())])


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, the words that stand in a 3-word window found twice or more.

    codes: word codes of all texts in a row; doc: each word's document.
    """
    out = np.zeros(n_docs, dtype=np.int64)
    if len(codes) < 3:
        return out
    inside = doc[2:] == doc[:-2]
    width = int(codes.max()) + 1
    pair = pd.factorize(codes[:-2] * width + codes[1:-1])[0].astype(np.int64)
    triple = pd.factorize(pair * width + codes[2:])[0].astype(np.int64)
    key, back = np.unique((triple * n_docs + doc[:-2])[inside], return_inverse=True)
    twice = np.zeros(len(codes), dtype=bool)
    twice[np.flatnonzero(inside)[np.bincount(back, minlength=len(key))[back] > 1]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    np.add.at(out, doc[covered], 1)
    return out


def chunk_sizes(n: int) -> list[int]:
    """Sizes of the chunks of n bytes, from the first byte to the last; none where there is only one."""
    whole, rest = divmod(n, CHUNK_BYTES)
    sizes = [CHUNK_BYTES] * whole
    if rest >= MIN_TAIL:
        sizes.append(rest)
    elif sizes:
        sizes[-1] += rest
    return sizes if len(sizes) > 1 else []


def compression(raw: bytes, squeeze) -> tuple[float, list[float]]:
    """Compressed share of the text and of each of its chunks."""
    chunks, at = [], 0
    for n in chunk_sizes(len(raw)):
        chunks.append(len(squeeze(raw[at : at + n])) / n)
        at += n
    return len(squeeze(raw)) / len(raw), chunks


def _generic(bands: tuple) -> tuple[np.ndarray, np.ndarray]:
    band = np.searchsorted([b[0] for b in bands], [*EDGES, EDGES[-1] + 1])
    return tuple(np.array([b[k] for b in bands])[band] for k in (1, 2))


#: By language (None: any other one), the least and the most compressed share in each band of ``EDGES``.
Limits = dict[str | None, tuple[np.ndarray, np.ndarray]]


class Bands(NamedTuple):
    whole: Limits
    chunk: Limits


GENERIC = Bands({None: _generic(BANDS)}, {None: _generic(CHUNK_BANDS)})


def limits_of(cells: list[tuple[str | None, int, int, float, float]], generic: Limits = GENERIC.whole) -> Limits:
    """Limits from (language, band, rows, least and most share) of good texts.

    They lie a margin outside what was seen, which shrinks with the root of the
    rows.  A language with fewer than ``MIN_GOOD`` rows in a band takes the band
    of all languages; a band that lacks them too goes on as the shorter ones do,
    and the bands below the first one take its lower limit.
    """
    every: dict[int, tuple[int, float, float]] = {}
    own = {}
    for lang, band, n, low, high in cells:
        m, a, b = every.get(band, (0, low, high))
        every[band] = (m + n, min(a, low), max(b, high))
        own[lang, band] = (n, low, high)
    out: Limits = {}
    for lang in {None, *(c[0] for c in cells)}:
        lows, highs = (x.copy() for x in generic[None])
        known = -1
        for band in range(len(lows)):
            n, low, high = own.get((lang, band), (0, 0.0, 0.0)) if lang is not None else (0, 0.0, 0.0)
            if n < MIN_GOOD:
                n, low, high = every.get(band, (0, 0.0, 0.0))
            if n >= MIN_GOOD:
                margin = (high - low) / n**0.5
                lows[band], highs[band] = low - margin, high + margin
                known = band if known < 0 else known
            elif 0 <= known:
                drop = max(0.0, lows[band - 2] - lows[band - 1]) if band - 2 >= known else 0.0
                lows[band], highs[band] = max(lows[band], lows[band - 1] - drop), highs[band - 1]
        if known > 0:
            lows[:known] = np.maximum(lows[:known], lows[known])
        out[lang] = (lows, highs)
    return out


def inside(sizes, shares, langs, limits: Limits) -> np.ndarray:
    """Whether each compressed share is within the limits of its size and language."""
    band = np.searchsorted(EDGES, sizes)
    pick = [limits.get(x) or limits[None] for x in langs]
    low, high = (np.array([p[k][b] for p, b in zip(pick, band, strict=True)]) for k in (0, 1))
    return (low <= shares) & (shares <= high)


def measure(texts: list[str], min_words: int = MIN_WORDS) -> pd.DataFrame:
    """The columns of ``MEASURES`` for each text."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raws]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    codes = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    out = pd.DataFrame({"n_words": counts})
    out["word_chars"] = [len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts]
    out["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in texts]
    dup = []
    for r in raws:
        lines = [x for x in r.split(b"\n") if x.strip()] if b"\n" in r else ()
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = dup
    out["n_repeat_words"] = repeated_words(codes, doc, len(texts))
    shares = [compression(r, squeeze) if r else (0.0, []) for r in raws]
    out["n_bytes"] = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    out["ratio"] = np.array([s[0] for s in shares], dtype=float)
    out["shares"] = [s[1] for s in shares]
    out["base_failed"] = (counts < min_words) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * counts)
    return out


def verdicts(seen: pd.DataFrame, langs: list[str | None], limits: Bands) -> pd.DataFrame:
    """The columns of ``REPORT`` for each row of ``MEASURES``."""
    out = seen.drop(columns=["n_bytes", "shares"])
    n_bytes, n_chunks = seen["n_bytes"].to_numpy(), np.fromiter(map(len, seen["shares"]), dtype=np.int64, count=len(seen))
    of, some = np.repeat(np.arange(len(seen)), n_chunks), n_chunks > 0
    sizes = np.full(len(of), CHUNK_BYTES, dtype=np.int64)
    sizes[np.cumsum(n_chunks)[some] - 1] = (n_bytes - CHUNK_BYTES * (n_chunks - 1))[some]  # the last chunk has what the others leave
    each = np.fromiter((c for cs in seen["shares"] for c in cs), dtype=float, count=len(of))
    bad = np.bincount(of[~inside(sizes, each, [langs[i] for i in of], limits.chunk)], minlength=len(seen))
    out["chunks_outside"] = bad / np.maximum(n_chunks, 1)
    fits = inside(n_bytes, seen["ratio"].to_numpy(), langs, limits.whole) & (out["chunks_outside"].to_numpy() <= CHUNK_SHARE)
    out["kept"] = ~seen["base_failed"].to_numpy(dtype=bool) & fits
    return out[REPORT.names]


def report(texts: list[str], langs: list[str | None] | None = None, limits: Bands = GENERIC, min_words: int = MIN_WORDS) -> pd.DataFrame:
    return verdicts(measure(texts, min_words), langs or [None] * len(texts), limits)


def _in_runs(texts: pd.Series, min_words: int) -> pd.DataFrame:
    parts, run, size = [], [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= BATCH_CHARS:
            parts.append(measure(run, min_words))
            run, size = [], 0
    if run or not parts:
        parts.append(measure(run, min_words))
    return pd.concat(parts, ignore_index=True)


def measures(text: Column, min_words: int = MIN_WORDS) -> Column:
    """A struct ``MEASURES`` of a text."""

    @pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return _in_runs(texts, min_words)

    return measured(text.cast("string"))


def verdict(seen: Column, lang: Column, limits: Bands) -> Column:
    """A struct ``REPORT`` from a struct ``MEASURES``."""

    @pandas_udf(REPORT)
    def judge(rows: pd.DataFrame, langs: pd.Series) -> pd.DataFrame:
        return verdicts(rows, list(langs), limits)

    return judge(seen, lang.cast("string"))


def quality(text: Column, lang: Column | None = None, limits: Bands = GENERIC, min_words: int = MIN_WORDS) -> Column:
    """A struct with the counts, the compressed shares and the verdict of a text."""

    @pandas_udf(REPORT)
    def judge(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        return verdicts(_in_runs(texts, min_words), list(langs), limits)

    return judge(text.cast("string"), (F.lit(None) if lang is None else lang).cast("string"))


def calibrate(seen: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", measures_col: str = "measures") -> Bands:
    """Limits from the measures of all documents that ``labels`` give quality 1.

    Texts that fail the base rules are left out.  A few numbers a band and
    language reach the driver.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__good_id"))
    m = F.col(measures_col)
    rows = seen.where(~m["base_failed"]).select(
        F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"), m["n_bytes"].alias("n"), m["ratio"].alias("ratio"), m["shares"].alias("shares")
    )
    rows = rows.join(good, F.col("__id") == F.col("__good_id"), "left_semi")
    last = F.size("shares") - 1
    whole = F.array(F.struct(F.lit(False).alias("chunk"), F.col("n").alias("size"), F.col("ratio").alias("share")))
    chunks = F.transform("shares", lambda x, i: F.struct(F.lit(True).alias("chunk"), F.when(i < last, F.lit(CHUNK_BYTES)).otherwise(F.col("n") - CHUNK_BYTES * last).alias("size"), x.alias("share")))
    each = rows.select("lang", F.inline(F.concat(whole, chunks)))
    band = F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: e < F.col("size")))
    cells = each.groupBy("chunk", "lang", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("low"), F.max("share").alias("high")).collect()
    return Bands(*[limits_of([tuple(r)[1:] for r in cells if r.chunk == c], g) for c, g in zip((False, True), GENERIC, strict=True)])


def lang_of(docs: DataFrame) -> str | None:
    return "lang" if "lang" in docs.columns else None


def labels_in(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table ``labels``; None where there is none."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def judged(docs: DataFrame, labels: DataFrame | None, columns: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """``columns`` of all documents and their ``REPORT`` in struct column ``__quality``.

    Limits are calibrated by ``labels``, the generic ones where there are none.
    """
    out = [named(c) for c in columns]
    lang = F.lit(None).cast("string") if lang_of(docs) is None else F.col("lang").cast("string")
    if labels is None:
        return docs.select(*out, quality(F.col("text"), lang, GENERIC, min_words).alias("__quality"))
    seen = docs.select(*out, F.col("doc_id").alias("__quality_id"), lang.alias("__quality_lang"), measures(F.col("text"), min_words).alias("__quality_measures"))
    seen = stored(seen, "quality-measures")
    limits = calibrate(seen, labels, id_col="__quality_id", lang_col="__quality_lang", measures_col="__quality_measures")
    return seen.select(*out, verdict(F.col("__quality_measures"), F.col("__quality_lang"), limits).alias("__quality"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = None, limits: Bands = GENERIC, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that pass both the base rules and the compression bands, with all their columns."""
    return docs.where(quality(F.col(text_col), None if lang_col is None else F.col(lang_col), limits, min_words)["kept"])
