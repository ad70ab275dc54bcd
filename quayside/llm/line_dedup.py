"""Line dedup: drop lines that many documents share.

Lines are normalised (ASCII white space stripped at both ends, A-Z lower-cased)
and hashed with 128 bits; the hashes of each document are written once.  Documents
are made distinct for each hash by the pair of both, and then counted with
map-side partial sums, so a line that stands in a third of all documents costs
one row per task.  Hashes over the threshold go to a written table; joining it
back gives each document the hashes that it loses, and the kept lines are put
together again in their order.  Only hashes are shuffled by line; texts move
once at most, by document.

Defined results: a null or empty text is one empty line; rows with the same id
are one document, which counts once for a line and loses the same lines in all
its rows; each row with a null id is a document of its own that counts but keeps
all its lines; a line that stands several times in a document counts once and
is dropped or kept in all its places; other columns pass through untouched, but
for one that is named as ``into``, which is replaced.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from quayside.llm.common import named, stored

MIN_CHARS = 20
MIN_DOCS = 3

_DROPPED = "__line_dedup_dropped"
_ID = "__line_dedup_id"

CLEANED = StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType())])


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 16-byte hash for each line; None for a line whose key is shorter than min_chars code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip().lower()  # bytes: ASCII white space and A-Z only
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(hashlib.md5(key, usedforsecurity=False).digest() if long_enough else None)
    return out


def distinct_hashes(text: Column, min_chars: int) -> Column:
    @pandas_udf(ArrayType(BinaryType()))
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([list({h for h in line_hashes(t, min_chars) if h}) for t in texts], dtype=object)

    return hashes(text.cast("string"))


def without_lines(text: Column, dropped: Column, min_chars: int) -> Column:
    @pandas_udf(CLEANED)
    def clean(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for t, drop in zip(texts, drops, strict=True):
            lines = (t or "").split("\n")
            if drop is None:
                rows.append((len(lines), 0, t or ""))
                continue
            gone = set(drop)
            keep = [x for x, h in zip(lines, line_hashes(t, min_chars), strict=True) if h not in gone]
            rows.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])

    return clean(text.cast("string"), dropped)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, into: str = "cleaned") -> DataFrame:
    """``docs`` with the column ``into``: struct<n_lines, n_dropped, text>.

    Keys found in at least ``min_docs`` documents lose their lines everywhere
    except in the largest id that holds them.
    """
    row = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    held = stored(docs.select(F.col(id_col).alias("id"), row.alias("row"), F.explode(distinct_hashes(F.col(text_col), min_chars)).alias("h")), "line-hashes")
    once = held.distinct()
    common = once.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    common = stored(common.where(F.col("n") >= min_docs).select("h", "last"), "common-lines")
    dropped = held.join(common, "h").where(F.col("id") < F.col("last")).groupBy("id").agg(F.collect_set("h").alias(_DROPPED)).withColumnRenamed("id", _ID)
    out = docs.join(dropped, docs[id_col] == dropped[_ID], "left")
    return out.withColumn(into, without_lines(F.col(text_col), F.col(_DROPPED), min_chars)).drop(_DROPPED, _ID)


def replace_text(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the same columns, ``text_col`` holding the kept lines."""
    new = "__line_dedup_cleaned"
    out = dedup_lines(docs, text_col=text_col, into=new, **options)
    return out.select(*[F.col(f"{new}.text").alias(c) if c == text_col else named(c) for c in docs.columns])
