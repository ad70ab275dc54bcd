import random

import pytest
from pyspark.sql import functions as F

VOCAB = [a + b + c for a in ("ta", "mo", "ri", "Ké", "LU") for b in ("n", "st", "v", "ss") for c in ("a", "eu", "IR", "o,", "é.")]


def make_texts(seed=5, n=60):
    """Prose, exact and near copies, shared lines, repetition and odd cases."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(VOCAB) for _ in range(k))
    shared = ["This Line is shared by many documents", "  this line IS shared by many documents\t", "short", "Another common line, with é inside it"]
    out = []
    for _ in range(n):
        out.append("\n".join(prose(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))))
    for i in range(12):
        words = out[i].split(" ")
        if len(words) > 3:
            words[rng.randrange(len(words))] = "CHANGED"
        out.append(" ".join(words))
    for i in range(8):
        out.append(out[20 + i].upper() if i % 2 else out[20 + i])
    base = prose(120).split(" ")
    for i in range(25):  # a chain of drifting copies
        base[i * 4 % 120] = f"drift{i}"
        out.append(" ".join(base))
    for i in range(10):
        out.append("\n".join([prose(12), shared[i % 4], prose(9), shared[(i + 1) % 4]]))
    out += [None, "", " ", "\n", "one", "one two three", "one  two\nthree", "a " * 300, "again again " * 80, "x" * 5000, "日本語 の テキスト \U0001f600 も ある", "tail\r\nline\r\n", "\x1c sep \x85 \xa0 wide"]
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """(doc_id, text) and columns whose names clash with those of the operators."""
    rows = [(3 * i + 1, t, f"s{i % 3}" if i % 7 else None, 1) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int").repartition(4)
    for c in ("h", "id", "n", "key", "bucket", "registers", "rule", "cleaned", "copies", "start", "length", "root"):
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
