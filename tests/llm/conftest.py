import random
import re

import pytest
from pyspark.sql import Row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASHES = ["score", "kept", "node", "component", "label", "toxicity", "bucket", "copy", "h", "ids", "row", "host", "_id"]


def lowered(text):
    return (text or "").translate(LOWER)


def split(text):
    return WORD.findall(text or "")


def make_text(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


ODD = [
    (None, "a row without an id and a few more words to see", None, None, None),
    (90001, None, None, "src0", None),
    (90002, "", "en", "src0", 0),
    (90003, " \t\n\x0b\x0c\r ", "en", "src0", 6),
    (90004, "single", "en", None, 6),
    (90005, "four words are here", "en", "src0", 19),
    (90006, "ünï cödé ★★★ 'tis 漢字 ΑΣ don't \x1c no break wide", "xx", "src1", 40),
    (90007, "same row", "en", "src1", 8),
    (90007, "same row", "en", "src1", 8),
    (90008, "line one\nline one\n\n  line one\nLINE ONE\r\nline two " + "z" * 5000, "en", "src1", 5000),
    (90009, "x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x", "en", "src1", 1),
]


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as a table of several files and reads it back."""

    def make(rows, schema=SCHEMA, files=3, extra=False):
        df = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
        if extra:
            for k, c in enumerate(c for c in CLASHES if c not in df.columns):
                df = df.selectExpr("*", f"{'cast(null as string)' if k % 2 else k} AS `{c}`")
        path = str(tmp_path_factory.mktemp("t") / "t.parquet")
        df.repartition(files).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, and the odd ones."""
    rng = random.Random(5)
    rows, n = [], 0
    passage = make_text(rng, 60, 3000)

    def add(text, source="src0"):
        nonlocal n
        rows.append((n, text, "en", source, len(text)))
        n += 1

    for _ in range(60):
        add(make_text(rng, rng.randint(3, 300), 3000), f"src{rng.randint(0, 3)}")
    for k in range(12):
        add(rows[k][1])
    for k in range(20, 32):
        add(passage + " " + rows[k][1] + "\n" + passage)
    for k in range(10):
        w = rows[40][1].split()
        w[rng.randrange(len(w))] = f"new{k}"
        add(" ".join(w))
    base = make_text(rng, 150, 100000).split()
    for _ in range(25):  # about half of these pairs are links
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        add(" ".join(w))
    add(make_text(rng, 30000, 30000))
    return rows + ODD


def as_rows(df):
    return [Row(**r.asDict()) for r in df.collect()]
