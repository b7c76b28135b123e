"""Tables of awkward rows for the operators of docgate.llm."""

import re

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASHING = ["norm", "salt", "digest", "pos", "ids", "secrets", "fingerprint", "block", "trains", "lang_pred", "score", "_part", "_key", "key", "side", "part", "rank"]
TEXTS = [
    None, "", " ", "\n\t", "a", "A", "É", "é", "Hello world", "HELLO WORLD", "hello world", "Hello world", "x " * 30_000, "token = abcdefgh",
    "don't  stop\n\nnow <|endoftext|> ", "12345 :::     end", "the cat sat on the mat and the cat ate", "日本語のテキスト 😀",
]
#: Lower-casing of A-Z alone.
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge_docs(spark, empty=False):
    """Awkward texts, one row twice, nulls in the other columns, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i * 3, t, None if i % 4 == 0 else "en", None, None, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([] if empty else [*rows, rows[8]], schema)


def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
