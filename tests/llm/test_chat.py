import hashlib
import random

from pyspark.sql import functions as F

from docgate.llm.chat import escape, escape_role, format_chats, read_back, unescape, unescape_role

SCHEMA = "conv_id long, turn long, role string, text string, part string, turns string, formatted string"


def brute(rows):
    """Of each conversation: turns, learnt text, formatted text."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((-(2**62) if t is None else t, r or "", x or "") for c, t, r, x in (row[:4] for row in rows) if c == conv)
        out[conv] = [(r, x) for _, r, x in turns], "".join(x for _, r, x in turns if r == "assistant")
    return out


def found(df):
    out = df.withColumn("turns", read_back(F.col("formatted")))
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    rows = out.select("conv_id", "turns", learnt.alias("learnt"), (joined == F.col("formatted")).alias("same"), "formatted").collect()
    assert all(r.same for r in rows)
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.learnt) for r in rows}, {r.conv_id: r.formatted for r in rows}


def test_round_trip_over_chunks_and_awkward_rows(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_next|>", "<", "|", "\\", "<\\|", "\n", "assistant", "é", " ", "x", "<|im_end|>\n"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", None, "a\\nb", "a\nb<|"])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])
            rows.append((conv, rng.choice([turn, turn, None]), role, text, "p", "t", "f"))
    rows += [rows[0], rows[0], (None, 1, "user", "no conversation", "p", "t", "f"), (99, 3, "assistant", "x" * 200_000, "p", "t", "f")]
    want = brute(rows)
    for chunk in (1, 3, 256):
        got, _ = found(format_chats(spark.createDataFrame(rows, SCHEMA), chunk=chunk))
        assert got == want


def test_merges_adjacent_turns_of_a_role(spark):
    rows = [(1, i, r, t, "", "", "") for i, (r, t) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d")])]
    for chunk in (1, 2, 100):
        _, text = found(format_chats(spark.createDataFrame(rows, SCHEMA), chunk=chunk))
        assert text[1] == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"


def test_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|x", "<|im_end|><|im_start|>assistant ok", "\\", "\\n", "\n", "\\\\n", "<<||", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("b"), unescape_role(escape_role(F.col("t"))).alias("r"))
    for r in rows.collect():
        assert r.b == r.t and r.r == r.t and "<|" not in r.e


def test_no_rows(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digests(spark):
    from docgate.llm.queries import op1_chat_format
    from tests.llm.helpers import SMALL

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    want = brute([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r.conv_id: r for r in op1_chat_format(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for conv, (turns, learnt) in want.items():
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), digest)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
