from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import AZ, SMALL, edge_docs, small_docs
from tests.llm.test_secrets import brute as secrets
from tests.llm.test_shingles import brute_kept


def masked(text):
    out, done, first = [], 0, True
    for _, a, b in secrets(text):
        if a >= done or first:
            out += [text[done:a], "[SECRET]"]
        done, first = max(done, b), False
    return "".join([*out, text[done:]])


def test_stages_against_plain_versions(spark):
    docs = small_docs(spark)
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SMALL)
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    exact = stages["exact_dedup"](spark, docs, SMALL)
    want = {}
    for i in sorted(rows):
        want.setdefault((rows[i].text or "").translate(AZ), i)
    assert Counter(r.doc_id for r in exact.collect()) == Counter(want.values())
    near = stages["near_dedup"](spark, docs, SMALL)
    texts = [(i, r.text) for i, r in rows.items()]
    assert {r.doc_id for r in near.collect()} == {texts[at][0] for at in brute_kept(texts)}
    clean = stages["secret_scan"](spark, docs, SMALL)
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {i: (masked(r.text), len(masked(r.text))) for i, r in rows.items()}
    for df in (exact, near, clean):
        assert df.columns == docs.columns


def test_run_packs_what_the_stages_keep(spark):
    docs = small_docs(spark)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SMALL).cache()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: 1 + len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    got = Counter()
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id] += r.length
    assert got == want and len(corpus_pipeline.STAGES) == 5


def tables_in(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {f"{f.parent.name}/{f.name}" for f in shared.glob("docgate-*/*")}


def test_run_leaves_only_what_its_result_reads(spark):
    before = tables_in(spark)
    result = corpus_pipeline.run(spark, SMALL)
    assert sorted(f.split("/")[1] for f in tables_in(spark) - before) == ["pieces", "secret_scan"]
    assert result.count() > 0


def test_runs_of_two_threads_keep_apart(spark):
    """Each thread deletes its own tables only."""
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda _: Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())), range(2))
    assert a == b and a


def test_columns_of_any_name_keep_their_values(spark):
    """Every stage but the last hands on the values of all other columns, whatever their names."""
    docs = edge_docs(spark)
    others = [c for c in docs.columns if c not in ("text", "lang", "n_chars")]
    had = {r.doc_id: [r[c] for c in others] for r in docs.collect()}
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SMALL)
        rows = docs.collect()
        assert rows and all([r[c] for c in others] == had[r.doc_id] for r in rows)


def test_awkward_and_empty_tables(spark):
    for empty in (False, True):
        docs = edge_docs(spark, empty)
        for _, apply in corpus_pipeline.STAGES[:-1]:
            docs = apply(spark, docs, SMALL)
            assert docs.columns == edge_docs(spark).columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert (out.count() == 0) == empty
