import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docgate.llm import lm
from docgate.llm.langid import _counts, _tree, identify, normalised, train
from tests.llm.helpers import AZ, SMALL, WORD, edge_docs, small_docs


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_query_is_right_on_held_out_documents(spark):
    from docgate.llm.queries import op8_language_id

    langs = {r.doc_id: (r.lang, r.text) for r in small_docs(spark).collect()}
    rows = op8_language_id(spark, SMALL).collect()
    assert len(rows) == len(langs) and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id][0] for r in held) / len(held) >= 0.95


def test_code_lengths_are_those_of_the_tree(spark):
    """The tables give the lengths that a walk through plain counts gives."""
    texts = {"a": ["abra kadabra abra", "bar bar"], "b": ["berber erb", "rebe"]}
    batches = [pd.DataFrame({"lang": [k for k in texts for _ in texts[k]], "text": [t for k in texts for t in texts[k]]})]
    import pyarrow as pa

    rows = pd.concat(b.to_pandas() for b in _counts(2)(pa.RecordBatch.from_pandas(x) for x in batches))
    model = _tree(("a", "b"), 2, rows)
    chance = np.exp2(-model.bits.reshape(-1, model.width, 2).astype(float))
    assert np.allclose(chance.sum(axis=1), 1, atol=1e-5)  # each context's shares are a distribution

    counts = {lang: Counter() for lang in texts}
    for lang, own in texts.items():
        data = normalised(own)[0].tolist()
        for k in range(3):
            for i in range(k, len(data)):
                if 0 not in data[i - k : i + 1]:
                    counts[lang][tuple(data[i - k : i]), data[i]] += 1
    alphabet = sorted({s for own in counts.values() for _, s in own})
    contexts = {c for own in counts.values() for c, _ in own}

    def share(lang, context, symbol):
        lower = (lambda s: share(lang, context[1:], s)) if context else (lambda s: 1 / (len(alphabet) + 1))
        own = {s: n for (c, s), n in counts[lang].items() if c == context}
        rest = sum(lower(s) for s in [*alphabet, 0] if s not in own)
        if not own:
            return lower(symbol)
        escape = len(own) / (len(own) + sum(own.values()))
        return (1 - escape) * own[symbol] / sum(own.values()) if symbol in own else escape * lower(symbol) / rest

    for text in ("abra", "bar erb", "zzz", "", "kadaber!"):
        data = normalised([text])[0].tolist()
        for j, lang in enumerate(("a", "b")):
            want = 0.0
            for i in range(1, len(data)):
                context = ()
                for k in (1, 2):
                    if i - k >= 0 and tuple(data[i - k : i]) in contexts:
                        context = tuple(data[i - k : i])
                    else:
                        break
                want -= math.log2(share(lang, context, data[i] if data[i] in alphabet else 0))
            assert model.lengths([text])[0, j] == pytest.approx(want, rel=1e-4)


def test_windows_of_a_long_text_count_and_score_alike(monkeypatch):
    """Counts and lengths don't depend on where a text is cut; a text of many windows keeps them small."""
    import pyarrow as pa

    from docgate.llm import langid

    texts = ["abra kadabra " * 50, "", "x", "Ärger über Öl " * 40]
    frame = pa.RecordBatch.from_pydict({"lang": ["a", "a", "b", "b"], "text": texts})

    def counted():
        rows = pd.concat(b.to_pandas() for b in _counts(3)([frame]))
        return rows.groupby(["lang", "k", "key"])["n"].sum().to_dict()

    whole = counted()
    lengths = _tree(("a", "b"), 3, pd.concat(b.to_pandas() for b in _counts(3)([frame]))).lengths(texts)
    monkeypatch.setattr(langid, "WINDOW", 7)
    assert counted() == whole
    assert np.allclose(_tree(("a", "b"), 3, pd.concat(b.to_pandas() for b in _counts(3)([frame]))).lengths(texts), lengths)


def test_a_text_of_100_megabytes_is_learned_from_and_scored():
    import resource

    import pyarrow as pa

    text = "die katze sitzt auf der matte und schläft " * 2_400_000
    frame = pa.RecordBatch.from_pydict({"lang": ["de", "en"], "text": [text, "the cat sat on the mat and slept"]})
    rows = pd.concat(b.to_pandas() for b in _counts(2)([frame])).groupby(["lang", "k", "key"], as_index=False)["n"].sum()
    model = _tree(("de", "en"), 2, rows)
    lengths = model.lengths([text, "the mat"])
    assert lengths[0, 0] < lengths[0, 1] and lengths[1, 1] < lengths[1, 0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3 << 20


def test_each_language_has_contexts_of_its_own(spark):
    """A language with few texts keeps its contexts beside one with many; with all contexts as many are right."""
    rows = [(i, f"lorem ipsum dolor sit {i} amet " * 20, "aa") for i in range(60)] + [(100, "qwxz zxqw wxqz", "bb"), (101, "zzqx wwxq", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "qwxz wxqz"), (2, "dolor amet")], "doc_id long, text string")
    for contexts in (20, None):
        model = train(docs, contexts=contexts)
        assert {r.doc_id: r.lang_pred for r in identify(asked, model).collect()} == {1: "bb", 2: "aa"}


def test_language_of_awkward_rows(spark):
    model = train(small_docs(spark), sample=20)
    docs = edge_docs(spark)
    out = identify(docs, model)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and (letters or r.score == 0)
    assert identify(edge_docs(spark, empty=True), model).count() == 0
    nothing = train(edge_docs(spark, empty=True))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {None, "und"}


def brute_base(rows, trains):
    tokens = {i: [*WORD.findall((t or "").translate(AZ)), None] for i, t in rows}
    c = Counter(w for i, t in tokens.items() if trains(i) for w in t)
    return tokens, c, sum(c.values()), len(c)


def test_lm_query_against_plain_counts(spark, monkeypatch):
    from docgate.llm.queries import op10_lm_score

    rows = [(r.doc_id, r.text) for r in small_docs(spark).collect()]
    tokens, c, n, v = brute_base(rows, lambda i: crc(i, 7) != 2)
    pairs = Counter(p for i, t in tokens.items() if crc(i, 7) != 2 for p in zip([None, *t], t, strict=False))
    out = op10_lm_score(spark, SMALL).collect()
    assert len(out) == len(rows)
    # one weight per context group explains every score
    for r in out:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        best = sum(math.log10(max(pairs[p] / max(c[p[0]], 1), c[p[1]] / n, 1 / (v + 1))) for p in zip([None, *t], t, strict=False))
        assert r.score <= best + 1e-9
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_equal_a_direct_computation_with_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 60)
    monkeypatch.setattr(lm, "BUCKET", 4)
    seen = {}
    plain = lm.mixture
    monkeypatch.setattr(lm, "mixture", lambda *a: seen.setdefault("w", plain(*a)))
    texts = ["a b c a b", "B a", "", None, "c c c d", "e f a b", "a b c", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens, c, n, v = brute_base(rows, lambda i: i != 5)
    pairs = Counter(p for i, t in tokens.items() if i != 5 for p in zip([None, *t], t, strict=False))
    for r in lm.score(docs, F.col("doc_id") != 5).collect():
        want = 0.0
        for a, b in zip([None, *tokens[r.doc_id]], tokens[r.doc_id], strict=False):
            w = seen["w"][min(1 + int(math.log2(c[a])), lm.GROUPS) if c[a] else 0]
            want += math.log10(w[0] * pairs[a, b] / max(c[a], 1) + w[1] * c[b] / n + w[2] / (v + 1))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_weights_are_learned():
    truth = np.array([0.6, 0.3, 0.1])
    rng = np.random.default_rng(1)
    pair, word = rng.integers(-1, 60, 4000), rng.integers(20, 120, 4000)
    shares = np.column_stack([np.where(pair >= 0, np.exp2(-pair / lm.STEPS), 0), np.exp2(-word / lm.STEPS), np.full(4000, 1e-4)])
    cells = pd.DataFrame({"context": 3, "pair": pair, "word": word, "n": np.maximum(1, (shares @ truth * 1e4).astype(int))})
    weights = lm.mixture(cells, 1e-4)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0
    like = lambda w: (np.log(shares @ w) * cells["n"]).sum()
    assert like(weights[3]) >= like(np.array([1 / 3] * 3))


def test_lm_awkward_rows(spark):
    docs = edge_docs(spark)
    out = lm.score(docs, F.col("lang").isNotNull()).collect()
    assert len(out) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert all(r.n_tokens >= 1 for r in out)
    nothing = lm.score(docs, F.lit(False)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)
    assert lm.score(edge_docs(spark, empty=True), F.lit(True)).count() == 0


def test_long_texts_go_through_in_windows(monkeypatch):
    """Code lengths don't depend on where windows end."""
    import pyarrow as pa

    from docgate.llm import langid

    texts = {"a": ["abra kadabra abra", "bar bar"], "b": ["berber erb", "rebe"]}
    frame = pa.table({"lang": [k for k in texts for _ in texts[k]], "text": [t for k in texts for t in texts[k]]})
    model = _tree(("a", "b"), 3, pd.concat(b.to_pandas() for b in _counts(3)(frame.to_batches())))
    asked = ["abra bar" * 50, "", "erb", "q", "reber abra " * 30]
    whole = model.lengths(asked)
    for window in (1, 2, 5, 64):
        monkeypatch.setattr(langid, "WINDOW", window)
        assert np.allclose(model.lengths(asked), whole)


def test_weights_are_learned_from_every_token(spark, monkeypatch):
    """The cells that expectation-maximisation gets hold each token to learn from once, however many blocks there are."""
    gathered = []
    plain = lm.mixture
    monkeypatch.setattr(lm, "mixture", lambda cells, *rest: gathered.append(int(cells["n"].sum())) or plain(cells, *rest))
    docs = small_docs(spark).repartition(7).cache()
    rows = lm.score(docs, F.col("doc_id") % 3 != 1).collect()
    assert gathered == [sum(r.n_tokens for r in rows if not r.held_out)] == [rows[0].train_tokens]
