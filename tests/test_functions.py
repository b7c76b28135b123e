import random
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docgate import fixed
from docgate.functions import amounts, personal, similarity, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_fold_and_quote_form(spark):
    assert column(spark, ["Licitación", "STRASSE ß", "d’avis", None], text.fold) == ["licitacion", "strasse ss", "d'avis", None]
    assert column(spark, ["A  b\n“c” – d", "É ﬁ"], text.quote_form) == ['a b "c" - d', "é fi"]


def test_first_line(spark):
    assert column(spark, ["\n  \nTitle\nx", "", "a\x0bb", None], text.first_line) == ["Title", "", "a", ""]


@pytest.mark.parametrize(
    ("name", "form"),
    [("Acme GmbH", "acme"), ("ACME, G.m.b.H.", "acme"), ("Foo & Bar Ltd.", "foo bar"), ("AG", "ag"), ("Sp. z o.o.", "sp z o o"), ("Über-Werk OÜ", "über werk")],
)
def test_company_form(spark, name, form):
    assert column(spark, [name], text.company_form) == [form]


def test_numbers(spark):
    got = column(spark, ["EUR 500,000.00", "Section 3.2, 45 days", "15 March 2024", "no number", "1 000 and 1.234.567,89"], text.numbers_in)
    assert [sorted(x) for x in got] == [["500000", "50000000"], ["2", "3", "45"], ["15", "2024"], [], ["1000", "1234567", "123456789"]]
    words = ["net thirty days", "MAINTENANCE is written", "sechsunddreißig Monate", "сто дни", "петнадесет дни", "eine Woche", "veinticuatro meses"]
    assert column(spark, words, text.states_a_number) == [True, False, True, True, True, False, True]


def test_jurisdictions(spark):
    stated = ["English law", "the laws of England", "deutschem Recht", "la legislación española", "le droit français", "New South Wales, Australia", "England and Wales", "The Netherlands", None]
    want = ["england & wales", "england", "germany", "spain", "france", "new south wales, australia", "england & wales", "netherlands", None]
    # leads go one after another, so what remains of "the laws of england" is its country
    assert column(spark, stated, text.jurisdiction) == want
    rows = spark.createDataFrame([("German", "germany")], "v string, n string").select(text.phrasings(F.col("v"), F.col("n"))).first()[0]
    assert "german" not in rows and {"germany", "german law", "deutsches recht"} <= set(rows)


def test_labels_and_shortening(spark):
    assert column(spark, ["liability_cap", "some_other_FIELD"], text.label) == ["Liability cap", "Some other field"]
    long = "word " * 200
    short = column(spark, [long, "a  b"], text.shorten)
    assert short[1] == "a b" and short[0].endswith("word [...]") and len(short[0]) <= 426


def test_clauses(spark):
    said = "The Supplier shall be paid within 45 days of receipt.\nThis agreement of 2024 runs for 24 months in total.\nA cap of EUR 500,000 applies to all claims.\n"
    got = column(spark, [said], text.clauses)[0]
    assert [r.number for r in got] == [45, 24, 500000]


def _compose(x):
    return unicodedata.normalize("NFC", x)


@pytest.mark.parametrize(
    ("said", "category"),
    [
        ("IBAN BG80BNBG96611020345678 here", "iban"), ("DE89 3704 0044 0532 0130 00", "iban"), ("DE89 3704 0044 0532 0130 00", "iban"),
        ("ЕГН 7523169263", "national_id"), ("DNI: 12345678Z", "national_id"), ("NIE X1234567L", "national_id"),
        ("Card no. 4111 1111 1111 1111", "card"), ("mail a.b@example.org now", "email"), ("tel +359 2 123 4567", "phone"),
    ],
)
def test_masking(spark, said, category):
    got = column(spark, [_compose(said)], personal.mask)[0]
    assert got.counts == {category: 1} and fixed.MASKS[category] in got.text


@pytest.mark.parametrize("said", ["order 4111 1111 1111 1111", "DE89 3704 0044 0532 0130 01", "ЕГН 7523169264", "HRB 84421", "BG175074752", "SIRET 73282932000074", "invoice 1234567890"])
def test_what_is_not_masked(spark, said):
    assert column(spark, [said], personal.mask)[0].text == said


def test_mask_of_nothing(spark):
    got = column(spark, [None, ""], personal.mask)
    assert (got[0].text, got[0].counts) == (None, None) and (got[1].text, got[1].counts) == ("", {})


def test_checksums_as_columns(spark):
    assert column(spark, ["DE89370400440532013000", "de89 3704 0044 0532 0130 00", "DE89370400440532013001", "XX00", "DE8937040044053201300"], personal.iban) == [True, True, False, False, False]
    assert column(spark, ["7523169263", "7523169264", "7599169263", "abc"], personal.egn) == [True, False, False, False]
    assert column(spark, ["12345678Z", "12345678-z", "12345678A"], personal.dni) == [True, True, False]
    assert column(spark, ["X1234567L", "X1234567A"], personal.nie) == [True, False]
    good = "1850578006084"
    assert column(spark, [good + f"{97 - int(good) % 97:02d}", good + "00"], personal.nir) == [True, False]
    assert column(spark, ["4111111111111111", "4111111111111112", "411111111111"], personal.card) == [True, False, False]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200 * lcs(a, b) / (len(a) + len(b)) if a + b else 100.0


def test_token_sort_ratio(spark):
    pairs = [("acme tools", "tools acme"), ("globex", "globx"), ("", ""), ("", "a"), ("abc def", "abd cef"), ("é a", "a é"), ("aaaa", "aa")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select(similarity.token_sort_ratio(F.col("a"), F.col("b")), similarity.could_reach(F.col("a"), F.col("b"), 85.0)).collect()
    for (a, b), (r, possible) in zip(pairs, got, strict=True):
        assert r == pytest.approx(ratio(a, b)) and (possible or r < 85)


def test_amounts(spark):
    row = spark.range(1).select(
        amounts.cost_usd(*[F.lit(x) for x in (1000, 100, 2000, 500)], F.lit(3.0), F.lit(15.0)).alias("usd"),
        amounts.cache_hit_ratio(F.lit(1), F.lit(1), F.lit(2)).alias("ratio"),
        amounts.cache_hit_ratio(F.lit(0), F.lit(0), F.lit(0)).alias("none"),
        amounts.text_tokens(F.lit("x" * 37)).alias("text"),
        amounts.image_tokens(F.lit(800), F.lit(1100)).alias("image"),
        amounts.image_size(F.lit(2800), F.lit(1400)).alias("small"),
        amounts.image_size(F.lit(100), F.lit(50)).alias("same"),
        amounts.render_scale(F.lit(100), F.lit(50)).alias("scale"),
        amounts.duration(F.lit(900)).alias("ms"),
        amounts.duration(F.lit(1234)).alias("s"),
        amounts.chosen_model(F.lit(""), F.lit("m")).alias("model"),
        amounts.number(F.lit(" 5.5 ")).alias("five"),
        amounts.number(F.lit("five")).alias("word"),
        amounts.number(F.lit("NaN")).alias("nan"),
    ).first()
    assert row.usd == pytest.approx((3000 + 375 + 600 + 7500) / 1e6)
    assert (row.ratio, row.none, row.text, row.image) == (0.5, 0.0, 10, 1173)
    assert tuple(row.small) == (1400, 700) and tuple(row.same) == (100, 50) and row.scale == 4.0
    assert (row.ms, row.s, row.model, row.five, row.word, row.nan) == ("900ms", "1.2s", "m", 5.5, None, None)


def test_retry_times(spark):
    rows = spark.createDataFrame([(n,) for n in range(6)], "n int").select(amounts.retry_at(F.lit(datetime(2024, 1, 1)), F.col("n")).alias("t")).collect()
    assert [(r.t - datetime(2024, 1, 1)).total_seconds() for r in rows] == [30, 30, 120, 300, 300, 300]


def test_no_invoice_term_holds_another():
    assert not [(a, b) for a in fixed.INVOICE for b in fixed.INVOICE if a != b and a in b]


def test_one_automaton_finds_what_term_by_term_does(spark):
    """Terms inside of words, of several vocabularies, overlapping, and with accents and case."""
    rng = random.Random(11)
    terms = [*fixed.STRONG, *fixed.SUPPORTING, *fixed.INVOICE]
    texts = [" ".join(rng.choice([rng.choice(terms).upper(), rng.choice(terms)[1:], "word", "Ünïcode"]) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", "".join(terms)]
    folded = [text.fold_text(t) for t in texts]
    for t, f in zip(texts, folded, strict=True):
        want = {name: [x for x in map(text.fold_text, own) if x in f] for name, own in text.VOCABULARY.items()}
        assert text.found_text(t) == want
    rows = spark.createDataFrame([(t,) for t in [*texts[:3], None]], "t string").select(text.found(F.col("t")).alias("f")).collect()
    assert [r.f.strong for r in rows][-1] == []
