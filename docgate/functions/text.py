"""Text functions on columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate import fixed

_QUOTES = {"’": "'", "‘": "'", "´": "'"}


def fold_text(text: str) -> str:
    """Caseless, without accents, typographic apostrophes as plain ones."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return plain.translate(str.maketrans(_QUOTES))


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def _beyond_ascii(text: Column, function) -> Column:
    """function(text), which lower-cases what is ASCII and no more: such texts don't go to Python."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(function(F.when(~plain, text)))


def fold(text: Column) -> Column:
    """fold_text() of each value; there is no built-in for Unicode decomposition."""
    return _beyond_ascii(text, _fold)


def compose(text: Column) -> Column:
    """Compatibility composition and case folding."""
    return _beyond_ascii(text, _compose)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quote_form(text: Column) -> Column:
    """What a quote and a page are compared in: composed, caseless, plain quotes and dashes, single blanks. Keeps accents."""
    plain = F.translate(compose(text), "’‘“”‐‑‒–—―", "''\"\"------")
    return squeeze(plain)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def numbers_in(text: Column) -> Column:
    """The numbers that a text states, as distinct strings of digits; one written with cents also without them."""
    runs = F.regexp_extract_all(text, F.lit(f"({fixed.NUMBER_PATTERN})"), 1)

    def readings(run: Column) -> Column:
        own = digits(run)
        cents = (F.length(run) > 3) & F.substring(run, -3, 1).isin(".", ",") & (F.length(own) > 2)
        return F.when(cents, F.array(own, F.substring(own, F.lit(1), F.length(own) - 2))).otherwise(F.array(own))

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, readings)), lambda x: x != ""))


def states_a_number(text: Column) -> Column:
    """Whether a text has a numeral in words, or begins a word with one that is written in compounds."""
    words, stems = "|".join(fixed.NUMERALS), "|".join(fixed.NUMERAL_STEMS)
    return text.rlike(rf"(?iuU)\b(?:{words})\b") | text.rlike(rf"(?iuU)\b(?:{stems})")


#: What ends a line, in a class of characters.
_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"


def first_line(text: Column) -> Column:
    """The first line that isn't blank, or an empty string. One pass: blank lines are left behind for good, and nothing behind the line is read."""
    blank = rf"[\s&&[^{_ENDS}]]*+"
    return F.coalesce(F.regexp_extract(text, rf"(?U)\A(?:{blank}[{_ENDS}])*+({blank}[^\s{_ENDS}][^{_ENDS}]*+)", 1), F.lit(""))


def title_text(line: str) -> str:
    """A first line folded, as far as a title goes."""
    return fold_text(line)[: fixed.TITLE_CHARS]


@lru_cache(1)
def _disqualifying() -> tuple[str, ...]:
    return tuple(fold_text(t) for t in fixed.DISQUALIFYING)


@F.pandas_udf(T.ArrayType(T.StringType()))
def other_kinds(lines: pd.Series) -> pd.Series:
    """The folded terms for other kinds of documents that the title of each first line contains, in their order. Terms match inside words too.
    A title is made once a text here; in a lambda over the terms Spark would make it, and look for the line, once a term."""
    return pd.Series([[t for t in _disqualifying() if t in title] for title in map(title_text, lines)], dtype=object)


#: Vocabularies by the name of what they tell.
VOCABULARY = {"strong": fixed.STRONG, "supporting": fixed.SUPPORTING, "invoice": fixed.INVOICE}


@lru_cache(1)
def _automaton():
    """One automaton over the folded terms of all vocabularies; a term says where it stands in which of them."""
    import ahocorasick

    places: dict[str, list[tuple[str, int]]] = {}
    for name, terms in VOCABULARY.items():
        for i, term in enumerate(terms):
            places.setdefault(fold_text(term), []).append((name, i))
    automaton = ahocorasick.Automaton()
    for term, where in places.items():
        automaton.add_word(term, (term, where))
    automaton.make_automaton()
    return automaton


def found_text(text: str) -> dict[str, list[str]]:
    """Of each vocabulary the folded terms that a text contains once folded, in the vocabulary's order."""
    met = {term: where for _, (term, where) in _automaton().iter(fold_text(text))}
    out: dict[str, list[tuple[int, str]]] = {name: [] for name in VOCABULARY}
    for term, where in met.items():
        for name, i in where:
            out[name].append((i, term))
    return {name: [term for _, term in sorted(hits)] for name, hits in out.items()}


@F.pandas_udf(T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in VOCABULARY]))
def found(texts: pd.Series) -> pd.DataFrame:
    """found_text() of each text, folded and read once; null has no terms."""
    return pd.DataFrame([found_text(t or "") for t in texts], columns=list(VOCABULARY))


def company_form(name: Column) -> Column:
    """A company name without case, punctuation, legal forms and single letters; what is left of it if that is all."""
    text = F.replace(F.lower(name), F.lit("ß"), F.lit("ss"))
    text = squeeze(F.regexp_replace(text, r"""[.,;:()"'&/\\-]""", " "))
    words = F.filter(F.split(text, " "), lambda w: ~w.isin(*fixed.LEGAL_FORMS) & (F.length(w) > 1))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(text)


def registration_form(value: Column) -> Column:
    """A registration number without blanks, dots, hyphens and case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(value, r"(?U)[\s.\-]", "")), F.lit(""))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ .,;]+|[ .,;]+$", "")


def jurisdiction(value: Column) -> Column:
    """The name under which a governing law is compared, from how it is stated."""
    text = _bare(squeeze(fold(value)))
    for lead in fixed.JURISDICTION_LEADS:  # one after the other, each at most once
        text = F.regexp_replace(text, f"^{lead}", "")
    text = _bare(F.replace(text, F.lit(" and "), F.lit(" & ")))
    known = F.create_map(*[F.lit(x) for pair in fixed.JURISDICTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text), text)


def phrasings(value: Column, name: Column) -> Column:
    """How the jurisdiction of a value, whose compared name is given, may be written; single words only if they name it.

    `name` must be a column of the table, not jurisdiction() itself: Python functions can't stand inside a lambda."""
    by_name: dict[str, list[str]] = {}
    for phrase, target in fixed.JURISDICTIONS.items():
        by_name.setdefault(target, []).append(phrase)
    known = F.create_map(*[x for k, v in by_name.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.array(F.trim(value), name, F.replace(name, F.lit(" & "), F.lit(" and ")))
    every = F.array_union(own, F.coalesce(F.try_element_at(known, name), F.array().cast("array<string>")))
    return F.filter(every, lambda p: (p != "") & (F.contains(p, F.lit(" ")) | (p == name)))


def shorten(text: Column, limit: int = fixed.CLAUSE_CHARS) -> Column:
    """Single blanks; a longer text cut at a blank, with a mark."""
    plain = squeeze(text)
    return F.when(F.length(plain) > limit, F.concat(F.regexp_replace(F.substring(plain, 1, limit), " [^ ]*$", ""), F.lit(" [...]"))).otherwise(plain)


def label(name: Column) -> Column:
    """What a field is called: a fixed label, else its name in words."""
    words = F.replace(name, F.lit("_"), F.lit(" "))
    known = F.create_map(*[F.lit(x) for pair in fixed.LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, F.lit(2), F.length(words)))))


def clauses(text: Column) -> Column:
    """The (number, sentence) pairs that a text states: array<struct<number, clause>>. Years (1900 to 2100, of
    four digits) and the numbers 1 to 12, without zeros before, are left out."""
    # Currencies and units beside which a number counts.
    currencies = "EUR|USD|GBP|CHF|BGN|RON|PLN"
    units = "days?|months?|years?|weeks?|дни|дена|месеца?|години|tage?n?|monate?n?|jahre?n?|d[íi]as?|mes(?:es)?|a[ñn]os?|jours?|mois|ans?|ann[ée]es?"
    amount = r"\d{1,3}(?:[.,  ]\d{3})+|\d{1,7}"
    pattern = F.lit(rf"(?iuU)((?:{currencies})\s*(?:{amount})|(?:{amount})\s*(?:{units})\b)")
    sentences = F.transform(F.regexp_extract_all(text, F.lit(r"([^.\n]{20,400}[.\n])"), 1), squeeze)

    def stated(sentence: Column) -> Column:
        found = F.transform(F.regexp_extract_all(sentence, pattern, 1), lambda m: F.struct(digits(m).alias("number"), sentence.alias("clause")))
        found = F.filter(found, lambda x: ~x["number"].rlike("^(?:[1-9]|1[0-2]|19[0-9]{2}|20[0-9]{2}|2100)$"))
        return F.transform(found, lambda x: F.struct(x["number"].cast("long").alias("number"), x["clause"].alias("clause")))

    return F.flatten(F.transform(sentences, stated))


def joined_blocks(blocks: Column) -> Column:
    """The texts of a message's text blocks (type, text), a line each; empty without any."""
    said = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.array_join(F.transform(said, lambda b: b["text"]), "\n")
