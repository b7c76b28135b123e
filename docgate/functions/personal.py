"""Checksums of personal identifiers, and masking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgate import fixed

# -- on columns ---------------------------------------------------------------


def compact(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def _digit(value: Column, i: int) -> Column:
    return F.substring(value, i, 1).cast("int")


def _remainder(number: Column, modulus: int) -> Column:
    """A long string of digits modulo a number, digit by digit."""
    return F.aggregate(F.split(number, ""), F.lit(0), lambda r, d: F.when(d == "", r).otherwise((r * 10 + d.cast("int")) % modulus))


def iban(value: Column) -> Column:
    """Country, the length that it uses, and remainder 1 modulo 97 with the first four characters last, letters as 10 to 35."""
    plain = compact(value)
    lengths = F.create_map(*[F.lit(x) for pair in fixed.IBAN_LENGTHS.items() for x in pair])
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    numbers = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c),
    )
    shape = plain.rlike("^[A-Z]{2}[0-9]{2}") & (F.coalesce(F.try_element_at(lengths, F.substring(plain, 1, 2)), F.lit(0)) == F.length(plain))
    return shape & (_remainder(F.array_join(numbers, ""), 97) == 1)


def egn(value: Column) -> Column:
    """Ten digits with a weighted check digit and a date, whose months also stand for the century."""
    month = F.substring(value, 3, 2).cast("int")
    month = F.when(month > 40, month - 40).when(month > 20, month - 20).otherwise(month)
    total = sum((_digit(value, i + 1) * w for i, w in enumerate(fixed.EGN_WEIGHTS)), F.lit(0))
    ok = month.between(1, 12) & F.substring(value, 5, 2).cast("int").between(1, 31) & (_digit(value, 10) == total % 11 % 10)
    return F.when(value.rlike("^[0-9]{10}$"), ok).otherwise(False)


def nir(value: Column) -> Column:
    """Thirteen digits and the key 97 less their remainder modulo 97."""
    number, key = F.substring(value, 1, 13).cast("long"), F.substring(value, 14, 2).cast("long")
    return F.when(value.rlike("^[0-9]{15}$"), key == 97 - number % 97).otherwise(False)


def _control_letter(number: Column) -> Column:
    return F.substring(F.lit(fixed.DNI_LETTERS), number % 23 + 1, F.lit(1))


def dni(value: Column) -> Column:
    plain = F.regexp_replace(F.upper(value), "[ -]", "")
    return F.when(plain.rlike("^[0-9]{8}[A-Z]$"), F.substring(plain, 9, 1) == _control_letter(F.substring(plain, 1, 8).cast("int"))).otherwise(False)


def nie(value: Column) -> Column:
    plain = F.regexp_replace(F.upper(value), "[ -]", "")
    return F.when(plain.rlike("^[XYZ][0-9]{7}[A-Z]$"), dni(F.concat(F.translate(F.substring(plain, 1, 1), "XYZ", "012"), F.substring(plain, 2, 8)))).otherwise(False)


def card(value: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    return F.when(value.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", value)).otherwise(False)


def labelled_cards(text: Column) -> Column:
    """Card numbers beside a label."""
    return F.regexp_extract_all(text, F.lit(f"(?iuU)(?:{fixed.CARD_LABELS}){fixed.LABEL_THEN}({fixed.CARD_SHAPE})"), 1)


# -- on values, inside the masking function ----------------------------------------


def _valid_iban(value: str) -> bool:
    plain = "".join(c for c in value.upper() if c.isalnum())
    if fixed.IBAN_LENGTHS.get(plain[:2]) != len(plain) or not plain[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _valid_dni(plain: str) -> bool:
    return len(plain) == 9 and plain[:8].isdigit() and plain[8] == fixed.DNI_LETTERS[int(plain[:8]) % 23]


def _valid_egn(plain: str) -> bool:
    if len(plain) != 10:
        return False
    month = int(plain[2:4])
    month -= 40 if month > 40 else 20 if month > 20 else 0
    total = sum(int(d) * w for d, w in zip(plain, fixed.EGN_WEIGHTS, strict=False))
    return 1 <= month <= 12 and 1 <= int(plain[4:6]) <= 31 and int(plain[9]) == total % 11 % 10


def _valid_id(value: str) -> bool:
    plain = re.sub("[ .-]", "", value).upper()
    if plain[:1] in ("X", "Y", "Z"):
        return _valid_dni(str("XYZ".index(plain[0])) + plain[1:])
    if plain[-1:].isalpha():
        return _valid_dni(plain)
    if len(plain) == 15 and plain.isdigit() and int(plain[13:]) == 97 - int(plain[:13]) % 97:
        return True
    return plain.isdigit() and _valid_egn(plain)


def _valid_card(value: str) -> bool:
    numbers = [int(c) for c in value if c.isdigit()]
    doubled = sum(d - 9 if d > 9 else d for d in (2 * d for d in numbers[-2::-2]))
    return 13 <= len(numbers) <= 19 and (sum(numbers[-1::-2]) + doubled) % 10 == 0


def _valid_phone(value: str) -> bool:
    return 7 <= sum(c.isdigit() for c in value) <= 15


def _beside(labels: str, shape: str) -> re.Pattern[str]:
    return re.compile(f"(?i:(?:{labels}){fixed.LABEL_THEN}({shape}))")


#: Category, pattern, group that is masked, and what it must satisfy. Later ones see the masks of earlier ones.
_MASKED = (
    ("email", re.compile(fixed.EMAIL_PATTERN), 0, lambda _: True),
    ("iban", re.compile(fixed.IBAN_PATTERN), 0, _valid_iban),
    ("national_id", _beside(fixed.ID_LABELS, fixed.ID_SHAPES), 1, _valid_id),
    ("card", _beside(fixed.CARD_LABELS, fixed.CARD_SHAPE), 1, _valid_card),
    ("phone", _beside(fixed.PHONE_LABELS, fixed.PHONE_SHAPE), 1, _valid_phone),
)
#: Blanks that aren't plain, and characters without width.
BLANKS, EMPTY = "\xa0\u202f\u2007", "\xad\u200b"
_PLAIN = str.maketrans({**dict.fromkeys(BLANKS, " "), **dict.fromkeys(EMPTY)})


def mask_text(text: str) -> tuple[str, dict[str, int]]:
    """A text with its personal data masked, and how often each category was."""
    counts: dict[str, int] = {}
    text = text.translate(_PLAIN)
    for category, pattern, group, valid in _MASKED:

        def put(m: re.Match[str], category=category, group=group, valid=valid) -> str:
            if not valid(m[group]):
                return m[0]
            counts[category] = counts.get(category, 0) + 1
            return m[0].replace(m[group], fixed.MASKS[category])

        text = pattern.sub(put, text)
    return text, counts


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))]))
def _mask(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else mask_text(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "counts"])


def plain(text: Column) -> Column:
    """A text with plain blanks and without characters of no width, as masking leaves it."""
    return F.translate(text, BLANKS + EMPTY, " " * len(BLANKS))


def suspect(text: Column) -> Column:
    """Whether a text holds a digit or an @, without which there is nothing to mask."""
    return F.coalesce(text.rlike(r"(?U)[\d@]"), F.lit(False))


def mask(text: Column | str) -> Column:
    """mask_text() of each text, as text and counts. A null text has null counts: nothing was looked for. Texts that aren't suspect stay in
    the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    done = _mask(F.when(suspect(text), text))
    none = F.when(text.isNotNull(), F.create_map().cast("map<string,int>"))
    return F.struct(F.coalesce(done["text"], plain(text)).alias("text"), F.coalesce(done["counts"], none).alias("counts"))


@F.pandas_udf(T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))]))
def mask_all(texts: pd.Series) -> pd.DataFrame:
    """mask_text() of each text of an array, and the counts of all together; null for a null array."""
    rows = []
    for pages in texts:
        if pages is None:
            rows.append((None, None))
            continue
        total: dict[str, int] = {}
        done = [(None, {}) if t is None else mask_text(t) for t in pages]
        for _, counts in done:
            for k, n in counts.items():
                total[k] = total.get(k, 0) + n
        rows.append(([t for t, _ in done], total))
    return pd.DataFrame(rows, columns=["texts", "counts"])
