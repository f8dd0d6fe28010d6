"""Names, addresses and identifiers as Column expressions; Python only for Devanagari."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V

DEVANAGARI = "[ऀ-ॿ]"
_SYLLABLE = re.compile(f"(?P<c>[{''.join(V.CONSONANTS)}])(?P<dot>{V.DOT})?(?P<sign>[{''.join(V.VOWEL_SIGNS)}{V.VIRAMA}])?|(?P<other>[{''.join(V.VOWELS)}{''.join(V.NASALS)}{''.join(V.VOWEL_SIGNS)}{V.DOT}{V.VIRAMA}{V.DANDA}०-९])")
_ALONE = V.VOWELS | V.NASALS | dict.fromkeys([*V.VOWEL_SIGNS, V.DOT, V.VIRAMA], "") | {V.DANDA: "."} | {chr(0x966 + d): str(d) for d in range(10)}


def _latin(text: str) -> str:
    """A text's Devanagari syllables in Latin letters.

    A bare consonant carries an ``a``, unless it ends its word; after a conjunct it keeps it even
    there.  Two fixed habits: a danda counts as part of a word, and a dotted consonant never as a conjunct's.
    """

    def sound(m: re.Match) -> str:
        if m["other"]:
            return _ALONE[m["other"]]
        base = V.DOTTED.get(m["c"], V.CONSONANTS[m["c"]]) if m["dot"] else V.CONSONANTS[m["c"]]
        if m["sign"]:
            return base + V.VOWEL_SIGNS.get(m["sign"], "")
        after = text[m.end() : m.end() + 1]
        ends_word = after not in V.NASALS and not "ऀ" <= after <= "ॿ"
        conjunct = not m["dot"] and m.start() >= 2 and text[m.start() - 1] == V.VIRAMA
        return base if ends_word and not conjunct else base + "a"

    return _SYLLABLE.sub(sound, text)


def _latin_series(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _latin(t))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_devanagari(c: Column | str) -> Column:
    return F.coalesce(_column(c).rlike(DEVANAGARI), F.lit(False))


def transliterate(c: Column | str) -> Column:
    """Texts without Devanagari pass through (in the JVM; Python sees nulls for them)."""
    c = _column(c)
    return F.when(has_devanagari(c), F.pandas_udf(_latin_series, "string")(F.when(has_devanagari(c), c))).otherwise(c)


def latin_display(c: Column) -> Column:
    """:func:`display_name` of a text that is in Latin letters already."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), V.HONORIFICS, " ")
    out = F.regexp_replace(out, V.RELATIONS, " ")
    out = F.regexp_replace(out, V.INITIALS, "$1 ")
    out = F.regexp_replace(out, r"[^A-Za-z\s]", " ")
    return F.initcap(F.trim(F.regexp_replace(out, r"\s{2,}", " ")))


def display_name(c: Column | str) -> Column:
    """Without honorifics, relation words and punctuation; in Latin letters and title case."""
    return latin_display(transliterate(c))


def phonetic_of_display(display: Column) -> Column:
    out = F.lower(display)
    for old, new in V.PHONETIC:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"(.)\1+", "$1")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"(\S\S)y(?!\S)", "$1i")


def phonetic(c: Column | str) -> Column:
    return phonetic_of_display(display_name(c))


def surname(phonetic_name: Column | str) -> Column:
    """The last token of a phonetic name, or the empty string."""
    return F.regexp_extract(_column(phonetic_name), r"(\S+)$", 1)


def surname_weight(surname_column: Column, frequency: Column | None = None) -> Column:
    """Less for common surnames; ``frequency`` is the surname's share of the corpus."""
    common = F.array(*[phonetic_of_display(F.lit(s)) for s in V.COMMON_SURNAMES])
    weight = F.when(F.array_contains(common, surname_column), 0.55).otherwise(1.0)
    if frequency is None:
        return weight
    share = F.coalesce(frequency, F.lit(0.0))
    return F.least(weight, F.when(share > 0.10, 0.50).when(share > 0.05, 0.70).otherwise(1.0))


def surname_corpus(records: DataFrame, name: str = "name") -> DataFrame:
    """surname, n and its share of all non-blank names."""
    named = records.filter(F.trim(F.col(name)) != "").select(surname(phonetic(name)).alias("surname"))
    counted = named.groupBy("surname").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("surname", "n", (F.col("n") / F.col("total")).alias("share"))


def known_localities(phonetic_address: Column) -> Column:
    """Known localities whose phonetic key occurs in the address, in the list's order."""
    keys = F.array(*[F.struct(phonetic_of_display(F.lit(x)).alias("key"), F.lit(x).alias("name")) for x in V.LOCALITIES])
    return F.transform(F.filter(keys, lambda k: F.contains(phonetic_address, k["key"])), lambda k: k["name"])


def localities(phonetic_address: Column) -> Column:
    """Known localities, or else the distinctive words of the address."""
    found = known_localities(phonetic_address)
    words = F.filter(F.split(phonetic_address, " "), lambda w: (F.length(w) > 3) & ~w.isin(V.ADDRESS_STOP))
    return F.when(F.size(found) > 0, found).otherwise(F.array_distinct(words))


def phone_digits(c: Column | str) -> Column:
    """Digits only, the last ten of ten or more."""
    digits = F.regexp_replace(_column(c), r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits)


def plate(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(_column(c), r"[\s-]", ""))


def mask(c: Column | str) -> Column:
    """Two leading and three trailing characters; short values vanish altogether."""
    c = _column(c)
    return F.when(F.length(c) > 5, F.concat(F.left(c, F.lit(2)), F.repeat(F.lit("•"), F.length(c) - 5), F.right(c, F.lit(3)))).otherwise("•••")


def opaque(c: Column | str) -> Column:
    return F.concat(F.lit("V-"), F.substring(F.sha2(_column(c).cast("binary"), 256), 1, 10))


def strip_noise(c: Column | str) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(_column(c), V.NOISE, " "), r"\s{2,}", " ")
    return F.regexp_replace(squeezed, r"^[ ,.\-]+|[ ,.\-]+$", "")


def identifiers(c: Column | str) -> Column:
    """Struct of the distinct phones, IMEIs, vehicles and accounts that a text mentions, in order.

    Nine to eighteen digits are an account unless they are a phone or as long as an IMEI.
    """
    c = F.coalesce(_column(c), F.lit(""))
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(1)))
    phones, imeis = every(V.PHONE), every(V.IMEI)
    vehicles = F.array_distinct(F.transform(every(V.VEHICLE), lambda v: F.upper(F.regexp_replace(v, r"[-\s]", ""))))
    accounts = F.filter(every(V.ACCOUNT), lambda a: ~F.array_contains(phones, a) & (F.length(a) != 15))
    return F.struct(phones.alias("phones"), imeis.alias("imeis"), vehicles.alias("vehicles"), accounts.alias("accounts"))
