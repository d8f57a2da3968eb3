"""Normalization of names and addresses as column expressions. Null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import indic
from quillmark.functions import tables as T
from quillmark.functions.addresses import address_views


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def _in(t: Column, names: list[str]) -> Column:
    return t.isin(names)


def indic_latin(c: Column) -> Column:
    """Letters of the scripts of indic.SCRIPTS as Latin ones; others as they are."""
    letters, to, several = indic.steps()
    out = F.translate(c, letters, to)
    for one, more in several.items():
        out = F.replace(out, F.lit(one), F.lit(more))
    return F.when(c.rlike(indic.ANY), out).otherwise(c)


def ascii_lower(c: Column) -> Column:
    """Latin letters without accents and letters of Indic scripts as Latin ones, lower-cased."""
    out = indic_latin(F.coalesce(c, F.lit("")))
    for a, b in T.DIGRAPHS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(F.translate(out, *T.ACCENTS))


def squeeze(c: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def _unquoted(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, T.ELISION, ""), "'`", "")


def name_ascii(raw: Column) -> Column:
    s = F.regexp_replace(ascii_lower(raw), T.MESSRS, " ")
    s = F.regexp_replace(_unquoted(F.replace(s, F.lit("&"), F.lit(" and "))), T.DOTTED, "")
    s = squeeze(s)
    for phrase, to in T.NAME_PHRASES.items():
        s = F.regexp_replace(s, rf"\b{phrase}\b", to)
    names = _map(T.NAME_TOKENS)
    return F.array_join(F.transform(F.split(s, " "), lambda t: F.coalesce(F.try_element_at(names, t), t)), " ")


def tokens(c: Column) -> Column:
    """Words between blanks; none for an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def name_core(name: Column) -> Column:
    """A normalized name's words without legal forms and stop words; if none is left, with legal forms; else all."""
    words, forms = tokens(name), list(T.LEGAL_FORMS)
    core = F.filter(words, lambda t: ~_in(t, forms) & ~_in(t, T.NAME_STOPWORDS))
    some = F.filter(words, lambda t: ~_in(t, T.NAME_STOPWORDS))
    return F.array_join(F.when(F.size(core) > 0, core).when(F.size(some) > 0, some).otherwise(words), " ")


def legal_form(name: Column) -> Column:
    forms = _map(T.LEGAL_FORMS)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(tokens(name), lambda t: F.try_element_at(forms, t)), lambda t: t.isNotNull()))), " ")


_HOUSE = T.HOUSE_NUMBER


def _whole(c: Column) -> Column:
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def house_no(low: Column) -> Column:
    """The first house number of a lower-cased address: 12, 12a or 12-14, without leading zeros."""
    second = F.regexp_extract(low, _HOUSE, 3)
    return F.concat(_whole(F.regexp_extract(low, _HOUSE, 1)), F.regexp_extract(low, _HOUSE, 2), F.when(second != "", F.concat(F.lit("-"), _whole(second))).otherwise(""))


def postal(low: Column) -> Column:
    """The last run of 5 or 6 digits that doesn't start in the house number."""
    start = F.regexp_instr(low, F.lit(_HOUSE))
    span = F.regexp_extract(low, _HOUSE, 0)
    blank = F.when(start > 0, F.concat(F.substring(low, F.lit(1), start - 1), F.lit("x"), F.repeat(F.lit("#"), F.length(span) - 1), F.substring(low, start + F.length(span), F.length(low)))).otherwise(low)
    hidden = F.regexp_extract_all(blank, F.lit(r"(?<![0-9])(\d{5,6})(?![0-9])"), F.lit(1))
    return F.coalesce(F.try_element_at(hidden, F.lit(-1)), F.lit(""))


def numbers(low: Column) -> Column:
    """Distinct digit runs without leading zeros, in string order."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1)), _whole))), " ")


def normalize(df: DataFrame, name: str = "business_name", address: str = "business_address") -> DataFrame:
    """df with the nine views name_ascii, name_core, legal_form, address_norm, address_core, landmark, house_no, postal and
    numbers; empty strings where there is nothing."""
    out = df.withColumn("name_ascii", name_ascii(F.col(name)))
    out = out.withColumns({"name_core": name_core(F.col("name_ascii")), "legal_form": legal_form(F.col("name_ascii")), "_views": address_views(F.col(address))})
    return out.select(*(c for c in out.columns if c != "_views"), "_views.*")


def acronym(core: Column) -> Column:
    """Initials of two words or more; else empty."""
    words = tokens(core)
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def street_word(address_core: Column) -> Column:
    """The first word of three letters or more after the first number."""
    return F.regexp_extract(address_core, r"^\D*\d\S*(?:\s+\S{1,2}|\s+\S*\d\S*)*\s+([a-z]{3,})", 1)


def model_text(kind: str) -> Column:
    """What a model reads of a record: the embedder, the reranker, or the reranker of raw texts."""
    name, address = ("business_name", "business_address") if kind == "raw" else ("name_ascii", "address_norm")
    line = F.concat(F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))
    return F.concat(F.lit("query: "), line) if kind == "embedder" else line


def has_indic(c: Column) -> Column:
    return c.rlike("[ऀ-෿]")


def blocker_text(kind: str) -> Column:
    """b1: the ASCII name; b2 and b2w: the cores of name and address."""
    return F.col("name_ascii") if kind == "b1" else F.trim(F.concat_ws(" ", "name_core", "address_core"))
