"""A stress set: records rewritten in a French manner, to see how stages fare with a country they haven't seen. Every choice is drawn from a hash of the
record's key, so a record comes out the same however rows are dealt; the two sides of a pair are rewritten independently. What a lambda reads of a whole text
is bound before it (functions/bind.py): else it would be worked out again for each word, and the work would grow with the square of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import tables as T
from quillmark.functions.bind import bound
from quillmark.functions.ids import draw
from quillmark.functions.text import ascii_lower

# The rewritten forms are defined by these entries and patterns.
FRENCH_LEGAL = ["SARL", "SAS", "SA"]
FRENCH_STREET = {
    "street": "rue", "st": "rue", "lane": "rue", "ln": "rue", "way": "rue", "court": "rue", "ct": "rue", "place": "rue", "pl": "rue", "trail": "rue", "trl": "rue",
    "avenue": "avenue", "ave": "avenue", "av": "avenue", "drive": "avenue", "dr": "avenue", "circle": "avenue", "cir": "avenue",
    "boulevard": "boulevard", "blvd": "boulevard", "bd": "boulevard", "road": "boulevard", "rd": "boulevard", "highway": "boulevard", "hwy": "boulevard", "parkway": "boulevard", "pkwy": "boulevard",
}
SHORT_STREET = {"avenue": "av.", "boulevard": "bd", "rue": "r."}
PARTICLES = ["de", "la", "du"]
ELISIONS = ["l'", "d'"]
ACCENTS = {"e": ["é", "è"], "a": ["à"], "c": ["ç"]}
NUMBERED_STREET = r"^([0-9]+[A-Za-z]?)\s+(.+?)\s+([A-Za-z]+)\.?$"
PIN = r"(?<![0-9])[0-9]{6}(?![0-9])"
WORD = "[A-Za-z]{3,}"
COUNTRY = "SYNTH_FR"


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


class Draws:
    """Uniform numbers of a record, each under a name of its own."""

    def __init__(self, key: Column, seed: int):
        self.key, self.seed = key.cast("string"), seed

    def __call__(self, name: str, at: Column | None = None) -> Column:
        return draw(F.concat_ws(":", self.key, F.lit(name), *([at.cast("string")] if at is not None else [])), self.seed)

    def below(self, name: str, n: Column | int, at: Column | None = None) -> Column:
        return F.floor(self(name, at) * n).cast("int")

    def one(self, name: str, of: list[str], at: Column | None = None) -> Column:
        return F.get(F.array(*map(F.lit, of)), self.below(name, len(of), at))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def with_particle(words: Column, d: Draws, name: str) -> Column:
    """Half of the time, a particle between two words; else an elision before a word that begins with a vowel or h; else a particle in front."""

    def put(words: Column) -> Column:
        n = F.size(words)
        inside = F.array_insert(words, 2 + d.below(f"{name} place", n - 1), d.one(f"{name} particle", PARTICLES))
        vowels = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("(?i)^[aeiouh]"), i)), lambda i: i.isNotNull())
        elided = lambda at: F.transform(words, lambda w, i: F.when(i == at, F.concat(d.one(f"{name} elision", ELISIONS), w)).otherwise(w))
        front = F.concat(F.array(d.one(f"{name} front", PARTICLES)), words)
        beside = lambda v: F.when(F.size(v) > 0, bound(F.get(v, d.below(f"{name} vowel", F.size(v))), elided)).otherwise(front)
        return F.when((n >= 2) & (d(f"{name} inside") < 0.5), inside).otherwise(bound(vowels, beside))

    return bound(words, put)


def french_name(name: Column, d: Draws) -> Column:
    """Legal forms become SARL, SAS or SA (equal forms the same one), or go in 30 % of names; a particle in 30 %."""
    forms = _table(T.LEGAL_FORMS)
    plain = lambda w: F.regexp_replace(ascii_lower(w), "[^a-z]", "")

    def legal(words: Column, form: Column, found: Column) -> Column:
        kept = F.filter(words, lambda w, i: F.get(form, i).isNull())
        new = F.get(F.array(*map(F.lit, FRENCH_LEGAL)), (F.crc32(F.array_join(found, " ").cast("binary")) % len(FRENCH_LEGAL)).cast("int"))
        named = lambda k: F.when(F.size(k) == 0, words).when((F.size(found) > 0) & (d("name drop") >= 0.3), F.array_append(k, new)).otherwise(k)
        return bound(kept, named)

    def put(words: Column) -> Column:
        found = lambda form: F.array_sort(F.array_distinct(F.filter(form, lambda f: f.isNotNull())))
        each = F.transform(words, lambda w: F.try_element_at(forms, plain(w)))
        return bound(each, lambda form: bound(found(form), lambda f: legal(words, form, f)))

    some = lambda words: F.array_join(F.when((F.size(words) > 0) & (d("name particle") < 0.3), with_particle(words, d, "name")).otherwise(words), " ")
    return bound(bound(_words(name), put), some)


def pin_code(pin: Column) -> Column:
    """A five-digit code for a six-digit one, the same on both sides of a pair."""
    return (pin.cast("long") % 90_000 + 10_000).cast("string")


def _rebuilt(c: Column, pattern: str, change) -> Column:
    """c with each match of the pattern changed by change(match, number from 0)."""
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), change)
    return bound(found, lambda new: F.array_join(F.transform(F.split(c, pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.lit("")))), ""))


def french_address(address: Column, d: Draws) -> Column:
    """Street types become rue, avenue or boulevard, shortened in half of the records, numbers before or behind; six-digit codes get five digits or go in
    20 % of records; a particle in 30 %."""
    streets, short = _table(FRENCH_STREET), _table(SHORT_STREET)
    brief, first, gone = d("brief") < 0.5, d("number first") < 0.5, d("no code") < 0.2
    french = lambda w: F.try_element_at(streets, F.lower(F.rtrim(w, F.lit("."))))
    said = lambda f: F.when(brief, F.try_element_at(short, f)).otherwise(f)

    def part(p: Column) -> Column:
        group = lambda k: F.regexp_extract(p, NUMBERED_STREET, k)
        numbered = lambda f: F.when(first, F.concat_ws(" ", group(1), said(f), group(2))).otherwise(F.concat_ws(" ", said(f), group(2), group(1)))
        word = lambda w, i: bound(french(w), lambda f: F.when((i > 0) & f.isNotNull(), said(f)).otherwise(w))
        inner = F.array_join(F.transform(_words(p), word), " ")
        return bound(french(group(3)), lambda f: F.when(f.isNotNull(), numbered(f)).otherwise(inner))

    def put(parts: Column) -> Column:
        more = lambda at: F.transform(parts, lambda p, i: F.when(i == at, F.array_join(with_particle(_words(p), d, "address"), " ")).otherwise(p))
        return F.when(d("address particle") < 0.3, bound(d.below("address part", F.size(parts)), more)).otherwise(parts)

    coded = _rebuilt(address, PIN, lambda m, i: F.when(gone, F.lit("")).otherwise(pin_code(m)))
    parts = F.filter(F.transform(F.split(coded, ","), lambda p: bound(F.trim(p), part)), lambda p: p != "")
    return F.array_join(bound(parts, put), ", ")


def accented(text: Column, d: Draws, name: str) -> Column:
    """An accent on about 30 % of the words of three letters or more that have a letter for it."""

    def marked(c: Column, k: Column) -> Column:
        out = c
        for letter, forms in ACCENTS.items():
            one = d.one(f"{name} {letter}", forms, k)
            out = F.when(c == letter, one).when(c == letter.upper(), F.upper(one)).otherwise(out)
        return out

    def word(w: Column, k: Column) -> Column:
        spots = lambda letters: F.filter(F.transform(letters, lambda c, i: F.when(F.lower(c).isin(list(ACCENTS)), i)), lambda i: i.isNotNull())
        changed = lambda letters, at: F.array_join(F.transform(letters, lambda c, i: F.when(i == at, marked(c, k)).otherwise(c)), "")
        one = lambda letters, s: F.when(F.size(s) > 0, bound(F.get(s, d.below(f"{name} spot", F.size(s), k)), lambda at: changed(letters, at))).otherwise(w)
        return F.when(d(f"{name} word", k) < 0.3, bound(F.split(w, ""), lambda letters: bound(spots(letters), lambda s: one(letters, s)))).otherwise(w)

    return _rebuilt(text, WORD, word)


def french_records(records: DataFrame, seed: int = 42) -> DataFrame:
    """(entity_id, syn_id, side, business_name, business_address, country, orig_name, orig_address) of records (entity_id, side, business_name,
    business_address), side 'S1' or 'T': rewritten each by itself, accents on the S1 side only. Null counts as empty; repeated rows come out alike."""
    d = Draws(F.col("entity_id"), seed)
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    own = records.select("entity_id", "side", name.alias("orig_name"), address.alias("orig_address"))
    own = own.withColumns({"_n": french_name(F.col("orig_name"), d), "_a": french_address(F.col("orig_address"), d)})
    if_s1 = lambda c, what: F.when(F.col("side") == "S1", accented(F.col(c), d, what)).otherwise(F.col(c))
    return own.select("entity_id", F.concat(F.lit("SYN-"), "entity_id").alias("syn_id"), "side", if_s1("_n", "name accent").alias("business_name"), if_s1("_a", "address accent").alias("business_address"), F.lit(COUNTRY).alias("country"), "orig_name", "orig_address")
