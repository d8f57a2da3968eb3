"""Letters of Indic scripts to Latin ones, one by one, by rule from the letters' Unicode names: DEVANAGARI LETTER KHA is kh, its VOWEL SIGN AI is ai.

Scripts write a vowel that follows a consonant as a sign, the virama says that none does, and a consonant without either has an `a` of its own. Names of
businesses are mostly loan words in which that `a` is silent or was never there ("private" is written pa-virama-ra-aa-i-va-e-tta), so it is not
written: praivet. Consonants keep their first letters and aspiration; retroflex and dental ones, long and short vowels are alike.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: The scripts, with the first and the last code point of each block.
SCRIPTS = {
    "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "gurmukhi": (0x0A00, 0x0A7F), "gujarati": (0x0A80, 0x0AFF), "oriya": (0x0B00, 0x0B7F),
    "tamil": (0x0B80, 0x0BFF), "telugu": (0x0C00, 0x0C7F), "kannada": (0x0C80, 0x0CFF), "malayalam": (0x0D00, 0x0D7F), "sinhala": (0x0D80, 0x0DFF),
}
#: A text that holds any of them, or a joiner.
ANY = f"[{chr(0x0900)}-{chr(0x0DFF)}{chr(0x200C)}{chr(0x200D)}]"

#: Zero-width joiners: they choose a letter's shape.
JOINERS = "\u200c\u200d"

_SIGNS = {"ANUSVARA": "m", "ANUSVARAYA": "m", "CANDRABINDU": "m", "CHANDRABINDU": "m", "BINDI": "m", "TIPPI": "m", "VISARGA": "h", "VISARGAYA": "h", "OM": "om", "DANDA": ".", "POLLU": "n", "REPH": "r"}
#: Sinhala names its vowel signs by their shapes.
_SHAPES = {"AELA-PILLA": "AA", "AEDA-PILLA": "AE", "IS-PILLA": "I", "PAA-PILLA": "U", "GAETTA-PILLA": "R", "GAYANUKITTA": "L", "KOMBUVA": "E", "DEKA": "AI"}
_MUTE = ("VIRAMA", "NUKTA", "AVAGRAHA", "AL-LAKUNA", "ADDAK", "STOP", "LENGTH", "IRI", "URA")


def _sound(name: str) -> str:
    """The letters of one letter's own name: KHHA kh, TTA t, II i, VOCALIC R r; of Sinhala ones without the ending that makes a name of a sound."""
    name = name.removesuffix("YANNA") or "YA" if name.endswith("YANNA") else name
    if re.fullmatch(r"[AEIOU]+", name):
        return {"AI": "ai", "AU": "au", "AE": "ae"}.get(name, name[0].lower())
    if re.fullmatch(r"I[RL]U+", name):  # vocalic
        return name[1].lower()
    letters = re.sub(r"(.)\1+", r"\1", name.lower())  # doubled: retroflex, long
    return letters[:-1] if letters.endswith("a") and len(letters) > 1 else letters


def latin(letter: str) -> str:
    """What one code point becomes; '' for signs without a sound and for what no rule covers."""
    digit = unicodedata.decimal(letter, None)
    if digit is not None:
        return str(digit)
    parts = unicodedata.name(letter, "").split()[1:]
    if not parts or any(m in parts for m in _MUTE):
        return ""
    parts = parts[: parts.index("WITH")] if "WITH" in parts else parts
    if parts[-1] in _SIGNS:
        return _SIGNS[parts[-1]]
    if parts[0] not in ("LETTER", "VOWEL", "VOCALIC"):
        return ""
    if "NAASIKYAYA" in parts or "NAAKSIKYAYA" in parts:
        return "n"
    if "HAA" in parts:  # two signs around a consonant
        return "au" if parts[-1] == "GAYANUKITTA" else "o"
    out = _sound(_SHAPES.get(parts[-1], parts[-1]))
    return f"{out}h" if "MAHAAPRAANA" in parts and not out.endswith("h") else out


@cache
def table() -> dict[str, str]:
    """Every code point of the scripts with what it becomes."""
    return {chr(c): latin(chr(c)) for a, b in SCRIPTS.values() for c in range(a, b + 1)} | dict.fromkeys(JOINERS, "")


@cache
def steps() -> tuple[str, str, dict[str, str]]:
    """(from, to, after): a translation of single letters, those without a sound at the end of `from`; letters that become several go by way of a
    private character each, which `after` replaces."""
    entries = table()
    several = sorted({v for v in entries.values() if len(v) > 1})
    private = {v: chr(0xE000 + i) for i, v in enumerate(several)}
    some = {c: private.get(v, v) for c, v in entries.items() if v}
    silent = [c for c, v in entries.items() if not v]
    return "".join(some) + "".join(silent), "".join(some.values()), {p: v for v, p in private.items()}
