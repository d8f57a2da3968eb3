"""Indic letters: the spellings that the table of legal forms expects, every script, and the same in names and addresses."""

import unicodedata

from pyspark.sql import functions as F

from quillmark.functions import addresses, indic, tables, text

# Words of company names as they stand in registers, and what the table of legal forms calls them.
GOLDEN = {
    "प्राइवेट": "praivet", "एलएलपी": "elelpi", "প্রাইভেট": "praibhet", "பிரைவேட்": "piraivet", "லிமிடெட்": "limitet", "പ്രൈവറ്റ്": "praivrr", "ലിമിറ്റഡ്": "limirrd",
    "लिमिटेड": "limited", "પ્રાઇવેટ": "praivet", "ପ୍ରାଇଭେଟ": "praibhet", "ప్రైవేట్": "praivet", "ಪ್ರೈವೇಟ್": "praivet", "ਪ੍ਰਾਈਵੇਟ": "praivet", "ශ්‍රී": "sri", "කෝපි": "kopi", "१२३": "123",
}


def test_golden_words(spark):
    got = spark.createDataFrame(list(GOLDEN.items()), "x string, y string").select("y", text.ascii_lower(F.col("x")).alias("z")).collect()
    assert [r.z for r in got] == [r.y for r in got]
    assert {"praivet", "praibhet", "piraivet", "praivrr", "limitet", "limirrd", "elelpi"} <= {*tables.LEGAL_FORMS}


def test_legal_forms_are_found(spark):
    r = text.normalize(spark.createDataFrame([("भारत प्राइवेट लिमिटेड", "12, गली ३, Pune 411001")], "business_name string, business_address string")).first()
    assert (r.name_ascii, r.name_core, r.legal_form) == ("bhart praivet limited", "bhart", "ltd pvt")
    assert r.numbers == "12 3 411001" and r.address_norm == "12 gli 3 pune 411001"


def test_every_script_has_its_letters():
    for name, (a, b) in indic.SCRIPTS.items():
        letters = [chr(c) for c in range(a, b + 1) if unicodedata.name(chr(c), "").startswith(name.upper()) and " LETTER " in unicodedata.name(chr(c))]
        spoken = [c for c in letters if indic.latin(c)]
        assert len(letters) > 30 and len(spoken) >= len(letters) - 3, name
        assert all(v.isascii() and len(v) <= 2 for v in map(indic.latin, letters))
    assert indic.latin("्") == "" and indic.latin("॰") == ""


def test_columns_and_addresses_agree(spark):
    every = [(f"{c}x{c}",) for c in indic.table()]
    got = spark.createDataFrame(every, "x string").select("x", text.ascii_lower(F.col("x")).alias("y")).collect()
    assert all(r.y == addresses.lowered(r.x) for r in got)
    assert spark.range(1).select(text.ascii_lower(F.lit(None).cast("string")).alias("y")).first().y == ""
