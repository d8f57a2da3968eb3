from pyspark.sql import functions as F

from quillmark.functions import ids, text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_names(spark):
    name = lambda v: one(spark, text.name_ascii, v)
    assert name("S.A.S. Dupont") == "sas dupont"
    assert name("Joe's & Sons") == "joes and sons"
    assert name("L'Étoile") == "etoile"
    assert name("Ets Pra Li") == "etablissements pvt ltd"
    assert name(None) == ""
    assert one(spark, text.name_core, "the company") == "company"
    assert one(spark, text.name_core, "bharat heavy electricals ltd") == "bharat heavy electricals"
    assert one(spark, text.legal_form, "acme private limited") == "ltd pvt"
    assert one(spark, text.acronym, "bharat heavy electricals") == "bhe"


def test_addresses(spark):
    assert one(spark, text.house_no, "flat 012a, road") == "12a"
    assert one(spark, text.house_no, "12 - 014 road") == "12-14"
    assert one(spark, text.postal, "12 main road 560001 560002") == "560002"
    assert one(spark, text.numbers, "b 12, a 007 and 12") == "12 7"
    assert one(spark, text.street_word, "1795 westchester drive high point nc") == "westchester"
    r = text.normalize(spark.createDataFrame([("The Company", "Near SBI ATM, 5 Ninth St, St Nazaire")], "business_name string, business_address string")).first()
    assert (r.landmark, r.address_norm, r.address_core) == ("near sbi atm", "near sbi atm 5 9th street saint nazaire", "5 9th street saint nazaire")


def test_ids(spark):
    assert one(spark, ids.key_of, "S2-166376419") == 20166376419
    assert spark.range(1).select(ids.id_of(F.lit(20166376419)).alias("y")).first().y == "S2-166376419"
