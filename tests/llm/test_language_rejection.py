import base64
import zlib

import numpy as np

from quillmark.llm import language

FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."


def test_gibberish_and_unlearned_languages_are_rejected_and_clean_texts_stay(spark):
    rng = np.random.default_rng(0)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    model = language.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))

    def rejected(texts):
        return [r.lang_rejected for r in language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]

    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = [" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(n)) for n in (10, 20, 50, 200, 1000)]
    assert all(rejected([*junk, base64.b64encode(rng.bytes(3000)).decode(), FINNISH, FINNISH * 5, POLISH, POLISH * 5]))
    assert np.mean(rejected([r.text for r in held])) <= 0.01
    for n in (3, 8, 20):
        assert np.mean(rejected([" ".join(r.text.split()[:n]) for r in held])) <= 0.02
