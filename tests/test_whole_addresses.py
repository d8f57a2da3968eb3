import pyarrow.parquet as pq

import __spark_entry__ as entry
from quillmark.plans import views

SF = "/root/testdata/sf0.001"


def test_addresses_are_whole(spark):
    got = {r.doc_id: r.business_address for r in views.records(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert got == {i: t.partition(".")[2] for i, t in zip(docs["doc_id"], docs["text"])}
    assert max(map(len, got.values())) > 200


def test_normalized_frame_reads_past_200_characters(spark, tmp_path):
    spark.createDataFrame([(1, "Name. 12 rue" + " word" * 100 + " 75008 Paris", "fr")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    row = entry.queries()["p19_normalize_frame"](spark, str(tmp_path)).first()
    assert row.postal == "75008" and row.address_norm.endswith("75008 paris")
