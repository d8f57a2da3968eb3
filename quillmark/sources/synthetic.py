"""Made-up businesses and noisy copies of them, for tests: every value is fixed by a number and a seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.ids import draw

FIRST = ["north", "blue", "royal", "green", "silver", "grand", "union", "lotus", "river", "summit"]
SECOND = ["star", "valley", "bridge", "garden", "harbor", "temple", "market", "field", "stone", "crown"]
TRADE = ["traders", "foods", "textiles", "motors", "systems", "pharma", "bakery", "logistics"]
LEGAL = {"US": ["Inc", "LLC", "Corp"], "India": ["Pvt Ltd", "Limited", "LLP"], "France": ["SARL", "SAS", "SA"]}
OTHER_LEGAL = {"Inc": "Incorporated", "LLC": "L.L.C.", "Corp": "Corporation", "Pvt Ltd": "Private Limited", "Limited": "Ltd", "LLP": "LLP", "SARL": "S.A.R.L.", "SAS": "S.A.S.", "SA": "S.A."}
STREET = {"US": ["St", "Ave", "Rd"], "India": ["Road", "Nagar", "Marg"], "France": ["rue", "avenue", "boulevard"]}
OTHER_STREET = {"St": "Street", "Ave": "Avenue", "Rd": "Road", "Road": "Rd", "rue": "r", "avenue": "av", "boulevard": "bd"}


def _pick(names: list[str], n: Column, salt: int) -> Column:
    return F.array(*map(F.lit, names))[F.floor(draw(n, salt) * len(names)).cast("int")]


def _by_country(table: dict[str, list[str]], n: Column, salt: int) -> Column:
    out = F.lit("")
    for country, names in table.items():
        out = F.when(F.col("country") == country, _pick(names, n, salt)).otherwise(out)
    return out


def _changed(column: str, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column)), F.col(column))


def businesses(ids: DataFrame, countries: list[str], seed: int = 1) -> DataFrame:
    """A business for each id: id, country, name, legal, house, street, kind, town, postal."""
    b = F.col("id")
    out = ids.select("id").withColumn("country", _pick(countries, b, seed))
    name = F.concat_ws(" ", F.initcap(_pick(FIRST, b, seed + 1)), F.initcap(_pick(SECOND, b, seed + 2)), F.initcap(_pick(TRADE, b, seed + 3)))
    return out.withColumns({
        "name": name, "legal": _by_country(LEGAL, b, seed + 4), "house": (1 + F.floor(draw(b, seed + 5) * 999)).cast("string"), "street": F.initcap(_pick(SECOND, b, seed + 6)),
        "kind": _by_country(STREET, b, seed + 7), "town": F.concat(F.initcap(_pick(FIRST, b, seed + 8)), F.lit("ville")), "postal": (10_000 + F.floor(draw(b, seed + 9) * 90_000)).cast("int").cast("string"),
    })


def noisy(copies: DataFrame, seed: int = 50, typo: float = 0.25, swap: float = 0.1, legal: float = 0.3, street: float = 0.3, postal: float = 0.2, landmark: float = 0.1, empty: float = 0.05) -> DataFrame:
    """(id, copy, business_name, business_address, country) of businesses with a `copy` number; the rates are those of each kind of noise:
    a letter left out, two words swapped, the legal form or street type written otherwise, no postal code, a landmark, no address."""
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("copy").cast("string"))
    on = lambda k, rate: draw(key, seed + k) < rate
    at = (2 + F.floor(draw(key, seed + 10) * (F.length("name") - 2))).cast("int")
    words = F.split("name", " ")
    x = copies.withColumn("name", F.when(on(1, swap), F.concat_ws(" ", words[1], words[0], words[2])).otherwise(F.col("name")))
    x = x.withColumn("name", F.when(on(0, typo), F.concat(F.substring(F.col("name"), F.lit(1), at - 1), F.substring(F.col("name"), at + 1, F.length("name")))).otherwise(F.col("name")))
    full = F.concat_ws(" ", "name", F.when(on(2, legal), _changed("legal", OTHER_LEGAL)).otherwise(F.col("legal")))
    kind = F.when(on(3, street), _changed("kind", OTHER_STREET)).otherwise(F.col("kind"))
    near = F.when(on(5, landmark), F.concat(F.lit("Near "), F.col("town"), F.lit(" Station, "))).otherwise(F.lit(""))
    road = F.when(F.col("country") == "France", F.concat_ws(" ", "house", kind, "street")).otherwise(F.concat_ws(" ", "house", "street", kind))
    address = F.concat(near, road, F.lit(", "), F.col("town"), F.when(on(4, postal), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("postal"))))
    return x.select("id", "copy", full.alias("business_name"), F.when(on(6, empty), F.lit("")).otherwise(address).alias("business_address"), "country")


def sources(ids: DataFrame, countries: list[str], singletons: float = 0.06, most: int = 6, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s1, targets, truth), from whole numbers as ids: records with an entity_id, targets of S2 and S3, and (source1_entity_id, matched_entity_ids). A share of S1 has no match, the others 1 to `most`."""
    own = businesses(ids, countries, seed)
    count = F.when(draw(F.col("id"), seed + 20) < singletons, 0).otherwise(1 + F.floor(draw(F.col("id"), seed + 21) * most)).cast("int")
    first = F.col("copy") == 0
    copies = noisy(own.withColumn("copy", F.explode(F.sequence(F.lit(0), count))), seed + 50)
    side = F.when(first, 1).when(draw(F.concat_ws("-", "id", "copy"), seed + 22) < 0.5, 2).otherwise(3)
    out = copies.withColumn("entity_id", F.concat(F.lit("S"), side.cast("string"), F.lit("-"), F.when(first, F.col("id")).otherwise(F.col("id") * (most + 1) + F.col("copy")).cast("string")))
    record = ["entity_id", "business_name", "business_address", "country"]
    lists = out.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.when(~first, F.col("entity_id")))), ",").alias("matched_entity_ids"))
    truth = lists.select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("source1_entity_id"), "matched_entity_ids")
    return out.where(first).select(record), out.where(~first).select(record), truth
