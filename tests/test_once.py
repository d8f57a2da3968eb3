"""Records are normalized once for all that reads them."""

import __spark_entry__ as entry
from quillmark.plans import registry

SF = "/root/testdata/sf0.001"


def test_block_universe_normalizes_once(spark, monkeypatch):
    made = []
    normal = registry._normal
    for name in ("quillmark.plans.registry._normal", "quillmark.plans.stages._normal"):
        monkeypatch.setattr(name, lambda s, d: made.append(d) or normal(s, d))
    plan = entry.queries()["j20_block_universe"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "business_name" not in plan and "text" not in plan.replace("context", "")
