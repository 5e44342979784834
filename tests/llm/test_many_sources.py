import numpy as np
from pyspark.sql import functions as F

from shoplake.llm.packing import pack
from tests.llm.test_packing import check, reference_ids


def test_each_of_many_sources_keeps_its_share(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 100).alias("source"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 60).alias("text"))
    local = docs.toPandas()
    ids = dict(zip(local["doc_id"], reference_ids(local["text"])))
    for shares in (None, {f"s{i}": 1 + i % 3 for i in range(100)}):
        got = pack(docs.repartition(3), shares=shares).toPandas()
        check(got, ids, 2048)
        per = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).iloc[:-1]
        total = got.groupby("source")["length"].sum()[per.columns].to_numpy()
        a = np.array([shares[s] if shares else t for s, t in zip(per.columns, total)], dtype=float)
        v = np.linspace(0, (total / a).max(), 200_001)
        fluid = sum(np.minimum(t, s * v) for t, s in zip(total, a))
        at = np.interp(np.arange(1, len(per) + 1) * 2048, fluid, v)
        drift = per.cumsum().to_numpy() - np.minimum(total, np.outer(at, a))
        assert np.abs(drift).max() <= 4
