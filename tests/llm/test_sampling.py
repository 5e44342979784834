from pyspark.sql import functions as F

from shoplake.llm.sampling import least_hashed


def test_equals_a_plain_top_n(spark):
    df = spark.range(20_000)
    key = F.xxhash64("id", F.lit(3))
    for most in (0, 5, 300, 19_990, 30_000):
        want = [r.id for r in df.orderBy(key, "id").limit(most).collect()]
        assert [r.id for r in least_hashed(df, key, [F.col("id")], most, 20_000).collect()] == want
