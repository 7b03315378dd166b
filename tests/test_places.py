import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.operators import places


def test_places_and_sums_over_any_partitions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]) if k % 3 else "a", rng.randint(0, 50), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = places.placed(df, ["k"], [F.col("v"), F.col("id")], f"{tmp_path}/p").collect()
    by = defaultdict(list)
    for k, v, i in rows:
        by[k].append((v, i))
    want = {i: n for x in by.values() for n, (_, i) in enumerate(sorted(x))}
    assert {r.id: r.place for r in got} == want
    ones = places.placed(df.withColumn("all", F.lit(0)), ["all"], [F.col("id")], f"{tmp_path}/q")
    ran = {r.place: r.v for r in places.summed(ones, "place", ["v"], 64).collect()}
    total = 0
    for place, (_, v, _) in enumerate(rows):
        total += v
        assert ran[place] == total
