import itertools
import random

from pyspark.sql import functions as F

from noticeweave.functions.text import dice
from noticeweave.operators import resolve


def _names(n, seed):
    """Names put together from few words, as notices of one agency have them; a few lie in others."""
    rng = random.Random(seed)
    words = ["體育場館", "冷鏈", "冷冷冷冷", "led照明", "變頻空壓機", "𠮷野𠮷野", "整合升級", "導入", "示範", "a"]
    out = ["".join(rng.choices(words, k=rng.randrange(1, 7))) + "補助計畫" * rng.randrange(2) for _ in range(n)]
    return out + [x + "開跑請把握機會" * 3 for x in out[: n // 10]]


def _records_shuffled(spark, run):
    gw = spark.sparkContext._gateway
    store, none = spark.sparkContext._jsc.sc().statusStore(), gw.jvm.java.util.ArrayList()
    written = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(none, False, False, gw.new_array(gw.jvm.double, 0), none)))
    wait = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    wait()
    before = written()
    got = run()
    wait()
    return got, written() - before


def test_records_that_travel_do_not_grow_with_pairs(spark):
    """The names of one agency all end alike; no row is made for each pair that shares a bigram."""
    names = [f"{a}{b}節能設備汰換補助計畫" for a, b in itertools.product("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉", repeat=2)]
    df = spark.createDataFrame([(n, "經濟部", n) for n in names], "node string, agency string, name string")
    found, records = _records_shuffled(spark, lambda: resolve.similar_names(df, df).count())
    assert found == len(names) ** 2 and records < 20 * len(names)


def test_cells_tell_what_brute_force_tells(spark, monkeypatch):
    agencies = ["部", "部署", "部署科", "部局", "會", "會計", "", None]
    rows = [(f"{i}", agencies[i % len(agencies)], n) for i, n in enumerate([*_names(250, 1), "a", "", None])]
    left = spark.createDataFrame(rows, "node string, agency string, name string")
    right = left.where("pmod(hash(node), 3) > 0")
    a, b = left.toDF("a", "aa", "na"), right.toDF("b", "ab", "nb")
    for t in (0.72, 0.5, 0.9):
        near = a.join(b, (F.col("aa") != "") & (F.col("ab") != "") & (F.col("aa").startswith(F.col("ab")) | F.col("ab").startswith(F.col("aa"))) & (F.length("na") > 1) & (F.length("nb") > 1))
        near = near.withColumn("s", dice(F.col("na"), F.col("nb"))).where(F.col("s") >= t)
        want = sorted((r["a"], r["b"], r["s"]) for r in near.select("a", "b", F.round("s", 9).alias("s")).collect())
        assert len(want) > 100 and (t > 0.85 or any(r[2] == 0.85 for r in want))
        for cell in (20_000, 17):
            monkeypatch.setattr(resolve, "CELL", cell)
            assert sorted(tuple(r) for r in resolve.similar_names(left, right, t).collect()) == want
