from pyspark.sql import functions as F

from noticeweave.llm import truncation
from noticeweave.session import stored


def _broadcast(plan):
    """The parts of a plan that are broadcast, as text."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*("))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            yield "\n".join(lines[i:end])


def test_endings_are_not_broadcast(spark):
    """A table of titles below the threshold of a broadcast has endings of many times its size, which no driver should hold."""
    bases = stored(spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("base"), F.lit(False).alias("marked")))
    trie = stored(truncation.ending_trie(bases))
    for least, most, n in ((truncation.LEAST, truncation.UPPER, 3000), (truncation.UPPER + 1, F.length("base"), 0)):
        found = truncation._deepest(bases, trie, least, most, 8)
        assert len(found.collect()) == n
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "posexplode" in plan and not any("posexplode" in x for x in _broadcast(plan))
