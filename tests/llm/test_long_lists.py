import random
import re

from pyspark.sql import functions as F

from noticeweave.llm import boilerplate as B


def followed(codes):
    """Line by line."""
    out, below = list(codes), False
    for i, c in enumerate(codes):
        below = c == "h" or (below and c in "Ib")
        if below and c == "I":
            out[i] = "L"
    first = "".join(out)
    for i, c in enumerate(first):
        left, right = first[:i].rstrip("b"), first[i + 1 :].lstrip("b")
        if c in "SCWI" and (not left or left[-1] in "FhL") and (not right or right[0] in "FhL"):
            out[i] = "L"
    return "".join(out)


def test_lists_of_any_length(spark):
    rng = random.Random(2)
    texts = ["h" + "I" * 40 + "P", "h" + "bI" * 30 + "CP", "F" + "b" * 20 + "C" + "b" * 20 + "F", "IIhII", "PIII", "", "I", "bbCbb"]
    texts += ["".join(rng.choice("hIIIbbFSCWP") for _ in range(rng.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = {r["c"]: r["x"] for r in df.select("c", B._follow_lists(F.col("c")).alias("x")).collect()}
    assert got == {t: followed(t) for t in texts}
    assert got[texts[0]] == "h" + "L" * 40 + "P" and re.fullmatch("Fb{20}Lb{20}F", got[texts[2]])
