"""Robots rules as data: parsing and the longest-match decision."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "host string, allow boolean, path string, pattern string"


def parse(text: str, agent: str = "") -> list[tuple[bool, str]]:
    """``(allow, path)`` in order, of the groups for all agents and for ``agent``; empty paths say nothing.

    Agent lines in a row open one group; the first other line closes the list of agents.
    """
    found, mine, open_group = [], False, True
    for line in text.splitlines():
        name, sep, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep or not re.fullmatch(r"[\w-]+", name):
            continue
        if name == "user-agent":
            if not open_group:
                mine, open_group = False, True
            mine = mine or value == "*" or bool(agent and agent.lower() in value.lower())
        else:
            open_group = False
            if mine and value and name in ("allow", "disallow"):
                found.append((name == "allow", value))
    return found


def pattern_of(path: str) -> str:
    """A path rule as a regular expression: ``*`` is anything, a final ``$`` the end."""
    body, end = (path[:-1], r"\z") if path.endswith("$") else (path, "")
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + end


def rules_of(spark, texts: dict[str, str], agent: str = "") -> DataFrame:
    """Rules of each host's text as a frame."""
    rows = [(host, allow, path, pattern_of(path)) for host, text in texts.items() for allow, path in parse(text, agent)]
    return spark.createDataFrame(rows, RULES)


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (``url, host``) with ``allowed``: the longest rule of the host that matches decides, on a tie allow.

    Path and query are matched. Hosts without rules, and pages that no rule matches, are allowed. A host's rules travel
    as one array, so the join is by host and needs no pair per rule.
    """
    per = rules.groupBy(F.col("host").alias("_h")).agg(F.collect_list(F.struct(F.length("path").alias("n"), "allow", "pattern")).alias("_rules"))
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/?#]*", ""), "#.*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    df = urls.join(per, F.col("host") == F.col("_h"), "left").withColumn("_path", path)
    hits = F.filter(F.coalesce("_rules", F.array().cast("array<struct<n:int,allow:boolean,pattern:string>>")), lambda r: F.regexp_like("_path", r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return df.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_h", "_rules", "_path")
