"""Crawl state: candidates, recheck work-list, failure runs, change of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import text as T
from noticeweave.session import numbered

RECHECK_HOURS = {"subsidy": 6, "error": 2}
MAX_FAILURES = 12
BATCH = 150


def host_of(url: Column) -> Column:
    """Host in lower case without ``www.``; null for what is no web address."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://(?:www\.)?([^/:?#]+)", 1)), F.lit(""))


def same_site(url: Column, home: Column) -> Column:
    """Whether one host equals the other or lies below it; false if either is unknown."""
    a, b = host_of(url), host_of(home)
    return F.coalesce((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)), F.lit(False))


def recheck_priority(verdict: Column, checked: Column, fails: Column, now: Column) -> Column:
    """0 never seen, 1 a failed page that may be tried again, 2 a notice that is due; null if it can wait.

    Notices are due after six hours, failed pages after two and below twelve failures; others are never fetched again.
    """
    hours = (now.cast("long") - checked.cast("long")) / 3600
    return (
        F.when(verdict.isNull() | checked.isNull(), 0)
        .when((verdict == "error") & (hours >= RECHECK_HOURS["error"]) & (F.coalesce(fails, F.lit(0)) < MAX_FAILURES), 1)
        .when((verdict == "subsidy") & (hours >= RECHECK_HOURS["subsidy"]), 2)
    )


def work_list(candidates: DataFrame, now: str, k: int = BATCH) -> DataFrame:
    """The ``k`` candidates to fetch next, by priority, newest list date first, then URL: a top-k."""
    due = candidates.withColumn("priority", recheck_priority(F.col("verdict"), F.col("last_checked_at"), F.col("fail_count"), F.lit(now).cast("timestamp")))
    return due.where("priority is not null").orderBy("priority", F.coalesce("list_date", F.lit("")).desc(), "url").limit(k)


def failure_runs(log: DataFrame, order: str, ok: str) -> DataFrame:
    """``(run, first, last, n)`` of each run of consecutive failures, over the numbered log.

    Gaps and islands without one global window: a run is named by the number of successes before it, which come from sums
    of ranges of the log. A null outcome is a failure.
    """
    rows = log.select(F.col(order).alias("at"), F.coalesce(F.col(ok), F.lit(False)).cast("long").alias("good"))
    rows = numbered(rows, [], ["at"], "good")
    return rows.where("good = 0").groupBy(F.col("n").alias("run")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))


def source_health(status: DataFrame, urls: DataFrame) -> DataFrame:
    """Per source: its pages by verdict, and whether it has alarmed (six failures in a row, or never a success)."""
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(f"n_{v}")
    pages = urls.groupBy("source_id").agg(F.countDistinct("url").alias("n_pages"), n("subsidy"), n("not"), n("error"))
    out = status.join(pages, "source_id", "left")
    alarm = (F.coalesce("consecutive_failures", F.lit(0)) >= 6) | F.col("last_success_at").isNull()
    return out.select(
        "source_id", "agency", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pages", "n_subsidy", "n_not", "n_error")], alarm.alias("alarm")
    )


def unseen_known(subsidies: DataFrame, candidates: DataFrame, status: DataFrame, year: int | None = None) -> DataFrame:
    """Catalogue pages that no list shows any more, with the first source of their agency, else ``known``.

    With ``year``, only notices of that year, the one before or later ones; rows of lists, which have no page of their own, never.
    """
    known = subsidies.where("official_url is not null and not contains(official_url, '#row-')")
    if year is not None:
        known = known.where(F.col("year") >= year - 1)
    known = known.select(F.col("official_url").alias("url"), "agency", "id")
    first = status.groupBy("agency").agg(F.min("source_id").alias("source_id"))
    rest = known.join(candidates.select("url").distinct(), "url", "left_anti").join(first, "agency", "left")
    return rest.select("id", "url", F.coalesce("source_id", F.lit("known")).alias("source_id"))


def candidate_pages(lists: DataFrame, programmes: DataFrame, known: DataFrame, excluded: DataFrame, since: str) -> DataFrame:
    """``(url, title, list_date, source_id, kind)``: the pages that may be fetched, each address once.

    Each input has ``url, title, list_date, source_id``. A programme's page counts before a list's, a list's before that of a known
    notice; of several of a kind the smallest source, date and title. Pages of ``excluded`` (``target``) and list pages dated
    before ``since`` are left out; undated ones stay.
    """
    fields = ("title", "list_date", "source_id")
    kind = lambda df, rank, name: df.select("url", F.struct(F.lit(rank).alias("r"), F.col("source_id"), F.col("list_date"), F.col("title"), F.lit(name).alias("kind")).alias("v"))
    dated = lists.where(F.coalesce(F.col("list_date") >= since, F.lit(True))).join(excluded.select(F.col("target").alias("url")).distinct(), "url", "left_anti")
    rows = kind(programmes, 0, "programme").unionByName(kind(dated, 1, "list")).unionByName(kind(known, 2, "known"))
    one = rows.where("url is not null").groupBy("url").agg(F.min("v").alias("v"))
    return one.select("url", *[F.col(f"v.{f}").alias(f) for f in fields], "v.kind")


def picked_title(title: Column, text: Column, heading: Column, page: Column) -> Column:
    """A list's title, or, where it is cut or short, the first longer line of the page that begins like it, else its heading."""
    t = F.trim(F.coalesce(title, F.lit("")))
    cut = t.rlike(r"(\.\.\.|…)\z")
    head = F.left(F.regexp_replace(t, r"(\.\.\.|…)\z", ""), F.lit(12))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (head != "") & x.startswith(head) & (F.length(x) > F.length(t)))
    better = F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(200)), F.when(F.length(heading) > F.length(t), heading))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(cut | (F.length(t) < 8), better), some(t), some(heading), page)


def document_year(announced: Column, listed: Column, numbered_year: Column, title: Column) -> Column:
    """The year of a page: of its announcement, else of its list date, else of its number, else the one that its title names."""
    four = lambda c: F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")
    named = F.regexp_extract(T.normalize_text(title), r"(?<!\d)(\d{2,3})\s*年度", 1).try_cast("int")
    return F.coalesce(four(announced), four(listed), numbered_year, F.when(named.between(70, 200), named + 1911))


def followed(pages: DataFrame, target: str = "target", steps: int = 2) -> DataFrame:
    """``(url, final_url, hops)``: where pages lead by their redirects (``url, target``), ``steps`` at most; a page to itself stops.

    Each step is one join of the pages that lead on with all pages by address; a target that was never fetched ends there.
    """
    links = pages.where(F.col(target).isNotNull() & (F.col(target) != F.col("url"))).groupBy(F.col("url").alias("_from")).agg(F.min(target).alias("_to"))
    out = pages.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops")).distinct()
    for _ in range(steps):
        out = out.join(links, F.col("final_url") == F.col("_from"), "left")
        out = out.select("url", F.coalesce("_to", "final_url").alias("final_url"), (F.col("hops") + F.col("_to").isNotNull().cast("int")).alias("hops"))
    return out


def run_statistics(pages: DataFrame) -> DataFrame:
    """One row with what a run did: pages, notices, others, failures, and how many sources it saw."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return pages.agg(
        F.count(F.lit(1)).alias("n_pages"), n("subsidy").alias("n_subsidy"), n("not").alias("n_not"), n("error").alias("n_error"),
        F.countDistinct("source_id").alias("n_sources"), F.count_if(F.coalesce("fail_count", F.lit(0)) >= 3).alias("n_failing"),
    )


def drifted(programmes: DataFrame, state: DataFrame, notices: DataFrame, year: int, today: str) -> DataFrame:
    """``(programme, url, warnings)`` of pinned programmes (``programme, url``) whose page seems out of date.

    ``unreadable``: the page failed three times or more; ``old_year``: its notice is of an earlier year; ``ended``: its notice's
    end is over. A notice belongs to a page by its own or any of its other addresses, the smallest id first. Programmes without
    any warning give no row.
    """
    none = F.array().cast("array<string>")
    named = notices.select("id", "year", "apply_end", F.explode(F.array_distinct(F.concat(F.array("official_url"), F.coalesce("source_urls", none)))).alias("url")).where("url is not null")
    wanted = named.join(programmes.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min(F.struct("id", "year", "apply_end")).alias("s"))
    fails = state.groupBy("url").agg(F.max("fail_count").alias("fails"))
    rows = programmes.join(fails, "url", "left").join(wanted, "url", "left")
    said = F.array_compact(F.array(
        F.when(F.col("fails") >= 3, "unreadable"), F.when(F.col("s.year") < year, "old_year"), F.when((F.col("s.apply_end") != "") & (F.col("s.apply_end") < today), "ended"),
    ))
    return rows.select("programme", "url", said.alias("warnings")).where(F.size("warnings") > 0)
