"""Registered queries of the core: callables of (spark, sf_dir), each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeweave.functions import lifecycle as L
from noticeweave.functions import periods as P
from noticeweave.functions import text as T
from noticeweave.operators import ask, catalog, crawl, merge, resolve, timestamps, validate
from noticeweave.session import checkpoint, table
from noticeweave.sources import pages, robots

#: The clock of the queries: 2026-09-15 12:00:00 in UTC+8, as civil seconds since 1970 and as an instant.
NOW_S = 1789473600
NOW = "2026-09-15 04:00:00+00:00"
YEAR = 2026
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# A robots file for the queries; hosts of the test tables.
ROBOTS = "User-agent: *\nDisallow: /sub/\nAllow: /sub/8/\nDisallow: /*?n=6\nDisallow: /view.do$\n"
EXCLUDED = [r"名單$", r"懶人包", r"招標"]
RULES = [("溫室|農", {"delegate": "農業專區"}), ("空調", {"delegate": "空調專區", "target": "設備使用者", "amount_text": "依公告", "amount_year": 2026})]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.timestamps_found(table(spark, d, "subsidies"))


@query
def p3_times(spark: SparkSession, d: str) -> DataFrame:
    """Every value with how its instant was found."""
    return timestamps.normalise_subsidy_times(table(spark, d, "subsidies"))


@query
def catalog_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "title", "agency", "announce_date", "apply_start", "apply_end", "apply_end_time", "status_flag")
    return catalog.lifecycle_top(rows, NOW_S, 80).select("rank", "id", "status", "is_new", "days_left", "hot_text")


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.status_facet(catalog.with_status(table(spark, d, "subsidies"), NOW_S))


@query
def agency_facet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subsidies").where("agency is not null").groupBy("agency").agg(F.count(F.lit(1)).alias("n"))


@query
def category_facet(spark: SparkSession, d: str) -> DataFrame:
    return catalog.category_facet(table(spark, d, "subsidies"), "target_types")


@query
def period_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    text = L.period_text(c("period_text"), c("apply_start"), c("apply_end"), c("apply_end_time"), c("until_quota"), c("period_varies"))
    return table(spark, d, "subsidies").select("id", text.alias("period"))


@query
def visible_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "year", "status_flag", "apply_end", "until_quota", "hidden")
    return catalog.visible(rows, YEAR).select("id", "year", "carried_over")


@query
def exclusion_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "title", "official_url")
    dead = table(spark, d, "crawl_urls").where("verdict = 'error'").select(F.col("url").alias("target"))
    return catalog.without_excluded(rows, dead, EXCLUDED).select("id")


@query
def override_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "title", "year", "official_url", "source_urls", "delegate", "target", "doc_no", "amount_text")
    # Exact overrides as data: pages that turned out not to be notices lose their number and say so.
    wrong = table(spark, d, "crawl_urls").where("verdict = 'not' and url is not null").select(F.col("url").alias("target")).distinct()
    exact = wrong.withColumn("set", F.create_map(F.lit("doc_no"), F.lit(None).cast("string"), F.lit("delegate"), F.lit("none")))
    out = catalog.layered(rows, exact, RULES, ["delegate", "target", "doc_no", "amount_text"], ("amount_text",))
    return out.select("id", "delegate", "target", "doc_no", "amount_text", "manual")


@query
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.with_keys(table(spark, d, "subsidies").select("id", "agency", "year", "title", "program_name"))
    return rows.select("id", "name", "batch", "key", "key_id")


@query
def display_titles(spark: SparkSession, d: str) -> DataFrame:
    shown = T.display_title(F.lit(None).cast("string"), F.col("title"), F.col("program_name"))
    return table(spark, d, "subsidies").select("id", shown.alias("display_title"))


@query
def first_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subsidies").select("id", T.first_date(F.col("content")).alias("first_date"))


@query
def first_seen_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_urls").select("url", "source_id", "first_seen_at", "last_checked_at", "verdict")
    return merge.first_wins(rows, "url", ["first_seen_at", "last_checked_at", "source_id", "verdict"]).select("url", "source_id", "verdict")


@query
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_urls").select("url", "verdict", "content_hash", "subsidy_id", "first_seen_at", "last_checked_at", "fail_count")
    cut = F.lit("2026-01-01 00:00:00+00:00").cast("timestamp")
    old = merge.last_wins(rows.where(F.col("last_checked_at") < cut), "url", ["last_checked_at", "verdict", "content_hash", "fail_count", "subsidy_id", "first_seen_at"])
    new = rows.where(F.col("last_checked_at") >= cut)
    out = merge.upsert(old, new, "url", "last_checked_at", ["first_seen_at"], ["subsidy_id"])
    return out.select("url", "subsidy_id", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_checked_at").alias("last_us"))


@query
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "dedupe_key", "first_seen_at", "target", "doc_no", "amount_text", "until_quota", "source_urls")
    out = merge.merge_group(rows.where("dedupe_key is not null"), "dedupe_key", ["first_seen_at", "id"], ["target", "doc_no", "amount_text"], ["source_urls"], ["until_quota"])
    return out.withColumn("source_urls", F.array_join("source_urls", " "))


@query
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    return merge.unique_keys(table(spark, d, "subsidies").select("id", "dedupe_key"), "dedupe_key", "id")


@query
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_urls").where("last_checked_at is not null").select("url", "last_checked_at", "content_hash").distinct()
    out = merge.changes(rows, "url", ["last_checked_at", "content_hash"], "content_hash")
    return out.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    return crawl.failure_runs(table(spark, d, "scan_log"), "id", "ok").select("first", "last", "n")


@query
def retained_log(spark: SparkSession, d: str) -> DataFrame:
    return merge.keep_last(table(spark, d, "scan_log").select("id", "ok"), "id", 1000)


@query
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number of keys of each run's statistics; broken or empty JSON counts as none."""
    keys = F.size(F.coalesce(F.json_object_keys(F.when(F.try_parse_json("stats").isNotNull(), F.col("stats"))), F.array().cast("array<string>")))
    return table(spark, d, "scan_log").select("id", keys.alias("n_keys"), F.size(F.coalesce("errors", F.array().cast("array<string>"))).alias("n_errors"))


@query
def crawl_worklist(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "crawl_urls").select("url", "verdict", "list_date", "fail_count", "last_checked_at").where("url is not null")
    state = merge.last_wins(rows, "url", ["last_checked_at", "verdict", "fail_count", "list_date"])
    return crawl.work_list(state, NOW).select("url", "priority")


@query
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return crawl.source_health(table(spark, d, "sources_status"), table(spark, d, "crawl_urls"))


@query
def unlisted_pages(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "crawl_urls").where("list_date is not null").select("url")
    return crawl.unseen_known(table(spark, d, "subsidies"), listed, table(spark, d, "sources_status"), YEAR)


@query
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    host = crawl.host_of(F.col("url"))
    return table(spark, d, "crawl_urls").groupBy(host.alias("host")).agg(F.countDistinct("url").alias("n_urls"), F.count(F.lit(1)).alias("n_rows"))


@query
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "crawl_urls").where("url is not null").select("url").distinct().withColumn("host", crawl.host_of(F.col("url")))
    rules = robots.rules_of(spark, {"hcm.example": ROBOTS, "ses.example": ROBOTS, "geo.example": ROBOTS})
    return robots.allowed(urls, rules).select("url", "allowed")


@query
def validated_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = validate.flagged(table(spark, d, "subsidies"), validate.subsidy_rules())
    return rows.select("id", F.array_join("errors", ",").alias("errors"))


@query
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = ask.admitted(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 5)
    return rows.groupBy("day", "admitted").agg(F.count(F.lit(1)).alias("n"))


@query
def relevance_topk(spark: SparkSession, d: str) -> DataFrame:
    """Questions: the whole text of every twentieth document; against all that a notice says of itself, kinds of targets and amounts included."""
    q = table(spark, d, "documents").where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    n = table(spark, d, "subsidies").select("id", F.concat_ws(" ", "title", "summary", "target", "target_types", "amount_details").alias("text"))
    return ask.relevance_top(q, n)


@query
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    keyed = resolve.with_keys(table(spark, d, "subsidies").select("agency", "year", "title", "program_name"))
    names = keyed.where("agency <> '' and name <> ''").select("agency", "name").distinct().withColumn("node", F.concat("agency", F.lit("|"), "name"))
    names = checkpoint(names)  # read on both sides of the join
    return resolve.similar_names(names, names).where("a < b")


@query
def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Visited pages against the catalogue, by address, by key, by number in the title and by similar name.

    A key is agency, year, name and batch; pages whose title has no name have none.
    """
    c = table(spark, d, "crawl_urls").where("url is not null and verdict = 'subsidy'")
    docs = c.groupBy("url").agg(F.min("title").alias("title"), F.min("list_date").alias("list_date"), F.min("source_id").alias("source_id"))
    agencies = table(spark, d, "sources_status").select("source_id", "agency")
    year = crawl.document_year(F.lit(None).cast("string"), F.col("list_date"), F.lit(None).cast("int"), F.col("title"))
    no = F.regexp_replace(F.regexp_extract(T.normalize_text(F.col("title")), r"\p{IsHan}{1,8}字第\s*\d+\s*號", 0), r"\s", "")
    docs = docs.join(agencies, "source_id", "left").select(F.col("url").alias("doc"), "agency", year.alias("year"), "title", F.lit(None).cast("string").alias("program_name"), no.alias("doc_no"))
    docs = checkpoint(resolve.with_keys(docs))
    s = table(spark, d, "subsidies").select("id", "agency", "year", "title", "program_name", "official_url", "source_urls", "doc_no")
    known = resolve.with_keys(s)
    named = lambda df: F.when(F.col("name") != "", F.col("key"))
    exact = resolve.match_cascade(
        docs.select("doc", F.array("doc").alias("urls"), named(docs).alias("key"), "doc_no"),
        known.select("id", F.concat(F.array("official_url"), F.coalesce("source_urls", F.array().cast("array<string>"))).alias("urls"), named(known).alias("key"), "doc_no"),
    )
    exact = checkpoint(exact)
    rest = docs.join(exact.where("match is null").select("doc"), "doc", "left_semi").select("doc", "agency", "year", "name", "batch")
    similar = resolve.match_similar(rest, known.select("id", "agency", "year", "name", "batch")).withColumnRenamed("id", "_id")
    tier = F.coalesce("tier", F.when(F.col("_id").isNotNull(), 4))
    return exact.join(similar, "doc", "left").select("doc", F.coalesce("match", "_id").alias("match"), tier.alias("tier"))


@query
def match_exact(spark: SparkSession, d: str) -> DataFrame:
    """Visited pages against the catalogue by address, by normalised title and by document number, without the similarity tier."""
    c = table(spark, d, "crawl_urls").where("url is not null and verdict = 'subsidy'").groupBy("url").agg(F.min("title").alias("title"))
    name = lambda: F.nullif(T.normalize_name(F.col("title"), F.lit("")), F.lit(""))
    docs = c.select(F.col("url").alias("doc"), F.array(F.concat("url", F.lit("#again"))).alias("urls"), name().alias("key"), F.lit("").alias("doc_no"))
    s = table(spark, d, "subsidies")
    known = s.select("id", F.array(F.when(F.col("year") == YEAR, F.concat("official_url", F.lit("#again")))).alias("urls"), name().alias("key"), "doc_no")
    return resolve.match_cascade(docs, known)


@query
def number_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").where("summary is not null and content is not null")
    return rows.select("id", ask.numbers_from(F.col("summary"), F.col("content")).alias("supported"))


@query
def url_allowlist(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").where("official_url is not null")
    said = F.concat(F.lit("請見 "), "official_url", F.lit("。另見 https://elsewhere.example/page."))
    return rows.select("id", ask.hold_to_urls(said, F.array("official_url")).alias("answer"))


@query
def agency_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").where("agency is not null").select("agency", "id", "title", "year", "apply_end")
    return ask.context_lines(rows, "agency", "id", ["title", "year", "apply_end"])


@query
def dates_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every whole date of the contents with its place."""
    rows = table(spark, d, "subsidies").where("content is not null").select("id", F.inline(P.dates_in("content")))
    return rows.select("id", "day", "begin", "end")


@query
def application_periods(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").where("content is not null").select("id", P.period_in("content", "announce_date").alias("p"))
    return rows.select("id", "p.*")


@query
def announcement_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subsidies").where("content is not null").select("id", P.announcement_in("content").alias("day"))


@query
def current_batches(spark: SparkSession, d: str) -> DataFrame:
    """The batch to show of each notice that lists batches."""
    rows = table(spark, d, "subsidies").where("content is not null").select("id", P.batches_in("content").alias("b"))
    return rows.where(F.size("b") > 0).select("id", F.size("b").alias("n_batches"), P.picked_batch(F.col("b"), F.lit("2026-09-15")).alias("b")).select("id", "n_batches", "b.no", "b.start", "b.end", "b.tentative")


@query
def numbers_supported(spark: SparkSession, d: str) -> DataFrame:
    """Like ``number_provenance``, with Chinese numbers, percents and fractions read as numbers on both sides."""
    rows = table(spark, d, "subsidies").where("summary is not null and content is not null")
    return rows.select("id", ask.numbers_from(F.col("summary"), F.col("content"), han=True).alias("supported"))


@query
def reranked_list(spark: SparkSession, d: str) -> DataFrame:
    """The first eighty notices for one question: what it finds first, then the catalogue in its order."""
    q = table(spark, d, "documents").where("text is not null").groupBy().agg(F.min(F.struct("doc_id", "text")).alias("m")).select(F.col("m.doc_id").alias("qid"), F.col("m.text").alias("question"))
    rows = table(spark, d, "subsidies").select("id", "title", "summary", "target", "target_types", "amount_details", "announce_date", "apply_start", "apply_end", "apply_end_time", "status_flag")
    n = rows.select("id", F.concat_ws(" ", "title", "summary", "target", "target_types", "amount_details").alias("text"))
    ordered = catalog.lifecycle_top(rows, NOW_S, 86).select("id", "rank")
    hits = ask.relevance_top(q, n)
    # Six hits at most can come from below the first eighty.
    both = ordered.select("id", "rank").unionByName(hits.join(ordered, "id", "left_anti").select("id", F.lit(1_000_000).alias("rank")))
    return ask.reranked(both, hits.select("id", "score")).select("place", "id")


def _wrong_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_urls").where("verdict = 'not' and url is not null").select(F.col("url").alias("target")).distinct()


@query
def year_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of a year: candidates by year or override, those that show, in the columns of a list."""
    rows = table(spark, d, "subsidies").select("id", "title", "agency", "year", "status_flag", "apply_end", "until_quota", "hidden", "official_url", "program_name", "views")
    shown = catalog.visible(catalog.listed(rows, YEAR, _wrong_pages(spark, d)).withColumn("ongoing", F.col("program_name").isNotNull()), YEAR, "ongoing")
    return shown.select("id", "agency", "year", "official_url", "views", "ongoing", "carried_over")


@query
def listed_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "year", "hidden", "official_url")
    return catalog.listed(rows, YEAR, _wrong_pages(spark, d)).select("id", "year")


@query
def notice_detail(spark: SparkSession, d: str) -> DataFrame:
    """One notice by its id, here the smallest that isn't hidden."""
    rows = table(spark, d, "subsidies")
    first = rows.where("not coalesce(hidden, false)").agg(F.min("id")).first()[0]
    return catalog.notice(rows, first).select("id", "title", "agency", "year", "official_url", "target", "doc_no")


@query
def source_errors(spark: SparkSession, d: str) -> DataFrame:
    """The known values of some keys as one map, written as JSON."""
    pairs = table(spark, d, "sources_status").select(F.col("source_id").alias("key"), F.col("agency").alias("value"))
    return catalog.values_of(pairs, ["erm", "ses", "geo", "nobody"]).select(F.to_json("values").alias("json"))


def _choice(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Rows with status, and the agency with most of them (of several the first)."""
    rows = catalog.with_status(table(spark, d, "subsidies").select("id", "agency", "target_types", "status_flag", "announce_date", "apply_start", "apply_end", "apply_end_time"), NOW_S)
    top = rows.where("agency is not null").groupBy("agency").count().orderBy(F.desc("count"), "agency").first()
    return rows, top["agency"] if top else ""


@query
def status_facet_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status under a chosen agency and category, whatever status is chosen."""
    rows, agency = _choice(spark, d)
    return catalog.status_facet(catalog.chosen(rows, "status", status="open", agency=agency, category="工業"))


@query
def list_totals(spark: SparkSession, d: str) -> DataFrame:
    rows, agency = _choice(spark, d)
    return catalog.totals(rows, status="open", agency=agency, category="工業")


@query
def agency_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.agency_list(table(spark, d, "subsidies"))


@query
def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subsidies").select("id", F.array_join(T.categories_of(F.col("target_types")), "|").alias("categories"))


@query
def title_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subsidies").select("id", F.array_join(T.title_tags(F.col("title"), F.col("period_text")), "|").alias("tags"))


@query
def target_points(spark: SparkSession, d: str) -> DataFrame:
    own = F.lit(None).cast("array<string>")
    return table(spark, d, "subsidies").select("id", F.array_join(T.target_points(own, F.col("target")), "|").alias("points"))


@query
def short_periods(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    text = L.period_text(c("period_text"), c("apply_start"), c("apply_end"), c("apply_end_time"), c("until_quota"), c("period_varies"))
    return table(spark, d, "subsidies").select("id", T.short_period(text).alias("period"))


@query
def amounts_in_words(spark: SparkSession, d: str) -> DataFrame:
    """Whole amounts of orders as a card shows them."""
    n = F.floor(F.col("o_totalprice")).cast("long") * F.when(F.col("o_orderkey") % 3 == 0, 100).when(F.col("o_orderkey") % 3 == 1, 10_000).otherwise(1)
    return table(spark, d, "orders").select("o_orderkey", T.dollars(n).alias("words"))


@query
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Listed pages, pinned programmes and known notices as one set of candidates."""
    c, s = table(spark, d, "crawl_urls"), table(spark, d, "subsidies")
    lists = c.where("list_date is not null").select("url", "title", "list_date", "source_id")
    pinned = s.where("program_name is not null and official_url is not null").groupBy("program_name").agg(F.min("official_url").alias("url"))
    pinned = pinned.select("url", F.col("program_name").alias("title"), F.lit(None).cast("string").alias("list_date"), F.lit("program").alias("source_id"))
    first = table(spark, d, "sources_status").groupBy("agency").agg(F.min("source_id").alias("source_id"))
    known = s.where(f"year >= {YEAR - 1} and official_url is not null").select("official_url", "title", "announce_date", "agency").join(first, "agency", "left")
    known = known.select(F.col("official_url").alias("url"), "title", F.col("announce_date").alias("list_date"), F.coalesce("source_id", F.lit("known")).alias("source_id"))
    dead = c.where("verdict = 'error'").select(F.col("url").alias("target"))
    return crawl.candidate_pages(lists, pinned, known, dead, f"{YEAR - 1}-01-01")


@query
def document_years(spark: SparkSession, d: str) -> DataFrame:
    year = crawl.document_year(F.col("announce_date"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("title"))
    return table(spark, d, "subsidies").select("id", year.alias("doc_year"))


@query
def picked_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that were cut, repaired from the lines of the page."""
    t = crawl.picked_title(F.col("title"), F.col("content"), F.col("program_name"), F.lit(None).cast("string"))
    return table(spark, d, "subsidies").select("id", t.alias("title"))


@query
def redirect_ends(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose notice has another official address lead there, at most two steps."""
    c, s = table(spark, d, "crawl_urls"), table(spark, d, "subsidies").select(F.col("id").alias("_id"), "official_url")
    links = c.where("url is not null").select("url", "subsidy_id").join(s, F.col("subsidy_id") == F.col("_id"), "left")
    return crawl.followed(links.select("url", F.col("official_url").alias("target")))


@query
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return crawl.run_statistics(table(spark, d, "crawl_urls"))


@query
def drift_alarms(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "subsidies")
    pinned = s.where("program_name is not null and official_url is not null").groupBy("program_name").agg(F.min("official_url").alias("url"))
    out = crawl.drifted(pinned.withColumnRenamed("program_name", "programme"), table(spark, d, "crawl_urls"), s, YEAR, "2026-09-15")
    return out.select("programme", "url", F.array_join("warnings", ",").alias("warnings"))


@query
def withdrawn_notices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "official_url", "hidden")
    return merge.withdrawn(rows, _wrong_pages(spark, d)).select("id", "hidden", "changed")


@query
def link_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "subsidies").select("id", "official_url", "link_status")
    checked = table(spark, d, "crawl_urls").select("url", (F.coalesce("verdict", F.lit("")) != "error").alias("ok"), F.col("reason").isNotNull().alias("permanent"), "fail_count")
    return merge.link_states(rows, checked).select("id", "link_status")


@query
def replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """Exclusions as a delivery that replaces all: of a repeated address the last check counts."""
    rows = table(spark, d, "crawl_urls").select("url", "verdict", "last_checked_at")
    return merge.replaced_all(rows.limit(0), rows.where("verdict = 'error'"), "url", "last_checked_at").select("url", F.unix_micros("last_checked_at").alias("at_us"))


@query
def merge_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every notice against the next one, by id, of its key without batch: by which case the second is merged into the first."""
    cols = ["id", "title", "year", "announce_date", "apply_start", "apply_end", "deadline_text", "target", "amount_text", "summary", "doc_no", "delegate", "until_quota", "status_flag", "official_url", "source_urls", "first_seen_at"]
    s = table(spark, d, "subsidies").where("dedupe_key is not null").withColumn("_name", F.regexp_replace("dedupe_key", r"\|[^|]*\z", ""))
    row = F.struct(*cols)
    pairs = s.groupBy("_name").agg(F.min(row).alias("old"), F.max(row).alias("new"), F.count(F.lit(1)).alias("_n"))
    pairs = pairs.withColumn("old", F.when(F.col("_n") > 1, F.col("old")))
    out = merge.merged_notice(pairs)
    return out.select(F.col("merged.id").alias("id"), "case", "merged.title", "merged.year", "merged.target", "merged.amount_text", "merged.apply_end", "merged.until_quota", "merged.status_flag", "merged.official_url")


@query
def page_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Notices rendered as pages and read back: title, heading and links survive."""
    rows = table(spark, d, "subsidies").where("title is not null and official_url is not null").select("id", "title", "official_url", "content")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.replace(esc(F.coalesce("content", F.lit(""))), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit('</title></head><body><nav><a href="/">首頁首頁首頁</a></nav><main><h1>'), esc(F.col("title")),
                    F.lit("</h1><p>"), body, F.lit('</p><ul><li><a href="'), "official_url", F.lit('">'), esc(F.col("title")), F.lit("</a></li></ul></main></body></html>"))
    page = rows.select("id", "official_url", html.alias("html"))
    got = page.select("id", pages.main_of("html").alias("m"), pages.links_of("html", "official_url").alias("links"))
    return got.select("id", "m.title", "m.heading", F.length("m.text").alias("n_text"), F.size(F.filter("links", lambda x: ~x["in_nav"])).alias("n_links"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _list_pages(spark: SparkSession, d: str) -> DataFrame:
    """``(url, html)``: the visited pages rendered as list pages of their source, about fifty rows to a page."""
    rows = table(spark, d, "crawl_urls").where("url is not null and title is not null and source_id is not null")
    rows = rows.groupBy("source_id", "url").agg(F.max("title").alias("title"), F.max("list_date").alias("list_date"))
    li = F.concat(F.lit("<li><span>"), F.coalesce("list_date", F.lit("")), F.lit('</span> <a href="'), _escaped(F.col("url")), F.lit('">'), _escaped(F.col("title")), F.lit("</a></li>"))
    page = F.concat(F.lit("https://"), "source_id", F.lit(".example/list?p="), F.floor(F.pmod(F.xxhash64("url"), F.lit(97))).cast("string"))
    items = rows.select(page.alias("page"), F.struct("url", li.alias("li")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["li"]), "")
    pages_ = items.groupBy(F.col("page").alias("url")).agg(body.alias("body"))
    return pages_.select("url", F.concat(F.lit('<nav><a href="/x">網站導覽網站導覽</a><a href="/news">最新消息公告</a><a href="?p=next" title="下一頁">›</a></nav><ul>'), "body", F.lit("</ul>")).alias("html"))


@query
def list_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of list pages outside their navigation, with the longest title and any date of each address."""
    links = _list_pages(spark, d).select(F.inline(pages.links_of("html", "url"))).where("not in_nav")
    return links.groupBy("url").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("title"), F.max("date").alias("date"))


@query
def next_list_pages(spark: SparkSession, d: str) -> DataFrame:
    return _list_pages(spark, d).select("url", pages.next_of("html", "url").alias("next"))


@query
def discovered_list_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.discovered_lists(_list_pages(spark, d)).select("url", "list_url", "score", "rank")


@query
def row_documents(spark: SparkSession, d: str) -> DataFrame:
    """Notices rendered as rows of a table without pages of their own, and read back."""
    rows = table(spark, d, "subsidies").where("title is not null and announce_date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").select("id", "title", "announce_date")
    html = F.concat(F.lit("<table><tr><th>日期</th><th>名稱</th></tr><tr><td>"), "announce_date", F.lit("</td><td>"), _escaped(F.col("title")), F.lit("</td></tr></table>"))
    got = rows.select("id", F.inline(pages.rows_of(html, F.lit("https://a.example/list#top"))))
    return got.select("id", "title", "date", F.length("text").alias("n_text"))


@query
def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Attachments of notices rendered as links of a page, and read back."""
    rows = table(spark, d, "subsidies").where("attachments is not null").select("id", "attachments")
    links = F.transform("attachments", lambda a: F.concat(F.lit('<p><a href="'), _escaped(F.coalesce(a["url"], F.lit(""))), F.lit('">'), _escaped(F.coalesce(a["label"], F.lit(""))), F.lit("</a></p>")))
    html = F.concat(F.lit("<main>"), F.array_join(links, ""), F.lit("</main>"))
    return rows.select("id", F.inline(pages.files_of(html, F.lit("https://a.example/")))).select("id", "url", "label")


@query
def challenged_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as fetched pages: which ask for a browser, lead elsewhere or are too large."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", pages.is_challenge(F.col("text")).alias("challenge"), pages.within_limit(F.col("text"), 5 << 20).alias("fits"),
                       pages.resolved(pages.redirect_target(F.col("text")), F.col("url")).alias("leads_to"))


@query
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by local day and kind, as the streaming function computes them."""
    from noticeweave.streaming.state import daily_counts

    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return daily_counts(rows, "ts", "event_type")
