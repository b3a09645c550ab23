"""SQL for DuckDB that computes what the queries of the core compute."""

from __future__ import annotations

from noticeweave.functions.text import _FROM, _TO, CATEGORIES, NAME_BATCHES, NAME_SIGNS, NAME_YEARS, NOTICE_WORDS, OLD_CATEGORIES, TITLE_STEPS, WIDE_SIGNS
from noticeweave.operators.ask import SYNONYMS

_DAY = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} AS DATE) END"
_SEC = "date_diff('day', DATE '1970-01-01', " + _DAY + ") * 86400"
_END = (
    _SEC.format("apply_end")
    + " + CASE WHEN regexp_full_match(coalesce(apply_end_time, ''), '\\d{1,2}:\\d{2}') THEN CAST(split_part(apply_end_time, ':', 1) AS BIGINT) * 3600"
    + " + CAST(split_part(apply_end_time, ':', 2) AS BIGINT) * 60 ELSE 86399 END"
)
_FLAGS = "('quota_full', 'budget_exhausted', 'closed_early', 'closed')"
_STATUS = f"""
s AS (
    SELECT *, {_SEC.format("apply_start")} AS start_s, {_END} AS end_s, coalesce({_SEC.format("announce_date")}, 0) AS ann_s,
           coalesce(date_diff('day', {_DAY.format("announce_date")}, DATE '2026-09-15') BETWEEN 0 AND 7, false) AS is_new,
           date_diff('day', DATE '2026-09-15', {_DAY.format("apply_end")}) AS left_d
    FROM subsidies
),
t AS (
    SELECT *, CASE WHEN status_flag IN {_FLAGS} THEN 'closed' WHEN 1789473600 > end_s THEN 'closed' WHEN 1789473600 < start_s THEN 'upcoming'
                   WHEN coalesce(start_s, end_s) IS NOT NULL THEN 'open' ELSE 'unknown' END AS status FROM s
)
"""
_RANK = """
u AS (
    SELECT *, CASE WHEN is_new THEN 0 ELSE CASE status WHEN 'open' THEN 1 WHEN 'upcoming' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END END AS grp FROM t
)
"""
_WS = "[\\s\\x{00A0}\\x{3000}]"
_URLSTATE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {order}) AS n FROM crawl_urls {where}) WHERE n = 1"
_BIG = "CASE WHEN length({0}) >= 2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) ELSE [] END"
_EXPAND = "concat_ws(' ', q, " + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{w}' END" for p, w in SYNONYMS) + ")"
_STRIP = "regexp_replace({0}, '[\\s\\x{{00A0}}\\x{{3000}}\\p{{P}}\\p{{S}}]', '', 'g')"
_NUMS = "list_distinct(regexp_extract_all(regexp_replace(regexp_replace({0}, '(\\d),(\\d{{3}})', '\\1\\2', 'g'), '(\\d),(\\d{{3}})', '\\1\\2', 'g'), '\\d+(?:\\.\\d+)?'))"



def _replace_all(text: str, steps: list[tuple[str, str, str]]) -> str:
    for pattern, new, mode in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}'{mode})"
    return text


_Q = "regexp_extract({0}, '[「『]([^」』]{{4,60}})[」』]', 1)"
# The patterns of the functions as DuckDB takes them: numbered groups, and a class of spaces by code point.
_SHOWN = _replace_all("n", [(p.replace("[\\s \u3000]", "[\\s\\x{3000}]"), new.replace("$", "\\"), ", 's'" if new else "") for p, new in TITLE_STEPS])
_DISPLAY = f"""WITH a AS (SELECT id, coalesce(title, '') AS t, program_name FROM subsidies),
    b AS (SELECT id, t, CASE WHEN {_Q.format("t")} <> '' THEN {_Q.format("t")} WHEN coalesce(program_name, '') <> '' THEN program_name ELSE t END AS n FROM a)
    SELECT id, coalesce(nullif(trim({_SHOWN}, ' '), ''), t) AS display_title FROM b"""
_PLAIN = f"regexp_replace(translate(coalesce({{0}}, ''), '{WIDE_SIGNS[0] + _FROM}', '{WIDE_SIGNS[1] + _TO}'), '[\\x{{{{00A0}}}}\\x{{{{3000}}}}\\t]+', ' ', 'g')"
_NAME_STEPS = _replace_all("s", [(p, "", ", 'g'") for p in (NAME_YEARS, NAME_BATCHES, NOTICE_WORDS, NAME_SIGNS)])
_NAMES = f"""WITH a AS (SELECT *, {_PLAIN.format("CASE WHEN coalesce(program_name, '') <> '' THEN program_name ELSE title END")} AS u, {_PLAIN.format("title")} AS pt FROM subsidies),
    b AS (SELECT *, CASE WHEN coalesce(program_name, '') = '' AND {_Q.format("u")} <> '' THEN {_Q.format("u")} ELSE u END AS s,
        regexp_extract(pt, '第\\s*([一二三四五六七八九十\\d]+)\\s*(梯次|次|期|波)', 1) AS raw FROM a),
    c AS (SELECT id, agency, year, lower({_NAME_STEPS}) AS name, CASE WHEN regexp_full_match(raw, '\\d+') THEN CAST(CAST(raw AS BIGINT) AS VARCHAR)
        WHEN length(raw) = 1 THEN CAST(instr('一二三四五六七八九十', raw) AS VARCHAR) ELSE raw END AS batch FROM b),
    d AS (SELECT *, coalesce(agency, '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || name || '|' || batch AS key FROM c)
    SELECT id, name, batch, key, substr(sha1(key), 1, 12) AS key_id FROM d"""

ORACLES: dict[str, str] = {
    "catalog_lifecycle": f"""WITH {_STATUS}, {_RANK}, r AS (
        SELECT *, row_number() OVER (ORDER BY grp,
            CASE WHEN grp = 0 THEN -ann_s WHEN grp = 4 THEN -coalesce(end_s, ann_s) ELSE end_s END NULLS LAST,
            CASE WHEN grp = 0 THEN end_s WHEN grp IN (1, 2, 3) AND end_s IS NULL THEN -ann_s END NULLS LAST,
            CASE WHEN grp = 0 THEN -ann_s END NULLS LAST, id) AS rank FROM u)
        SELECT CAST(rank AS INTEGER) AS rank, id, status, is_new, CASE WHEN status = 'open' THEN CAST(left_d AS INTEGER) END AS days_left,
            CASE WHEN status = 'open' AND left_d = 0 THEN '今天截止' WHEN status = 'open' AND left_d BETWEEN 1 AND 7 THEN '剩餘 ' || left_d || ' 天' END AS hot_text
        FROM r WHERE rank <= 80""",
    "status_counts": f"WITH {_STATUS} SELECT coalesce(status, '') AS status, count(*) AS n FROM t GROUP BY ROLLUP (status)",
    "agency_facet": "SELECT agency, count(*) AS n FROM subsidies WHERE agency IS NOT NULL GROUP BY agency",
    "category_facet": "SELECT category, count(*) AS n FROM (SELECT unnest(list_distinct(target_types)) AS category FROM subsidies) WHERE category IS NOT NULL GROUP BY category",
    "period_texts": """WITH f AS (
        SELECT *, '^第\\s*([一二三四五六七八九十\\d]+)\\s*梯次?\\s*([（(]暫定[）)])?\\s*' AS head,
            CASE WHEN regexp_full_match(apply_start, '\\d{4}-\\d{2}-\\d{2}') THEN replace(apply_start, '-', '/') ELSE '官方未明載' END AS s,
            CASE WHEN regexp_full_match(apply_end, '\\d{4}-\\d{2}-\\d{2}') THEN replace(apply_end, '-', '/') ELSE '官方未明載' END
                || CASE WHEN coalesce(apply_end_time, '') <> '' THEN ' ' || apply_end_time ELSE '' END AS e FROM subsidies)
        SELECT id, CASE WHEN coalesce(period_text, '') <> '' THEN CASE WHEN regexp_matches(period_text, head)
                THEN regexp_replace(period_text, head, '') || CASE WHEN regexp_extract(period_text, head, 2) <> '' THEN '（暫定）' ELSE '' END ELSE period_text END
            WHEN coalesce(apply_start, '') <> '' AND coalesce(apply_end, '') <> '' THEN s || ' ～ ' || e || CASE WHEN coalesce(period_varies, false) THEN '（依類別不同）' ELSE '' END
            WHEN coalesce(apply_start, '') <> '' AND coalesce(until_quota, false) THEN s || ' 起（額滿為止）'
            WHEN coalesce(apply_start, '') <> '' THEN s || ' 起（截止日官方未明載）' WHEN coalesce(apply_end, '') <> '' THEN '至 ' || e || ' 止'
            WHEN coalesce(until_quota, false) THEN '額滿為止' ELSE '官方未明載' END AS period FROM f""",
    "visible_year": f"""WITH v AS (SELECT id, year, hidden, status_flag, CASE WHEN coalesce(apply_end, '') <> '' THEN apply_end >= '2026-01-01'
            ELSE coalesce(until_quota, false) END AS runs_on FROM subsidies)
        SELECT id, year, year <> 2026 AS carried_over FROM v
        WHERE NOT coalesce(hidden, false) AND (year = 2026 OR (year = 2025 AND coalesce(status_flag, '') = '' AND runs_on))""",
    "exclusion_anti": """SELECT id FROM subsidies s WHERE NOT coalesce(regexp_matches(title, '(名單$)|(懶人包)|(招標)'), false)
        AND NOT EXISTS (SELECT 1 FROM crawl_urls c WHERE c.verdict = 'error' AND c.url = s.official_url) AND NOT EXISTS (SELECT 1 FROM crawl_urls c WHERE c.verdict = 'error' AND c.url = s.id)""",
    "override_layers": """WITH x AS (SELECT DISTINCT url FROM crawl_urls WHERE verdict = 'not' AND url IS NOT NULL),
        m AS (SELECT s.*, x.url IS NOT NULL OR y.url IS NOT NULL OR EXISTS (SELECT 1 FROM x z WHERE list_contains(s.source_urls, z.url)) AS ex,
            coalesce(regexp_matches(title, '空調'), false) AS cool, coalesce(regexp_matches(title, '溫室|農'), false) AS farm
            FROM subsidies s LEFT JOIN x ON x.url = s.official_url LEFT JOIN x y ON y.url = s.id)
        SELECT id, CASE WHEN ex THEN 'none' WHEN cool THEN '空調專區' WHEN farm THEN '農業專區' ELSE delegate END AS delegate,
            CASE WHEN cool THEN '設備使用者' ELSE target END AS target, CASE WHEN NOT ex THEN doc_no END AS doc_no,
            CASE WHEN cool AND coalesce(year = 2026, false) THEN '依公告' ELSE amount_text END AS amount_text, ex OR cool OR farm AS manual FROM m""",
    "first_seen_urls": "SELECT url, source_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY first_seen_at NULLS FIRST, last_checked_at NULLS FIRST, source_id NULLS FIRST, verdict NULLS FIRST) AS n FROM crawl_urls) WHERE n = 1",
    "snapshot_upsert": """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_checked_at DESC NULLS LAST, verdict DESC NULLS LAST, content_hash DESC NULLS LAST, fail_count DESC NULLS LAST, subsidy_id DESC NULLS LAST, first_seen_at DESC NULLS LAST) AS n
            FROM crawl_urls WHERE last_checked_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' AND url IS NOT NULL) WHERE n = 1),
        w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_checked_at DESC NULLS LAST, verdict DESC NULLS LAST, content_hash DESC NULLS LAST, subsidy_id DESC NULLS LAST) AS n
            FROM crawl_urls WHERE last_checked_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND url IS NOT NULL) WHERE n = 1)
        SELECT coalesce(w.url, o.url) AS url, CASE WHEN w.url IS NULL THEN o.subsidy_id ELSE coalesce(w.subsidy_id, o.subsidy_id) END AS subsidy_id,
            epoch_us(CASE WHEN o.url IS NULL THEN w.first_seen_at ELSE o.first_seen_at END) AS first_us, epoch_us(CASE WHEN w.url IS NULL THEN o.last_checked_at ELSE w.last_checked_at END) AS last_us
        FROM o FULL OUTER JOIN w ON o.url = w.url""",
    "merged_records": """WITH u AS (SELECT dedupe_key, x, min(struct_pack(f := first_seen_at, i := id, p := p)) AS place FROM (
            SELECT dedupe_key, first_seen_at, id, unnest(source_urls) AS x, unnest(range(len(source_urls))) AS p FROM subsidies WHERE dedupe_key IS NOT NULL) WHERE x IS NOT NULL GROUP BY ALL),
        l AS (SELECT dedupe_key, string_agg(x, ' ' ORDER BY n) AS source_urls FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY place, x) AS n FROM u) WHERE n <= 20 GROUP BY dedupe_key)
        SELECT s.dedupe_key, arg_min(target, struct_pack(f := first_seen_at, i := id)) FILTER (WHERE target IS NOT NULL) AS target,
            arg_min(doc_no, struct_pack(f := first_seen_at, i := id)) FILTER (WHERE doc_no IS NOT NULL) AS doc_no,
            arg_min(amount_text, struct_pack(f := first_seen_at, i := id)) FILTER (WHERE amount_text IS NOT NULL) AS amount_text,
            coalesce(bool_or(until_quota), false) AS until_quota, count(*) AS n_merged, coalesce(any_value(l.source_urls), '') AS source_urls
        FROM subsidies s LEFT JOIN l ON l.dedupe_key = s.dedupe_key WHERE s.dedupe_key IS NOT NULL GROUP BY s.dedupe_key""",
    "unique_keys": "SELECT id, CASE WHEN row_number() OVER (PARTITION BY dedupe_key ORDER BY id) > 1 THEN dedupe_key || '|' || id ELSE dedupe_key END AS dedupe_key FROM subsidies",
    "content_changes": """WITH d AS (SELECT DISTINCT url, last_checked_at, content_hash FROM crawl_urls WHERE last_checked_at IS NOT NULL),
        l AS (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS before FROM d WINDOW w AS (PARTITION BY url ORDER BY last_checked_at, content_hash NULLS FIRST))
        SELECT CASE WHEN n = 1 THEN 'new' WHEN content_hash IS NOT DISTINCT FROM before THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM l GROUP BY 1""",
    "failure_runs": """WITH g AS (SELECT id, NOT coalesce(ok, false) AS bad, sum(CASE WHEN coalesce(ok, false) THEN 1 ELSE 0 END) OVER (ORDER BY id) AS run FROM scan_log)
        SELECT min(id) AS first, max(id) AS last, count(*) AS n FROM g WHERE bad GROUP BY run""",
    "retained_log": "SELECT id, ok FROM scan_log WHERE id > (SELECT max(id) FROM scan_log) - 1000",
    "crawl_worklist": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_checked_at DESC NULLS LAST, verdict DESC NULLS LAST, fail_count DESC NULLS LAST, list_date DESC NULLS LAST) AS n
            FROM crawl_urls WHERE url IS NOT NULL) WHERE n = 1),
        p AS (SELECT url, list_date, CASE WHEN verdict IS NULL OR last_checked_at IS NULL THEN 0
            WHEN verdict = 'error' AND epoch_us(TIMESTAMPTZ '2026-09-15 04:00:00+00') // 1000000 - epoch_us(last_checked_at) // 1000000 >= 7200 AND coalesce(fail_count, 0) < 12 THEN 1
            WHEN verdict = 'subsidy' AND epoch_us(TIMESTAMPTZ '2026-09-15 04:00:00+00') // 1000000 - epoch_us(last_checked_at) // 1000000 >= 21600 THEN 2 END AS priority FROM c)
        SELECT url, priority FROM p WHERE priority IS NOT NULL ORDER BY priority, coalesce(list_date, '') DESC, url LIMIT 150""",
    "source_health": """WITH n AS (SELECT source_id, count(DISTINCT url) AS n_pages, sum(CASE WHEN verdict = 'subsidy' THEN 1 ELSE 0 END) AS n_subsidy,
            sum(CASE WHEN verdict = 'not' THEN 1 ELSE 0 END) AS n_not, sum(CASE WHEN verdict = 'error' THEN 1 ELSE 0 END) AS n_error FROM crawl_urls GROUP BY source_id)
        SELECT s.source_id, s.agency, CAST(coalesce(n_pages, 0) AS BIGINT) AS n_pages, CAST(coalesce(n_subsidy, 0) AS BIGINT) AS n_subsidy, CAST(coalesce(n_not, 0) AS BIGINT) AS n_not,
            CAST(coalesce(n_error, 0) AS BIGINT) AS n_error, coalesce(consecutive_failures, 0) >= 6 OR last_success_at IS NULL AS alarm
        FROM sources_status s LEFT JOIN n ON n.source_id = s.source_id""",
    "unlisted_pages": """SELECT s.id, s.official_url AS url, coalesce(f.source_id, 'known') AS source_id FROM subsidies s
        LEFT JOIN (SELECT agency, min(source_id) AS source_id FROM sources_status GROUP BY agency) f ON f.agency = s.agency
        WHERE s.official_url IS NOT NULL AND s.year >= 2025 AND NOT contains(s.official_url, '#row-') AND NOT EXISTS (SELECT 1 FROM crawl_urls c WHERE c.list_date IS NOT NULL AND c.url = s.official_url)""",
    "page_hosts": """SELECT nullif(lower(regexp_extract(coalesce(url, ''), '^https?://(?:www\\.)?([^/:?#]+)', 1)), '') AS host, count(DISTINCT url) AS n_urls, count(*) AS n_rows FROM crawl_urls GROUP BY 1""",
    "robots_allowed": """WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1)) AS host, regexp_replace(url, '^https?://[^/?#]*', '') AS path FROM crawl_urls WHERE url IS NOT NULL)
        SELECT url, CASE WHEN host NOT IN ('hcm.example', 'ses.example', 'geo.example') THEN true WHEN regexp_full_match(path, '/view\\.do') THEN false WHEN regexp_matches(path, '^/sub/8/') THEN true
            WHEN regexp_matches(path, '^/.*\\?n=6') THEN false WHEN regexp_matches(path, '^/sub/') THEN false ELSE true END AS allowed FROM u""",
    "validated_rows": """SELECT id, concat_ws(',', CASE WHEN NOT coalesce(regexp_full_match(id, '[a-f0-9]{8,32}'), false) THEN 'id' END,
            CASE WHEN NOT coalesce(length(trim(title, ' ')) > 0, false) THEN 'title' END, CASE WHEN NOT coalesce(regexp_matches(official_url, '^https?://'), false) THEN 'official_url' END,
            CASE WHEN NOT regexp_full_match(announce_date, '\\d{4}-\\d{2}-\\d{2}') THEN 'announce_date' END, CASE WHEN NOT regexp_full_match(apply_end, '\\d{4}-\\d{2}-\\d{2}') THEN 'apply_end' END,
            CASE WHEN NOT regexp_full_match(apply_end_time, '([01]\\d|2[0-3]):[0-5]\\d') THEN 'apply_end_time' END, CASE WHEN NOT year BETWEEN 1990 AND 2100 THEN 'year' END,
            CASE WHEN NOT status_flag IN ('quota_full', 'budget_exhausted', 'closed_early', 'closed') THEN 'status_flag' END, CASE WHEN NOT views >= 0 THEN 'views' END) AS errors FROM subsidies""",
    "daily_quota": """WITH n AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) ORDER BY ts, event_id) <= 5 AS admitted FROM events)
        SELECT day, admitted, count(*) AS n FROM n GROUP BY ALL""",
    "relevance_topk": f"""WITH q0 AS (SELECT doc_id AS qid, text AS q FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
        q1 AS (SELECT qid, {_STRIP.format(_EXPAND)} AS t FROM q0), q2 AS (SELECT qid, unnest({_BIG.format("t")}) AS g FROM q1),
        n1 AS (SELECT id, {_STRIP.format("concat_ws(' ', title, summary, target, array_to_string(target_types, ' '), array_to_string(amount_details, ' '))")} AS t FROM subsidies),
        n2 AS (SELECT id, unnest({_BIG.format("t")}) AS g FROM n1),
        s AS (SELECT qid, id, count(*) AS score FROM q2 JOIN n2 USING (g) GROUP BY qid, id HAVING count(*) >= 3)
        SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 6""",
    "number_provenance": f"""SELECT id, len(list_filter({_NUMS.format("summary")}, lambda x: NOT list_contains({_NUMS.format("content")}, x))) = 0 AS supported
        FROM subsidies WHERE summary IS NOT NULL AND content IS NOT NULL""",
    "url_allowlist": "SELECT id, '請見 ' || official_url || '。另見 （網址請見詳細資訊）.' AS answer FROM subsidies WHERE official_url IS NOT NULL",
    "agency_context": """WITH n AS (SELECT agency, id, concat_ws(' | ', 'title: ' || title, 'year: ' || year, 'apply_end: ' || apply_end) AS l,
            (row_number() OVER (PARTITION BY agency ORDER BY id) - 1) // 2000 AS chunk FROM subsidies WHERE agency IS NOT NULL)
        SELECT agency, CAST(chunk AS INTEGER) AS chunk, string_agg(l, chr(10) ORDER BY id) AS context FROM n GROUP BY agency, chunk""",
    "stream_daily_counts": "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "display_titles": _DISPLAY,
    "log_stats": """SELECT id, CAST(CASE WHEN json_valid(stats) THEN CASE WHEN json_type(stats) = 'OBJECT' THEN len(json_keys(stats)) ELSE 0 END ELSE 0 END AS INTEGER) AS n_keys,
        CAST(coalesce(len(errors), 0) AS INTEGER) AS n_errors FROM scan_log""",
    "normalized_names": _NAMES,
}

_WRONG = "(SELECT DISTINCT url AS target FROM crawl_urls WHERE verdict = 'not' AND url IS NOT NULL)"
_LISTED = f"""l AS (SELECT s.* FROM subsidies s WHERE NOT coalesce(hidden, false)
    AND (coalesce(year BETWEEN 2025 AND 2027, false) OR id IN {_WRONG} OR coalesce(official_url IN {_WRONG}, false)))"""
_TODAY = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OLD_CATEGORIES.items()) + " ELSE x END"
_CATEGORIES = f"list_filter({list(CATEGORIES)}, lambda c: list_contains(list_transform(coalesce(target_types, []), lambda x: {_TODAY}), c))"
_CHOICE = f"""WITH {_STATUS}, top AS (SELECT agency FROM subsidies WHERE agency IS NOT NULL GROUP BY agency ORDER BY count(*) DESC, agency LIMIT 1)"""
_HOT = "coalesce(status = 'open' AND left_d BETWEEN 0 AND 7, false)"
_TAG_TEXT = _PLAIN.format("title")
_POINT_MARK = "(?:[（(][一二三四五六七八九十]+[）)]|[1-9][.、]|第[一二三四五六七八九十]+類)"

ORACLES |= {
    "year_list": f"""WITH {_LISTED}, v AS (SELECT *, program_name IS NOT NULL AS ongoing, CASE WHEN coalesce(apply_end, '') <> '' THEN apply_end >= '2026-01-01' ELSE coalesce(until_quota, false) END AS runs_on FROM l)
        SELECT id, agency, year, official_url, views, ongoing, (year IS DISTINCT FROM 2026) AND NOT ongoing AS carried_over FROM v
        WHERE coalesce(year = 2026, false) OR coalesce(year = 2025 AND coalesce(status_flag, '') = '' AND runs_on, false) OR (ongoing AND (coalesce(apply_end, '') = '' OR apply_end >= '2026-01-01'))""",
    "listed_candidates": f"WITH {_LISTED} SELECT id, year FROM l",
    "notice_detail": """SELECT id, title, agency, year, official_url, target, doc_no FROM subsidies
        WHERE id = (SELECT min(id) FROM subsidies WHERE NOT coalesce(hidden, false)) AND NOT coalesce(hidden, false)""",
    "source_errors": """SELECT '{' || coalesce(string_agg('"' || source_id || '":"' || agency || '"', ',' ORDER BY source_id), '') || '}' AS json
        FROM sources_status WHERE source_id IN ('erm', 'ses', 'geo', 'nobody')""",
    "status_facet_chosen": _CHOICE + f" SELECT coalesce(status, '') AS status, count(*) AS n FROM t WHERE agency = (SELECT agency FROM top) AND list_contains({_CATEGORIES}, '工業') GROUP BY ROLLUP (status)",
    "list_totals": _CHOICE + f""" SELECT count(*) AS n_all, count_if(status = 'open') AS n_open, count_if({_HOT}) AS n_hot,
        count_if(status = 'open' AND coalesce(agency = (SELECT agency FROM top), false) AND list_contains({_CATEGORIES}, '工業')) AS n_chosen FROM t""",
    "categories": f"SELECT id, array_to_string({_CATEGORIES}, '|') AS categories FROM subsidies",
    "title_tags": f"""WITH a AS (SELECT id, {_TAG_TEXT} AS t, coalesce(title, '') AS raw, coalesce(period_text, '') AS p FROM subsidies),
        b AS (SELECT id, regexp_extract(t, '(?:^|[^\\d])(\\d{{3}})\\s*(?:年度|年)', 1) AS y, regexp_extract(raw, '第\\s*([一二三四五六七八九十\\d]+)\\s*(?:梯次|梯|次|期)', 1) AS o,
            regexp_extract(p, '^第\\s*([一二三四五六七八九十\\d]+)\\s*梯次?', 1) AS q FROM a),
        c AS (SELECT id, y, CASE WHEN o <> '' THEN o ELSE q END AS n FROM b),
        d AS (SELECT id, y, CASE WHEN regexp_full_match(n, '\\d+') AND CAST(n AS BIGINT) BETWEEN 1 AND 10 THEN substr('一二三四五六七八九十', CAST(n AS BIGINT), 1) ELSE n END AS n FROM c)
        SELECT id, concat_ws('|', CASE WHEN y <> '' THEN y || '年度' END, CASE WHEN n <> '' THEN '第' || n || '梯次' END) AS tags FROM d""",
    "short_periods": "SELECT id, regexp_replace(period, '(2\\d{3})/(\\d{2}/\\d{2}) ～ (2\\d{3})/(\\d{2}/\\d{2})', CASE WHEN regexp_extract(period, '(2\\d{3})/\\d{2}/\\d{2} ～ (2\\d{3})', 1) = regexp_extract(period, '(2\\d{3})/\\d{2}/\\d{2} ～ (2\\d{3})', 2) THEN '\\1/\\2 ～ \\4' ELSE '\\0' END) AS period FROM (" + ORACLES["period_texts"] + ")",
    "amounts_in_words": """WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 10000 ELSE 1 END AS n FROM orders),
        b AS (SELECT o_orderkey, CASE WHEN n >= 100000000 AND n % 1000000 = 0 THEN n / 1e8 WHEN n >= 10000 AND n % 100 = 0 THEN n / 1e4 ELSE n END AS x,
            CASE WHEN n >= 100000000 AND n % 1000000 = 0 THEN ' 億元' WHEN n >= 10000 AND n % 100 = 0 THEN ' 萬元' ELSE ' 元' END AS unit FROM a)
        SELECT o_orderkey, '新臺幣 ' || regexp_replace(format('{:,.2f}', x), '\\.?0*$', '') || unit AS words FROM b""",
    "candidate_union": """WITH dead AS (SELECT DISTINCT url FROM crawl_urls WHERE verdict = 'error'), f AS (SELECT agency, min(source_id) AS source_id FROM sources_status GROUP BY agency),
        u AS (SELECT min(official_url) AS url, program_name AS title, CAST(NULL AS VARCHAR) AS list_date, 'program' AS source_id, 0 AS r, 'programme' AS kind FROM subsidies WHERE program_name IS NOT NULL AND official_url IS NOT NULL GROUP BY program_name
            UNION ALL SELECT url, title, list_date, source_id, 1, 'list' FROM crawl_urls WHERE list_date IS NOT NULL AND list_date >= '2025-01-01' AND url NOT IN (SELECT url FROM dead WHERE url IS NOT NULL)
            UNION ALL SELECT s.official_url, s.title, s.announce_date, coalesce(f.source_id, 'known'), 2, 'known' FROM subsidies s LEFT JOIN f ON f.agency = s.agency WHERE s.year >= 2025 AND s.official_url IS NOT NULL)
        SELECT url, title, list_date, source_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY r, source_id NULLS FIRST, list_date NULLS FIRST, title NULLS FIRST) AS n FROM u WHERE url IS NOT NULL) WHERE n = 1""",
    "document_years": f"""WITH a AS (SELECT id, nullif(regexp_extract(announce_date, '^(\\d{{4}})', 1), '') AS y, try_cast(nullif(regexp_extract({_TAG_TEXT}, '(?:^|[^\\d])(\\d{{2,3}})\\s*年度', 1), '') AS INTEGER) AS t FROM subsidies)
        SELECT id, coalesce(CAST(y AS INTEGER), CASE WHEN t BETWEEN 70 AND 200 THEN t + 1911 END) AS doc_year FROM a""",
    "picked_titles": """WITH a AS (SELECT id, trim(coalesce(title, ''), ' ') AS t, string_split(coalesce(content, ''), chr(10)) AS lines, program_name AS h FROM subsidies),
        b AS (SELECT *, regexp_matches(t, '(\\.\\.\\.|…)$') AS cut, substr(regexp_replace(t, '(\\.\\.\\.|…)$', ''), 1, 12) AS head FROM a),
        c AS (SELECT *, CASE WHEN head <> '' THEN list_filter(lines, lambda x: starts_with(x, head) AND length(x) > length(t))[1] END AS line FROM b)
        SELECT id, coalesce(CASE WHEN cut OR length(t) < 8 THEN coalesce(substr(line, 1, 200), CASE WHEN length(h) > length(t) THEN h END) END, nullif(t, ''), nullif(h, '')) AS title FROM c""",
    "redirect_ends": """WITH l AS (SELECT c.url, min(s.official_url) AS t FROM crawl_urls c JOIN subsidies s ON s.id = c.subsidy_id WHERE c.url IS NOT NULL AND s.official_url IS NOT NULL AND s.official_url <> c.url GROUP BY c.url),
        u AS (SELECT DISTINCT url FROM crawl_urls WHERE url IS NOT NULL)
        SELECT u.url, coalesce(b.t, a.t, u.url) AS final_url, CAST((a.t IS NOT NULL)::INT + (b.t IS NOT NULL)::INT AS INTEGER) AS hops FROM u LEFT JOIN l a ON a.url = u.url LEFT JOIN l b ON b.url = a.t""",
    "run_statistics": """SELECT count(*) AS n_pages, count_if(verdict = 'subsidy') AS n_subsidy, count_if(verdict = 'not') AS n_not, count_if(verdict = 'error') AS n_error,
        count(DISTINCT source_id) AS n_sources, count_if(coalesce(fail_count, 0) >= 3) AS n_failing FROM crawl_urls""",
    "drift_alarms": """WITH p AS (SELECT program_name AS programme, min(official_url) AS url FROM subsidies WHERE program_name IS NOT NULL AND official_url IS NOT NULL GROUP BY program_name),
        m AS (SELECT DISTINCT id, year, apply_end, unnest(list_append(coalesce(source_urls, []), official_url)) AS url FROM subsidies),
        w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS n FROM m WHERE url IS NOT NULL) WHERE n = 1),
        f AS (SELECT url, max(fail_count) AS fails FROM crawl_urls GROUP BY url),
        r AS (SELECT p.programme, p.url, concat_ws(',', CASE WHEN f.fails >= 3 THEN 'unreadable' END, CASE WHEN w.year < 2026 THEN 'old_year' END, CASE WHEN w.apply_end <> '' AND w.apply_end < '2026-09-15' THEN 'ended' END) AS warnings
            FROM p LEFT JOIN f ON f.url = p.url LEFT JOIN w ON w.url = p.url)
        SELECT * FROM r WHERE warnings <> ''""",
    "withdrawn_notices": f"""WITH w AS {_WRONG} SELECT s.id, coalesce(s.hidden, false) OR w.target IS NOT NULL AS hidden, w.target IS NOT NULL AND NOT coalesce(s.hidden, false) AS changed
        FROM subsidies s LEFT JOIN w ON w.target = s.official_url""",
    "link_states": """WITH c AS (SELECT url, bool_or(coalesce(reason IS NOT NULL AND coalesce(verdict, '') = 'error' AND fail_count >= 3, false)) AS dead, bool_or(coalesce(verdict, '') <> 'error') AS ok FROM crawl_urls WHERE url IS NOT NULL GROUP BY url)
        SELECT s.id, CASE WHEN c.dead THEN 'dead' WHEN c.ok THEN 'ok' ELSE s.link_status END AS link_status FROM subsidies s LEFT JOIN c ON c.url = s.official_url""",
    "replaced_table": "SELECT url, epoch_us(max(last_checked_at)) AS at_us FROM crawl_urls WHERE verdict = 'error' AND url IS NOT NULL GROUP BY url",
    "first_dates": f"""WITH a AS (SELECT id, regexp_extract_all({_PLAIN.format("content")}, '(\\d{{2,4}})\\s*年\\s*(\\d{{1,2}})\\s*月\\s*(\\d{{1,2}})\\s*日') AS m FROM subsidies),
        b AS (SELECT id, list_transform(m, lambda x: regexp_extract(x, '(\\d{{2,4}})\\s*年\\s*(\\d{{1,2}})\\s*月\\s*(\\d{{1,2}})\\s*日', ['y', 'm', 'd'])) AS m FROM a),
        c AS (SELECT id, list_transform(m, lambda x: struct_pack(y := CASE WHEN length(x.y) = 4 THEN CAST(x.y AS INTEGER) WHEN CAST(x.y AS INTEGER) BETWEEN 70 AND 200 THEN CAST(x.y AS INTEGER) + 1911 END, m := x.m, d := x.d)) AS m FROM b),
        e AS (SELECT id, list_transform(list_filter(m, lambda x: coalesce(x.y BETWEEN 1990 AND 2100, false)), lambda x: x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0')) AS m FROM c)
        SELECT id, list_filter(m, lambda x: try_cast(x AS DATE) IS NOT NULL)[1] AS first_date FROM e""",
    "similar_names": "WITH k AS (" + _NAMES.replace("SELECT id, name, batch, key, substr(sha1(key), 1, 12) AS key_id FROM d", "SELECT DISTINCT agency, name FROM d WHERE agency <> '' AND name <> ''") + """),
        n AS (SELECT agency || '|' || name AS node, agency, name FROM k WHERE length(name) >= 2),
        g AS (SELECT node, agency, name, g, count(*) AS c FROM (SELECT node, agency, name, unnest(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) AS g FROM n) GROUP BY ALL),
        p AS (SELECT a.node AS a, b.node AS b, a.name AS na, b.name AS nb, sum(least(a.c, b.c)) AS shared FROM g a JOIN g b ON a.g = b.g AND a.node < b.node AND (starts_with(a.agency, b.agency) OR starts_with(b.agency, a.agency)) GROUP BY ALL),
        s AS (SELECT a, b, CASE WHEN na = nb THEN 1.0 ELSE greatest(CAST(2 * shared AS DOUBLE) / greatest(1, length(na) + length(nb) - 2),
            CASE WHEN least(length(na), length(nb)) >= 6 AND (contains(na, nb) OR contains(nb, na)) THEN 0.85 ELSE 0 END) END AS score FROM p)
        SELECT a, b, round(score, 9) AS score FROM s WHERE score >= 0.72""",
    "match_exact": f"""WITH t AS (SELECT url, min(title) AS title FROM crawl_urls WHERE url IS NOT NULL AND verdict = 'subsidy' GROUP BY url),
        u AS (SELECT url AS who, true AS page, title, CAST(NULL AS VARCHAR) AS official_url, CAST(NULL AS INTEGER) AS year FROM t UNION ALL SELECT id, false, title, official_url, year FROM subsidies),
        v AS (SELECT *, {_PLAIN.format("title")} AS raw FROM u), w AS (SELECT *, CASE WHEN {_Q.format("raw")} <> '' THEN {_Q.format("raw")} ELSE raw END AS s FROM v),
        n AS (SELECT who, page, official_url, year, nullif(lower({_NAME_STEPS}), '') AS key FROM w),
        h AS (SELECT p.who AS doc, 1 AS tier, k.who AS id FROM n p JOIN n k ON p.page AND NOT k.page AND k.year = 2026 AND k.official_url = p.who
            UNION ALL SELECT p.who, 2, k.who FROM n p JOIN n k ON p.page AND NOT k.page AND k.key = p.key),
        b AS (SELECT doc, min(struct_pack(tier := tier, id := id)) AS m FROM h GROUP BY doc)
        SELECT n.who AS doc, b.m.id AS match, b.m.tier AS tier FROM n LEFT JOIN b ON b.doc = n.who WHERE n.page""",
    "row_documents": """SELECT id, t AS title, announce_date AS date, CAST(length(announce_date) + 1 + length(t) AS INTEGER) AS n_text FROM (SELECT id, announce_date, trim(regexp_replace(title, '[ \\t\\x{00A0}\\x{3000}]+', ' ', 'g'), ' ') AS t FROM subsidies
        WHERE title IS NOT NULL AND regexp_full_match(announce_date, '\\d{4}-\\d{2}-\\d{2}')) WHERE length(t) >= 8 AND NOT regexp_full_match(t, '[\\d\\s./-]+') AND try_cast(announce_date AS DATE) IS NOT NULL AND year(try_cast(announce_date AS DATE)) BETWEEN 1990 AND 2100""",
    "challenged_pages": """SELECT doc_id, regexp_matches(substr(text, 1, 3000), '(?i)_Incapsula_Resource|cf-browser-verification|challenge-platform|Request unsuccessful\\. Incapsula') AS challenge,
        octet_length(encode(text)) <= 5242880 AS fits, CAST(NULL AS VARCHAR) AS leads_to FROM documents WHERE text IS NOT NULL""",
    "page_files": """WITH a AS (SELECT id, unnest(attachments) AS a FROM subsidies) SELECT DISTINCT id, a.url AS url, trim(regexp_replace(a.label, '[ \\t\\x{00A0}\\x{3000}]+', ' ', 'g'), ' ') AS label FROM a
        WHERE regexp_matches(a.url, '(?i)\\.(pdf|odt|docx|doc|ods|xlsx|zip)(\\?|$)|download|file_?id|getfile|attach|wHandNews_File') OR regexp_matches(a.label, '(?i)\\.(pdf|odt|docx)\\b')""",
    "list_page_links": """WITH r AS (SELECT source_id, url, max(title) AS t, max(list_date) AS ld FROM crawl_urls WHERE url IS NOT NULL AND title IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL),
        c AS (SELECT url, trim(regexp_replace(regexp_replace(t, '[ \\t\\x{00A0}\\x{3000}]+', ' ', 'g'), '[(（]?(另開新視窗|開新視窗|新視窗開啟)[)）]?', '', 'g'), ' ') AS t, CASE WHEN regexp_full_match(ld, '\\d{4}-\\d{2}-\\d{2}') THEN CAST(try_cast(ld AS DATE) AS VARCHAR) END AS d FROM r)
        SELECT url, arg_max(t, struct_pack(n := length(t), t := t)) AS title, max(d) AS date FROM c WHERE length(t) BETWEEN 6 AND 200 GROUP BY url""",
    "agency_order": "SELECT DISTINCT agency FROM subsidies WHERE agency <> ''",
}
