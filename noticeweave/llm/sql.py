"""ANSI SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_LINES = """
WITH r AS (SELECT id, agency, string_split(content, chr(10)) AS s FROM subsidies WHERE content IS NOT NULL AND agency IS NOT NULL),
l AS (SELECT id, agency, unnest(range(len(s))) AS line_no, unnest(s) AS raw FROM r),
n AS (SELECT id, agency, line_no, trim(regexp_replace(raw, '[ \\t]+', ' ', 'g'), ' ') AS line FROM l),
t AS (SELECT agency, count(*) AS n_all FROM r GROUP BY agency),
x AS (
    SELECT n.agency, n.line, count(DISTINCT n.id) AS n_docs, t.n_all FROM n JOIN t ON n.agency = t.agency
    WHERE n.line <> '' GROUP BY n.agency, n.line, t.n_all
    HAVING count(DISTINCT n.id) >= 6 AND count(DISTINCT n.id) >= 0.05 * t.n_all
)
"""

_SQL = {
    "p5_found": _LINES + "SELECT DISTINCT n.id, CAST(n.line_no AS INTEGER) AS line_no FROM n JOIN x ON n.agency = x.agency AND n.line = x.line",
    "p5_lines": _LINES + "SELECT agency, line, n_docs, n_all, round(n_docs / n_all, 6) AS share FROM x",
    "p5_contents": _LINES
    + """, d AS (SELECT n.id, list(n.line_no) AS drops FROM n JOIN x ON n.agency = x.agency AND n.line = x.line GROUP BY n.id),
    k AS (
        SELECT l.id, string_agg(l.raw, chr(10) ORDER BY l.line_no) AS content FROM l JOIN d ON l.id = d.id
        WHERE NOT list_contains(d.drops, l.line_no) GROUP BY l.id
    )
    SELECT s.id, CASE WHEN d.id IS NULL THEN s.content ELSE coalesce(k.content, '') END AS content,
           CAST(coalesce(len(d.drops), 0) AS INTEGER) AS n_removed
    FROM subsidies s LEFT JOIN d ON s.id = d.id LEFT JOIN k ON s.id = k.id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
