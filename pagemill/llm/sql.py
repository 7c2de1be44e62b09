"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
WITH g AS (
  SELECT sha256(text) AS d, doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2
), w AS (SELECT d, min(doc_id) AS kept_doc_id FROM g GROUP BY d)
SELECT g.doc_id, w.kept_doc_id, CAST(g.n - CASE WHEN g.doc_id IS NOT DISTINCT FROM w.kept_doc_id THEN 1 ELSE 0 END AS BIGINT) AS n_rows
FROM g JOIN w ON g.d = w.d
WHERE g.n - CASE WHEN g.doc_id IS NOT DISTINCT FROM w.kept_doc_id THEN 1 ELSE 0 END > 0
"""

OP10 = "SELECT page_id, url, html FROM pages"


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op10_warc_zip": OP10}
