"""DuckDB SQL for the queries of the llm operators that SQL can express."""

P2_GROUPS = """
WITH RECURSIVE up(job_id, cur, depth) AS (
    SELECT job_id, job_id, 0 FROM jobs
    UNION ALL
    SELECT u.job_id, j.duplicate_of, u.depth + 1 FROM up u JOIN jobs j ON j.job_id = u.cur WHERE j.duplicate_of IS NOT NULL
),
member AS (SELECT job_id, arg_max(cur, depth) AS group_job_id FROM up GROUP BY job_id),
big AS (SELECT group_job_id FROM member GROUP BY group_job_id HAVING count(*) > 1),
m AS (SELECT group_job_id, j.* FROM member JOIN big USING (group_job_id) JOIN jobs j USING (job_id)),
"""

ORACLE = {
    "p2_found": P2_GROUPS
    + """
pay AS (SELECT group_job_id, job_id, row_number() OVER (PARTITION BY group_job_id ORDER BY CASE WHEN salary_source = 'source_field' THEN 0 ELSE 1 END, fetched_at DESC, salary_min_cad::VARCHAR DESC, job_id DESC) AS k
        FROM m WHERE salary_min_cad BETWEEN 15000 AND 1000000),
size AS (SELECT group_job_id, job_id, row_number() OVER (PARTITION BY group_job_id ORDER BY fetched_at DESC, company_size_bucket DESC, job_id DESC) AS k
         FROM m WHERE company_size_bucket IN ('micro', 'small', 'medium', 'large'))
SELECT b.group_job_id, p.job_id AS salary_job_id, s.job_id AS bucket_job_id
FROM big b LEFT JOIN pay p ON p.group_job_id = b.group_job_id AND p.k = 1 LEFT JOIN size s ON s.group_job_id = b.group_job_id AND s.k = 1
""",
    "p2_survivors": P2_GROUPS
    + """
pay AS (SELECT group_job_id, salary_min_cad, row_number() OVER (PARTITION BY group_job_id ORDER BY sum(pow(2, (CASE WHEN salary_source = 'source_field' THEN 2 ELSE 0 END) + (epoch_ms(fetched_at) - 1740000000000) / 7776000000.0)) DESC, salary_min_cad::VARCHAR DESC) AS k
        FROM m WHERE salary_min_cad BETWEEN 15000 AND 1000000 GROUP BY group_job_id, salary_min_cad),
size AS (SELECT group_job_id, company_size_bucket, row_number() OVER (PARTITION BY group_job_id ORDER BY sum(pow(2, (epoch_ms(fetched_at) - 1740000000000) / 7776000000.0)) DESC, company_size_bucket DESC) AS k
         FROM m WHERE company_size_bucket IN ('micro', 'small', 'medium', 'large') GROUP BY group_job_id, company_size_bucket)
SELECT b.group_job_id, p.salary_min_cad::INTEGER AS salary_min_cad, s.company_size_bucket
FROM big b LEFT JOIN pay p ON p.group_job_id = b.group_job_id AND p.k = 1 LEFT JOIN size s ON s.group_job_id = b.group_job_id AND s.k = 1
""",
}


ORACLE["p4_found"] = r"""
WITH w AS (SELECT job_id, list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[\p{L}\p{N}]+')) AS words FROM jobs),
u AS (SELECT job_id, len(words) AS n, unnest(words) AS word FROM w)
SELECT a.job_id AS job_id_a, b.job_id AS job_id_b FROM u a JOIN u b ON a.word = b.word AND a.job_id < b.job_id
GROUP BY a.job_id, b.job_id, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)
"""

RUNS = r"""SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 11), ' ') AS run
FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table}))"""
ORACLE["p8_found"] = f"SELECT DISTINCT d.doc_id, e.item_id FROM ({RUNS.format(key='doc_id', text='text', table='documents')}) d JOIN ({RUNS.format(key='item_id', text='passage', table='eval_items')}) e USING (run)"


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return dict(ORACLE)
