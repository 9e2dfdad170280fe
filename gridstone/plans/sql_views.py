"""Portable SQL for the derived views (FIXTURES.md §3), used by the DuckDB oracle.

Only SQL that DuckDB and Spark read alike is used: ``chr(92)`` for a backslash,
``CAST(.. AS STRING)``, explicit DOUBLE casts.  The Spark side builds the same
views with DataFrame code (``gridstone.sources.views``), so the oracle is an
independent statement of the same data.
"""

from __future__ import annotations

SAMPLES_SQL = """
SELECT doc_id, concat('doc_', CAST(doc_id AS STRING)) AS sample_id,
  CASE doc_id % 4 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'math' WHEN 2 THEN 'humaneval' ELSE 'custom' END AS task_type,
  CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split,
  concat(text, CASE doc_id % 4
    WHEN 0 THEN concat(' Add ', CAST(doc_id % 97 AS STRING), ' and ', CAST(doc_id % 13 AS STRING), '. How many in total?')
    WHEN 1 THEN concat(' Solve x^2 - ', CAST(doc_id % 9 AS STRING), '*x + ', CAST(doc_id % 7 AS STRING), ' = 0.')
    WHEN 2 THEN ' def solve(xs): return the sum; assert solve([1, 2]) == 3' ELSE '' END) AS query,
  CASE WHEN doc_id % 4 = 2 THEN 'pass' ELSE CAST(doc_id % 97 + doc_id % 13 AS STRING) END AS expected_answer, n_chars
FROM documents
"""

GRID_SQL = """
WITH m AS (SELECT * FROM (VALUES (0,'m-cheap','cheap',0.0003), (1,'m-mid','mid',0.0012), (2,'m-strong','strong',0.0040)) AS t(mi, model_id, tier, cost_per_1k)),
b AS (SELECT * FROM (VALUES (0,0), (1,256), (2,1024)) AS t(bi, budget)),
x AS (SELECT s.*, m.*, b.*, (s.doc_id * 31 + m.mi * 17 + b.bi * 7) % 100 AS h, (s.doc_id * 13 + m.mi * 29 + b.bi * 11) % 8 AS tpl,
  s.doc_id % 97 + s.doc_id % 13 + CASE WHEN (s.doc_id * 31 + m.mi * 17 + b.bi * 7) % 3 = 0 THEN 1 ELSE 0 END AS a
  FROM samples s CROSS JOIN m CROSS JOIN b)
SELECT doc_id * 9 + mi * 3 + bi AS id, sample_id, query, task_type, split, expected_answer,
  model_id AS selected_model, tier AS selected_model_tier, budget AS selected_budget,
  (h < 45 + 15 * mi + 5 * bi) AS is_correct,
  CASE WHEN h >= 97 THEN 'APIConnectionError' WHEN h >= 90 THEN 'parse_error'
       WHEN h < 45 + 15 * mi + 5 * bi THEN NULL ELSE 'wrong_answer' END AS error_type,
  CASE WHEN h >= 97 THEN 0 ELSE CAST(n_chars % 500 AS BIGINT) + 50 + bi * 64 END AS total_tokens,
  CASE WHEN h >= 97 THEN CAST(0 AS DOUBLE)
       ELSE (CAST(n_chars % 500 AS BIGINT) + 50 + bi * 64) / CAST(1000 AS DOUBLE) * CAST(cost_per_1k AS DOUBLE) END AS cost_usd,
  CASE WHEN h >= 97 THEN CAST(0 AS DOUBLE)
       ELSE ((h * 37) % 500) / CAST(100 AS DOUBLE) + bi * CAST(2 AS DOUBLE) END AS latency_s,
  CASE WHEN h >= 97 THEN '' ELSE CASE tpl
    WHEN 0 THEN concat('Final answer: ', CAST(a AS STRING))
    WHEN 1 THEN concat('**Answer:**', chr(10), 'It takes **', CAST(a AS STRING), ' minutes** (or 2 hours).')
    WHEN 2 THEN concat('We get ', chr(92), 'boxed{', chr(92), 'frac{', CAST(2 * a AS STRING), '}{2}}.')
    WHEN 3 THEN concat('Step 1 gives 5. So the total is ', CAST(a AS STRING), '.00')
    WHEN 4 THEN concat('So #### 1,', lpad(CAST(a AS STRING), 3, '0'))
    WHEN 5 THEN 'I cannot solve this.'
    WHEN 6 THEN concat('After solving,', chr(10), 'x = ', CAST(a AS STRING))
    ELSE concat('```python', chr(10), 'def solve(xs):', chr(10), '    return sum(xs)', chr(10), '```') END END AS output_text
FROM x
"""

TRACE_LOG_SQL = """
SELECT event_id AS id, concat('user_', CAST(user_id AS STRING)) AS sample_id, event_type AS task_type, ts AS created_at,
  CASE event_id % 3 WHEN 0 THEN 'm-cheap' WHEN 1 THEN 'm-mid' ELSE 'm-strong' END AS selected_model,
  CASE CAST(FLOOR(event_id / 3) AS BIGINT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 256 ELSE 1024 END AS selected_budget,
  value AS latency_s, value / CAST(1000 AS DOUBLE) AS cost_usd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens,
  (event_type <> 'error' AND event_id % 7 <> 0) AS is_correct
FROM events
"""

BASE_VIEWS = {"samples": SAMPLES_SQL, "grid": GRID_SQL, "trace_log": TRACE_LOG_SQL}
# Text layers that several parts of an oracle read: computed once.
COSTLY = ("graded", "fin", "fbase", "classified", "thr", "prim", "scores", "devsel", "devdec", "devbest", "picked", "testsel", "testdec", "saferows", "mb", "integ")
_DEPENDS = {"grid": ["samples"], "samples": [], "trace_log": []}


def with_views(body: str, *ctes: tuple[str, str]) -> str:
    """Prefix ``body`` with the base views it mentions plus extra named CTEs."""
    text = body + " ".join(sql for _, sql in ctes)
    needed: list[str] = []

    def need(name: str) -> None:
        for dep in _DEPENDS[name]:
            need(dep)
        if name not in needed:
            needed.append(name)

    for name in ("samples", "grid", "trace_log"):
        if _mentions(text, name):
            need(name)
    parts = [f"{name} AS ({BASE_VIEWS[name]})" for name in needed]
    parts += [f"{name} AS {'MATERIALIZED ' if name in COSTLY else ''}({sql})" for name, sql in ctes]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, flags=re.IGNORECASE) is not None
