"""SQL text of the stand-in tables, for the DuckDB oracle.

The oracle is written independently of the DataFrame code: plain SQL over
the driver's tables that any engine can run.  ``with_ctes`` prefixes a
query with the common table expressions it names.
"""

from __future__ import annotations

from reelsight.functions.lookups import OCCUPATION_NAMES, UNKNOWN_OCCUPATION

TITLE = """CASE WHEN p_partkey % 50 = 0 THEN 'special ' || CAST(p_partkey // 100 AS VARCHAR)
       ELSE p_name || ' ' || CAST(p_partkey AS VARCHAR) END"""

RATING = """1 + CAST(FLOOR(((l.l_quantity - 1) * 4 + (l.l_partkey % 10) * 20 + (o.o_custkey % 2) * 64
                        + (o.o_custkey % 5) * 12) / 98) AS INT)"""

RATINGS = f"""
SELECT
  o.o_custkey                                           AS UserID,
  l.l_partkey                                           AS MovieID,
  {RATING}                                              AS UserRating,
  l.l_shipdate                                          AS date_time,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'M' ELSE 'F' END   AS Gender,
  CAST(c.c_nationkey % 21 AS INT)                       AS Occupation,
  CASE WHEN c.c_acctbal < 0 THEN 1 WHEN c.c_acctbal < 1500 THEN 18
       WHEN c.c_acctbal < 3500 THEN 25 WHEN c.c_acctbal < 5500 THEN 35
       WHEN c.c_acctbal < 7000 THEN 45 WHEN c.c_acctbal < 8500 THEN 50
       ELSE 56 END                                      AS Age,
  CONCAT(LPAD(CAST(c.c_custkey % 40 AS VARCHAR), 3, '0'), '00') AS Zip_Code,
  {TITLE}                                               AS Title,
  REPLACE(p.p_name, ' ', '|')                           AS Genres,
  p.p_brand                                             AS directedBy,
  p.p_type                                              AS starring,
  CASE WHEN p.p_partkey % 17 = 0 THEN 'N/A'
       ELSE CONCAT(CAST(p.p_partkey % 10 AS VARCHAR), '.5') END AS rating_imdb,
  CASE WHEN p.p_partkey % 23 = 0 THEN '90, 100'
       WHEN p.p_partkey % 29 = 0 THEN NULL
       ELSE CAST(60 + p.p_size AS VARCHAR) END           AS runtimes,
  CASE WHEN p.p_partkey % 31 = 0 THEN NULL ELSE d.text END AS plot_outline
FROM lineitem l
JOIN orders   o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey  = c.c_custkey
JOIN part     p ON l.l_partkey  = p.p_partkey
LEFT JOIN documents d ON d.doc_id = p.p_partkey % (SELECT count(*) FROM documents)
"""


def _occupation_case(col: str) -> str:
    arms = " ".join(f"WHEN {code} THEN '{name}'" for code, name in sorted(OCCUPATION_NAMES.items()))
    return f"CASE {col} {arms} ELSE '{UNKNOWN_OCCUPATION}' END"


def safe_int_sql(expr: str) -> str:
    """Truncating text-to-int, NULL on bad text (the DuckDB twin of ``safe_int``)."""
    return f"TRY_CAST(TRUNC(TRY_CAST(TRIM(CAST({expr} AS VARCHAR)) AS DOUBLE)) AS INTEGER)"


def sentinel_sql(expr: str) -> str:
    return f"CASE WHEN TRIM({expr}) IN ('N/A', '', '0.0') THEN NULL ELSE {expr} END"


CLEAN = f"""
SELECT UserID, MovieID, {safe_int_sql('UserRating')} AS UserRating, date_time, Gender, Occupation, Age,
       Zip_Code, Title, Genres, directedBy, starring,
       {safe_int_sql(sentinel_sql('rating_imdb'))} AS rating_imdb,
       {safe_int_sql("split_part(" + sentinel_sql('runtimes') + ", ',', 1)")} AS runtimes,
       plot_outline,
       {_occupation_case('Occupation')} AS Occupation_Name
FROM ratings
WHERE UserID IS NOT NULL AND MovieID IS NOT NULL AND UserRating IS NOT NULL
"""

# Requests: one per event (see plans.standin.requests).
REQUESTS = """
SELECT e.event_id AS RequestID,
       CASE WHEN e.event_id % 10 = 0 THEN -1 - e.user_id ELSE e.user_id END AS UserID,
       e.event_id % ((SELECT count(*) FROM part) + (SELECT count(*) FROM part) // 2) AS MovieID
FROM events e
"""

# Train side of the key-hash split (see operators.sampling).
SPLIT = """
SELECT *, (CAST(('0x' || substr(md5(concat_ws(':', CAST(UserID AS VARCHAR), CAST(MovieID AS VARCHAR))), 1, 8))
           AS BIGINT)) < 0.8 * 4294967296 AS is_train
FROM clean
"""

CTES = {
    "ratings": RATINGS,
    "clean": CLEAN,
    "requests": REQUESTS,
    "split": SPLIT,
}

# Which CTEs each CTE needs, in order.
_NEEDS = {"ratings": [], "clean": ["ratings"], "requests": [], "split": ["ratings", "clean"]}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <needed ctes> <body>``; ``extra`` adds query-local CTEs after the common ones."""
    order: list[str] = []
    for n in names:
        for dep in _NEEDS[n] + [n]:
            if dep not in order:
                order.append(dep)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    for n, text in (extra or {}).items():
        parts.append(f"{n} AS ({text})")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
