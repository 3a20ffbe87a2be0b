"""The test views of `testviews.py` in DuckDB SQL, for the oracle queries.

Each entry is a CTE body; `with_views(body, *names)` prepends the named CTEs
and everything they depend on, in order.
"""

from __future__ import annotations

AS_OF = "DATE '2000-06-15'"
REPORT_START = "DATE '2000-06-01'"
REPORT_END = "DATE '2000-06-30'"

_TRIM = "(' ' || chr(9) || chr(13) || chr(10))"

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _order(names)]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def trim(x: str) -> str:
    return f"trim({x}, {_TRIM})"


def norm_type(x: str) -> str:
    return f"CASE WHEN lower({trim(f'coalesce({x}, {chr(39)}{chr(39)})')}) = 'goal' THEN 'Goal' ELSE 'Monthly' END"


def label_sub(x: str) -> str:
    return f"CASE WHEN {trim(f'coalesce({x}, {chr(39)}{chr(39)})')} = '' THEN '(Unspecified)' ELSE {trim(f'coalesce({x}, {chr(39)}{chr(39)})')} END"


def label_cat(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '(Uncategorized)' ELSE {x} END"


def twelfths(limit: str, freq: str) -> str:
    return (f"CASE {freq} WHEN 'Monthly' THEN {limit} * 12 WHEN 'Quarterly' THEN {limit} * 4 "
            f"WHEN 'Bi-annually' THEN {limit} * 2 WHEN 'Annually' THEN {limit} * 1 ELSE {limit} * 12 END")


def status(lim12: str, tot12: str) -> str:
    return (f"CASE WHEN {lim12} = 0 AND {tot12} = 0 THEN 'No activity' "
            f"WHEN {lim12} = 0 AND {tot12} > 0 THEN 'Over (no budget)' "
            f"WHEN {tot12} < {lim12} THEN 'Under budget' WHEN {tot12} = {lim12} THEN 'On budget' "
            f"ELSE 'Over budget' END")


def parse_mdy(x: str) -> str:
    t = trim(x)
    return (f"CASE WHEN regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') "
            f"THEN CAST(try_strptime({t}, '%m/%d/%Y') AS DATE) "
            f"WHEN regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}') "
            f"THEN CAST(try_strptime({t}, '%m/%d/%y') AS DATE) END")


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def num(x: str) -> str:
    return f"TRY_CAST({trim(x)} AS DECIMAL(18,2))"


view("expense_base", [], f"""
  SELECT c.c_nationkey AS household_id,
         CAST(l.l_shipdate AS DATE) AS date,
         p.p_name AS description,
         p.p_type AS category,
         CASE WHEN l.l_linenumber = 1 THEN '' WHEN l.l_linenumber = 2 THEN chr(9) || p.p_brand || chr(10)
              ELSE p.p_brand END AS subcategory,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount,
         c.c_mktsegment AS payer,
         CASE WHEN l.l_returnflag = 'R' THEN ' goal ' WHEN l.l_returnflag = 'A' THEN NULL ELSE 'Monthly' END
           AS expense_type,
         l.l_orderkey AS _ok, l.l_linenumber AS _ln
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey""")

view("expenses", ["expense_base"], f"""
  SELECT household_id, date, coalesce(description, '') AS description, coalesce(category, '') AS category,
         {trim("coalesce(subcategory, '')")} AS subcategory, coalesce(amount, 0) AS amount,
         coalesce(payer, '') AS payer, {norm_type('expense_type')} AS expense_type
  FROM expense_base""")

view("budgets_raw", [], f"""
  SELECT household_id, category, subcategory, arg_min(lim, p_partkey) AS "limit",
         arg_min(frequency, p_partkey) AS frequency, effective_date
  FROM (
    SELECT bp.household_id, p.p_type AS category,
           CASE WHEN p.p_partkey % 10 = 0 THEN '' ELSE p.p_brand END AS subcategory,
           p.p_partkey,
           CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) * p.p_size AS DECIMAL(18,2)) AS lim,
           ['Monthly', 'Quarterly', 'Bi-annually', 'Annually', 'Weekly'][CAST(p.p_partkey % 5 + 1 AS INTEGER)]
             AS frequency,
           CAST(date_trunc('month', DATE '1995-01-01' + CAST(p.p_partkey * 37 % 2400 AS INTEGER)) AS DATE)
             AS effective_date
    FROM (SELECT DISTINCT s.s_nationkey AS household_id, l.l_partkey AS pk
          FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey) bp
    JOIN part p ON bp.pk = p.p_partkey) t
  GROUP BY household_id, category, subcategory, effective_date""")

view("budgets", ["budgets_raw"], f"""
  SELECT household_id, coalesce(category, '') AS category, {trim("coalesce(subcategory, '')")} AS subcategory,
         coalesce("limit", 0) AS "limit", coalesce(frequency, 'Monthly') AS frequency,
         coalesce(effective_date, DATE '2020-01-01') AS effective_date,
         CAST(lead(effective_date) OVER (PARTITION BY household_id, category, subcategory
                                         ORDER BY effective_date, "limit", frequency) - 1 AS DATE) AS conclusion_date
  FROM budgets_raw""")

view("goal_base", ["expenses"], """
  SELECT household_id, category,
         CASE WHEN household_id % 3 = 0 THEN lower(category) ELSE category END AS goal,
         CAST(sum(amount) * 2 AS DECIMAL(18,2)) AS target_amount,
         CAST(date_trunc('month', max(date)) AS DATE) AS target_month,
         min(date) AS created_date,
         household_id % 4 = 0 AS completed
  FROM expenses WHERE expense_type = 'Goal' GROUP BY household_id, category""")

view("goals", ["goal_base"], """
  SELECT household_id, goal, target_amount, target_month, created_date, completed FROM goal_base""")

view("goal_progress", ["expenses"], """
  SELECT household_id, goal, month, month(month) % 3 <> 0 AS saved FROM (
    SELECT DISTINCT household_id,
           CASE WHEN household_id % 3 = 0 THEN lower(category) ELSE category END AS goal,
           CAST(date_trunc('month', date) AS DATE) AS month
    FROM expenses WHERE expense_type = 'Goal') t""")

view("goal_links", ["goal_base"], """
  SELECT household_id, goal, category, '' AS subcategory, created_date AS start_date,
         CASE WHEN completed THEN last_day(target_month) END AS end_date
  FROM goal_base""")

view("income", [], """
  SELECT c_nationkey AS household_id, c_name AS source, CAST(c_acctbal AS DECIMAL(18,2)) AS amount FROM customer""")

view("scoped", ["expenses", "goals"], f"""
  SELECT e.*,
         CASE WHEN e.expense_type = 'Goal' THEN 'Goal' ELSE 'Monthly' END AS budget_scope,
         CASE WHEN e.expense_type = 'Goal' AND EXISTS (
             SELECT 1 FROM goals g WHERE g.household_id = e.household_id
               AND lower({trim('g.goal')}) = lower({trim('e.category')}))
              THEN e.category ELSE '' END AS allocated_goal
  FROM expenses e""")

view("staged", ["expense_base"], """
  SELECT household_id, date,
         CASE (_ok + _ln) % 7 WHEN 0 THEN description WHEN 1 THEN upper(description)
              WHEN 2 THEN description || 'xyz' WHEN 3 THEN description || repeat('q', _ln)
              WHEN 4 THEN substr(description, 1, 3) WHEN 5 THEN NULL
              ELSE 'refund ' || description END AS description,
         CAST(CASE WHEN _ln = 3 THEN amount + 0.01 ELSE amount END AS DECIMAL(18,2)) AS amount,
         CASE WHEN (_ok + _ln) % 7 IN (1, 2) THEN '' ELSE category END AS category,
         payer,
         _ok * 100 + _ln AS seq
  FROM expense_base""")

view("staged_repeats", ["expense_base"], """
  SELECT household_id, date, description, amount, payer, category, subcategory, 0 AS _copy, _ok, _ln, expense_type
  FROM expense_base
  UNION ALL
  SELECT household_id, date, description, amount,
         CASE WHEN _ln % 2 = 0 THEN payer || '*' ELSE payer END, category, subcategory, 1, _ok, _ln, expense_type
  FROM expense_base""")

view("statement_orders", [], """
  SELECT c.c_nationkey AS household_id, o.o_orderkey AS okey, o.o_orderkey % 5 AS layout,
         o.o_orderstatus AS status,
         CASE WHEN o.o_orderkey % 11 = 0 THEN '13/45/2024'
              WHEN o.o_orderkey % 3 = 0 THEN strftime(CAST(o.o_orderdate AS DATE), '%-m/%-d/%y')
              ELSE strftime(CAST(o.o_orderdate AS DATE), '%-m/%-d/%Y') END AS date_txt,
         'ORDER ' || o.o_orderpriority AS description,
         CASE WHEN o.o_orderkey % 13 = 0 THEN 'n/a'
              ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amt_txt,
         CASE WHEN o.o_orderkey % 13 = 0 THEN 'n/a'
              ELSE CAST(-CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS neg_txt,
         ['OLIVE SMITH', 'ned jones', 'Olive and Ned', 'HOUSEHOLD'][CAST(o.o_custkey % 4 + 1 AS INTEGER)] AS member,
         o.o_orderpriority AS bank_category
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")

view("statement_card", ["statement_orders"], f"""
  SELECT household_id, okey, {parse_mdy('date_txt')} AS date, description,
         {num('amt_txt')} AS amount, '' AS category,
         CASE WHEN contains(lower(member), 'olive') THEN 'Olive' WHEN contains(lower(member), 'ned') THEN 'Ned'
              ELSE 'Joint' END AS payer
  FROM statement_orders
  WHERE layout = 0 AND okey % 2 = 0 AND {num('amt_txt')} IS NOT NULL AND {num('amt_txt')} > 0""")

view("statement_sale", ["statement_orders"], f"""
  SELECT household_id, okey, {parse_mdy('date_txt')} AS date, description,
         abs(x) AS amount, bank_category AS category, 'Joint' AS payer
  FROM (SELECT *, CASE WHEN okey % 3 = 0 THEN {num('amt_txt')} ELSE {num('neg_txt')} END AS x
        FROM statement_orders WHERE layout = 1) t
  WHERE okey % 4 <> 1 AND x < 0""")

view("statement_simple", ["statement_orders"], f"""
  SELECT household_id, okey, {parse_mdy('date_txt')} AS date, description, x AS amount,
         CASE WHEN okey % 4 = 0 THEN NULL ELSE bank_category END AS category, 'Joint' AS payer
  FROM (SELECT *, CASE WHEN okey % 3 = 0 THEN {num('neg_txt')} ELSE {num('amt_txt')} END AS x
        FROM statement_orders WHERE layout = 2) t
  WHERE x > 0""")

view("statement_bank", ["statement_orders"], f"""
  SELECT household_id, okey, {parse_mdy('date_txt')} AS date, description, abs(x) AS amount, '' AS category,
         'Joint' AS payer
  FROM (SELECT *, CASE WHEN okey % 3 = 0 THEN {num('amt_txt')} ELSE {num('neg_txt')} END AS x
        FROM statement_orders WHERE layout = 3) t
  WHERE okey % 4 <> 3 AND x < 0""")

view("statement_headerless", ["statement_orders"], f"""
  SELECT household_id, okey, {parse_mdy('date_txt')} AS date, description, abs(x) AS amount, '' AS category,
         'Joint' AS payer
  FROM (SELECT *, CASE WHEN okey % 3 = 0 THEN {num('amt_txt')} ELSE {num('neg_txt')} END AS x
        FROM statement_orders WHERE layout = 4) t
  WHERE x IS NOT NULL AND x < 0""")

view("statement_union", ["statement_card", "statement_sale", "statement_simple", "statement_bank",
                         "statement_headerless"], """
  SELECT * FROM statement_card UNION ALL SELECT * FROM statement_sale UNION ALL SELECT * FROM statement_simple
  UNION ALL SELECT * FROM statement_bank UNION ALL SELECT * FROM statement_headerless""")
