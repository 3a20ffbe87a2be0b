"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code from the operator semantics; they
share only the test-view definitions (`testviews_sql`).
"""

from __future__ import annotations

from ledgerlake.sources.testviews_sql import (AS_OF, REPORT_END, REPORT_START, label_cat, label_sub, norm_type,
                                              status, trim, twelfths, with_views)

SQL: dict[str, str] = {}


def q(name: str, body: str, *views: str) -> None:
    SQL[name] = with_views(body, *views)


def snapshot(src: str, date: str) -> str:
    return f"""(SELECT household_id, category, subcategory, effective_date, "limit", frequency, conclusion_date
      FROM {src} WHERE effective_date <= {date}
      QUALIFY row_number() OVER (PARTITION BY household_id, category, subcategory
                                 ORDER BY effective_date DESC, "limit" DESC, frequency DESC,
                                          conclusion_date DESC NULLS LAST) = 1)"""


def cat_summary(date_filter: bool = True) -> str:
    f = f"AND date >= {REPORT_START} AND date <= {REPORT_END}" if date_filter else ""
    return f"""(SELECT household_id, category, {label_sub('subcategory')} AS subcategory,
             sum(amount) AS total, count(*) AS transactions
      FROM scoped WHERE budget_scope = 'Monthly' {f} GROUP BY 1, 2, 3)"""


def bva(report_date: str, date_filter: bool) -> str:
    return f""", snap AS {snapshot('budgets', report_date)},
    s AS (SELECT household_id, category, {label_sub('subcategory')} AS subcategory,
                 {twelfths('"limit"', 'frequency')} AS limit_x12, frequency, effective_date, conclusion_date
          FROM snap),
    cats AS {cat_summary(date_filter)},
    j AS (SELECT coalesce(s.household_id, c.household_id) AS household_id,
                 coalesce(s.category, c.category) AS category,
                 coalesce(s.subcategory, c.subcategory) AS subcategory,
                 coalesce(s.limit_x12, 0) AS limit_x12, s.frequency, s.effective_date, s.conclusion_date,
                 coalesce(c.total, 0) AS total, coalesce(c.transactions, 0) AS transactions
          FROM s FULL OUTER JOIN cats c
            ON s.household_id = c.household_id AND s.category = c.category AND s.subcategory = c.subcategory)
"""


BVA_SELECT = f"""
SELECT household_id, category, subcategory, frequency, effective_date, conclusion_date,
       CAST(total AS DOUBLE) AS total, transactions,
       CAST(limit_x12 AS DOUBLE) / 12.0 AS "limit",
       CAST(limit_x12 - total * 12 AS DOUBLE) / 12.0 AS remaining,
       {status('limit_x12', 'total * 12')} AS status
FROM j"""

# ---- cleaning / sources -------------------------------------------------------------------

q("ledger_clean", """
SELECT household_id, date, description, category, subcategory, CAST(amount AS DOUBLE) AS amount, payer,
       expense_type FROM expenses""", "expenses")

q("budget_clean", """
SELECT household_id, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, effective_date,
       conclusion_date FROM budgets""", "budgets")

q("income_total", """
SELECT household_id, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS income FROM income GROUP BY household_id""",
  "income")

# ---- budgets ------------------------------------------------------------------------------

q("budget_history", """
SELECT household_id, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, effective_date,
       CAST(lead(effective_date) OVER (PARTITION BY household_id, category, subcategory
                                ORDER BY effective_date, "limit", frequency) - 1 AS DATE) AS conclusion_date
FROM budgets_raw""", "budgets_raw")

q("budget_snapshot", f"""
SELECT household_id, category, subcategory, effective_date, CAST("limit" AS DOUBLE) AS "limit", frequency,
       conclusion_date FROM {snapshot('budgets', AS_OF)} t""", "budgets")

q("budget_active", f"""
, live AS (SELECT * FROM budgets WHERE conclusion_date IS NULL OR conclusion_date >= {AS_OF})
SELECT household_id, category, subcategory, effective_date, CAST("limit" AS DOUBLE) AS "limit", frequency,
       conclusion_date FROM {snapshot('live', REPORT_START)} t""", "budgets")

q("budgets_current", f"""
SELECT household_id, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, effective_date,
       conclusion_date FROM budgets
WHERE effective_date <= {AS_OF} AND (conclusion_date IS NULL OR conclusion_date >= {AS_OF})""", "budgets")

q("budgets_future", f"""
SELECT household_id, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, effective_date,
       conclusion_date FROM budgets WHERE effective_date > {AS_OF}""", "budgets")

q("budget_monthly_limits", f"""
SELECT household_id, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, effective_date,
       conclusion_date, CAST({twelfths('"limit"', 'frequency')} AS DOUBLE) / 12.0 AS monthly_limit
FROM budgets""", "budgets")

# ---- reports ------------------------------------------------------------------------------

q("ledger_totals", """
SELECT household_id, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS count FROM expenses GROUP BY household_id""",
  "expenses")

q("scope_expenses", """
SELECT household_id, date, description, category, subcategory, CAST(amount AS DOUBLE) AS amount, payer,
       expense_type, budget_scope, allocated_goal FROM scoped""", "scoped")

q("category_summary", f"""
SELECT household_id, category, subcategory, CAST(total AS DOUBLE) AS total, transactions
FROM {cat_summary(True)} t""", "scoped")

q("category_summary_all", f"""
SELECT household_id, category, subcategory, CAST(total AS DOUBLE) AS total, transactions
FROM {cat_summary(False)} t""", "scoped")

q("budget_vs_actual", bva(REPORT_START, True) + BVA_SELECT, "scoped", "budgets")
q("budget_vs_actual_all", bva(AS_OF, False) + BVA_SELECT, "scoped", "budgets")

q("report_summary", bva(REPORT_START, True) + """
SELECT household_id, CAST(sum(limit_x12) AS DOUBLE) / 12.0 AS total_limit,
       CAST(sum(total) AS DOUBLE) AS total_spent,
       CAST(sum(limit_x12) - sum(total) * 12 AS DOUBLE) / 12.0 AS difference,
       CASE WHEN sum(limit_x12) - sum(total) * 12 >= 0 THEN 'Under Budget' ELSE 'Over Budget' END AS status
FROM j GROUP BY household_id""", "scoped", "budgets")

q("goal_spending", """
SELECT s.household_id, s.goal, CAST(s.total AS DOUBLE) AS total, s.transactions,
       CAST(t.goal_target AS DOUBLE) AS goal_target,
       CASE WHEN t.goal_target IS NOT NULL AND t.goal_target > 0
            THEN least(100.0, CAST(s.total AS DOUBLE) / CAST(t.goal_target AS DOUBLE) * 100.0) END AS progress_pct
FROM (SELECT household_id, allocated_goal AS goal, sum(amount) AS total, count(*) AS transactions
      FROM scoped WHERE budget_scope = 'Goal' AND allocated_goal <> '' GROUP BY 1, 2) s
LEFT JOIN (SELECT household_id, goal, max(target_amount) AS goal_target FROM goals GROUP BY 1, 2) t
  ON s.household_id = t.household_id AND s.goal = t.goal""", "scoped", "goals")

q("trend_total_month", """
SELECT household_id, CAST(date_trunc('month', date) AS DATE) AS period, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS total
FROM scoped WHERE budget_scope = 'Monthly' AND date IS NOT NULL GROUP BY 1, 2""", "scoped")

q("trend_total_week", """
SELECT household_id, CAST(date_trunc('week', date) AS DATE) AS period, CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS total
FROM scoped WHERE budget_scope = 'Monthly' AND date IS NOT NULL GROUP BY 1, 2""", "scoped")

q("trend_by_category", f"""
SELECT household_id, CAST(date_trunc('month', date) AS DATE) AS period, {label_cat('category')} AS category,
       CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS total
FROM scoped WHERE budget_scope = 'Monthly' AND date IS NOT NULL GROUP BY 1, 2, 3""", "scoped")

q("recent_spending", f"""
SELECT household_id, date, {label_cat('category')} AS category, CAST(sum(amount) AS DOUBLE) AS amount
FROM expenses WHERE date >= {REPORT_END} - 28 AND date <= {REPORT_END} GROUP BY 1, 2, 3""", "expenses")


def cat_percent(budget_src: str) -> str:
    return f""", cats AS {cat_summary(True)},
    spend AS (SELECT household_id, {label_cat('category')} AS category, sum(total) AS total FROM cats GROUP BY 1, 2),
    lim AS (SELECT household_id, {label_cat('category')} AS category,
                   sum({twelfths('"limit"', 'frequency')}) AS limit_x12 FROM {budget_src} GROUP BY 1, 2),
    j AS (SELECT coalesce(spend.household_id, lim.household_id) AS household_id,
                 coalesce(spend.category, lim.category) AS category,
                 coalesce(spend.total, 0) AS total, coalesce(lim.limit_x12, 0) AS limit_x12
          FROM spend FULL OUTER JOIN lim ON spend.household_id = lim.household_id AND spend.category = lim.category)
SELECT household_id, category, CAST(total AS DOUBLE) AS total, CAST(limit_x12 AS DOUBLE) / 12.0 AS "limit",
       CASE WHEN limit_x12 > 0 THEN CAST(total * 12 AS DOUBLE) / CAST(limit_x12 AS DOUBLE) * 100.0
            WHEN total > 0 THEN 100.0 ELSE 0.0 END AS percent,
       (limit_x12 > 0 AND total * 12 > limit_x12) OR (limit_x12 = 0 AND total > 0) AS over_budget
FROM j"""


q("category_percent", cat_percent("budgets"), "scoped", "budgets")
q("category_percent_active", f""", live AS (SELECT * FROM budgets WHERE conclusion_date IS NULL OR conclusion_date >= {AS_OF}),
    active AS {snapshot('live', REPORT_START)}""" + cat_percent("active"), "scoped", "budgets")


# ---- dedup / categorisation ---------------------------------------------------------------

q("dedup_internal", """
SELECT household_id, date, description, CAST(amount AS DOUBLE) AS amount, payer, category, subcategory, expense_type
FROM staged_repeats
QUALIFY row_number() OVER (PARTITION BY household_id, date, description, amount, payer
                           ORDER BY _copy, _ok, _ln, category NULLS FIRST, subcategory NULLS FIRST,
                                    expense_type NULLS FIRST) = 1""", "staged_repeats")

STAGED_COLS = "s.household_id, s.date, s.description, CAST(s.amount AS DOUBLE) AS amount, s.category, s.payer, s.seq"

q("dedup_strict", f"""
SELECT {STAGED_COLS} FROM staged s
WHERE NOT EXISTS (SELECT 1 FROM expenses e WHERE e.household_id = s.household_id
                    AND e.date IS NOT DISTINCT FROM s.date AND e.amount IS NOT DISTINCT FROM s.amount
                    AND e.description IS NOT DISTINCT FROM s.description)""", "staged", "expenses")

q("dedup_fuzzy", f"""
SELECT {STAGED_COLS} FROM staged s
WHERE NOT EXISTS (SELECT 1 FROM expenses e WHERE e.household_id = s.household_id
                    AND e.date = s.date AND e.amount = s.amount
                    AND coalesce(levenshtein(lower(s.description), lower(e.description)) < 5
                                 OR contains(lower(e.description), lower(s.description)), true))""",
  "staged", "expenses")

PREDICT = """
, hist AS (SELECT household_id, lower(description) AS hd, category, subcategory, count(*) AS n
           FROM expenses WHERE category <> '' GROUP BY 1, 2, 3, 4),
  descs AS (SELECT DISTINCT household_id, description, lower(description) AS nd FROM staged),
  pairs AS (SELECT DISTINCT n.household_id, n.nd, h.hd
            FROM (SELECT DISTINCT household_id, nd FROM descs WHERE nd IS NOT NULL) n
            JOIN (SELECT DISTINCT household_id, hd FROM hist) h
              ON n.household_id = h.household_id AND (contains(h.hd, n.nd) OR contains(n.nd, h.hd))),
  votes AS (SELECT p.household_id, p.nd, h.category, h.subcategory, sum(h.n) AS n
            FROM pairs p JOIN hist h ON p.household_id = h.household_id AND p.hd = h.hd GROUP BY 1, 2, 3, 4),
  best AS (SELECT * FROM votes
           QUALIFY row_number() OVER (PARTITION BY household_id, nd ORDER BY n DESC, category, subcategory) = 1),
  pred AS (SELECT d.household_id, d.description, coalesce(b.category, '') AS category,
                  coalesce(b.subcategory, '') AS subcategory
           FROM descs d LEFT JOIN best b ON d.household_id = b.household_id AND d.nd = b.nd)
"""

q("predict_category", PREDICT + "SELECT * FROM pred", "staged", "expenses")

q("auto_categorize", PREDICT + """
, st AS (SELECT household_id, date, description, amount, coalesce(category, '') AS category, payer, seq,
                seq AS id, '' AS subcategory, 'Monthly' AS expense_type, false AS duplicate FROM staged)
SELECT st.household_id, st.date, st.description, CAST(st.amount AS DOUBLE) AS amount,
       CASE WHEN st.category = '' THEN coalesce(p.category, '') ELSE st.category END AS category,
       CASE WHEN st.category = '' THEN coalesce(p.subcategory, '') ELSE st.subcategory END AS subcategory,
       st.payer, st.seq, st.id, st.expense_type, st.duplicate
FROM st LEFT JOIN pred p ON st.household_id = p.household_id AND st.description = p.description""",
  "staged", "expenses")

# ---- suggestions / goals ------------------------------------------------------------------

SUGG = f"""
, lines AS (SELECT household_id, category, subcategory, "limit" FROM budgets
            WHERE effective_date <= {AS_OF} AND (conclusion_date IS NULL OR conclusion_date >= {AS_OF})
              AND frequency = 'Monthly'),
  exp AS (SELECT household_id, category, subcategory, CAST(date_trunc('month', date) AS DATE) AS month,
                 sum(amount) AS total
          FROM scoped WHERE budget_scope = 'Monthly' AND date >= DATE '2000-04-01' AND date <= {REPORT_END}
          GROUP BY 1, 2, 3, 4),
  m AS (SELECT l.household_id, l.category, l.subcategory, l."limit",
               coalesce(sum(CASE WHEN e.month = DATE '2000-04-01' THEN e.total END), 0) AS t2,
               coalesce(sum(CASE WHEN e.month = DATE '2000-05-01' THEN e.total END), 0) AS t1,
               coalesce(sum(CASE WHEN e.month = DATE '2000-06-01' THEN e.total END), 0) AS t0
        FROM lines l LEFT JOIN exp e ON e.household_id = l.household_id AND e.category = l.category
                                     AND (l.subcategory = '' OR e.subcategory = l.subcategory)
        GROUP BY 1, 2, 3, 4),
  sugg AS (SELECT household_id, category, subcategory, "limit" AS current_limit,
                  round_even(t2 * 0.1 + t1 * 0.3 + t0 * 0.6, 0) AS hasty_limit,
                  round_even(t2 * 0.2 + t1 * 0.4 + t0 * 0.4, 0) AS conservative_limit,
                  t0 AS current_month_spent
           FROM m WHERE abs(t0 - "limit") > 50)
"""

q("budget_suggestions", SUGG + """
SELECT household_id, category, subcategory, CAST(current_limit AS DOUBLE) AS current_limit,
       CAST(hasty_limit AS DOUBLE) AS hasty_limit, CAST(conservative_limit AS DOUBLE) AS conservative_limit,
       CAST(current_month_spent AS DOUBLE) AS current_month_spent FROM sugg""", "scoped", "budgets")

SAVING = """(SELECT *, (CAST(target_amount * 1000000 AS BIGINT) * 2 + months_needed) // (months_needed * 2)
                       AS saving_micros
             FROM (SELECT *, CAST(greatest(1, (year(target_month) - year(created_date)) * 12
                                          + month(target_month) - month(created_date)) AS INTEGER) AS months_needed
                   FROM goals) g0)"""

q("goal_progress_report", f"""
, g2 AS (SELECT * FROM {SAVING} g1 WHERE NOT completed),
  saved AS (SELECT household_id, goal, count(*) AS months_saved FROM goal_progress WHERE saved GROUP BY 1, 2),
  spent AS (SELECT household_id, category AS goal, sum(amount) AS spent FROM expenses
            WHERE expense_type = 'Goal' GROUP BY 1, 2),
  tm AS (SELECT household_id, goal, bool_or(saved) AS saved_this_month FROM goal_progress
         WHERE month = {REPORT_START} GROUP BY 1, 2)
SELECT g2.household_id, g2.goal, CAST(g2.target_amount AS DOUBLE) AS target_amount, g2.target_month,
       g2.created_date, g2.months_needed, CAST(g2.saving_micros AS DOUBLE) / 1000000 AS monthly_saving,
       coalesce(saved.months_saved, 0) AS months_saved,
       least(100.0, round_even(CAST(coalesce(saved.months_saved, 0) AS DOUBLE)
                               / CAST(g2.months_needed AS DOUBLE) * 100.0, 0)) AS saved_pct,
       CAST(coalesce(spent.spent, 0) AS DOUBLE) AS spent,
       CASE WHEN g2.target_amount > 0 THEN least(100.0, round_even(CAST(coalesce(spent.spent, 0) AS DOUBLE)
                               / CAST(g2.target_amount AS DOUBLE) * 100.0, 0)) END AS spent_pct,
       coalesce(tm.saved_this_month, false) AS saved_this_month
FROM g2
LEFT JOIN saved ON g2.household_id = saved.household_id AND g2.goal = saved.goal
LEFT JOIN spent ON g2.household_id = spent.household_id AND g2.goal = spent.goal
LEFT JOIN tm ON g2.household_id = tm.household_id AND g2.goal = tm.goal""", "goals", "goal_progress", "expenses")

q("goals_completed", """
SELECT household_id, goal, CAST(target_amount AS DOUBLE) AS target_amount, target_month, created_date, completed,
       CAST(100.0 AS DOUBLE) AS saved_pct, CAST(100.0 AS DOUBLE) AS spent_pct
FROM goals WHERE completed""", "goals")

q("goal_saving_total", f"""
SELECT household_id, CAST(sum(saving_micros) AS DOUBLE) / 1000000 AS monthly_saving_total
FROM {SAVING} g1 WHERE NOT completed GROUP BY 1""", "goals")

q("income_allocation", f"""
, inc AS (SELECT household_id, sum(coalesce(amount, 0)) AS income FROM income GROUP BY 1),
  lim AS (SELECT household_id, sum({twelfths('"limit"', 'frequency')}) AS limits_x12 FROM budgets
          WHERE effective_date <= {AS_OF} AND (conclusion_date IS NULL OR conclusion_date >= {AS_OF}) GROUP BY 1),
  sav AS (SELECT household_id, sum(saving_micros) AS saving_micros FROM {SAVING} g1 GROUP BY 1),
  ids AS (SELECT household_id FROM inc UNION SELECT household_id FROM lim UNION SELECT household_id FROM sav)
SELECT ids.household_id, CAST(inc.income AS DOUBLE) AS income,
       CAST(coalesce(lim.limits_x12, 0) AS DOUBLE) / 12.0 AS budget_total,
       CAST(coalesce(sav.saving_micros, 0) AS DOUBLE) / 1000000 AS goal_saving_total,
       CAST(inc.income * 12000000 - coalesce(lim.limits_x12, 0) * 1000000
            - CAST(coalesce(sav.saving_micros, 0) AS DECIMAL(38,0)) * 12 AS DOUBLE) / 12000000.0 AS remaining
FROM ids LEFT JOIN inc ON ids.household_id = inc.household_id
LEFT JOIN lim ON ids.household_id = lim.household_id
LEFT JOIN sav ON ids.household_id = sav.household_id""", "income", "budgets", "goals")

LINK_ALLOCATION = """
, day AS (SELECT household_id, category, subcategory, date, sum(amount) AS total, count(*) AS transactions
          FROM expenses WHERE date IS NOT NULL GROUP BY 1, 2, 3, 4),
  m AS (SELECT d.*, l.goal, l.start_date FROM day d JOIN {links} l
          ON d.household_id = l.household_id AND d.category = l.category
         AND (l.subcategory = '' OR l.subcategory = d.subcategory)
         AND d.date >= l.start_date AND (l.end_date IS NULL OR d.date <= l.end_date)),
  best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY household_id, category, subcategory, date
                                                      ORDER BY start_date DESC, goal) = 1)
SELECT household_id, goal, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(transactions) AS BIGINT) AS transactions
FROM best GROUP BY 1, 2"""
q("goal_link_allocation", LINK_ALLOCATION.format(links="goal_links"), "expenses", "goal_links")

q("goal_link_allocation_lines", """
, sub AS (SELECT household_id, category, min(subcategory) AS a, max(subcategory) AS z FROM expenses WHERE subcategory <> '' GROUP BY 1, 2),
  links AS (SELECT household_id, goal, category, subcategory, start_date, end_date FROM goal_links WHERE household_id % 2 = 1
            UNION ALL SELECT l.household_id, 'First ' || goal, l.category, a, CAST(start_date + INTERVAL 100 DAY AS DATE), end_date
              FROM goal_links l JOIN sub ON sub.household_id = l.household_id AND sub.category = l.category
            UNION ALL SELECT l.household_id, 'Last ' || goal, l.category, z, start_date, end_date
              FROM goal_links l JOIN sub ON sub.household_id = l.household_id AND sub.category = l.category)
""" + LINK_ALLOCATION.format(links="links"), "expenses", "goal_links")


# ---- statements ---------------------------------------------------------------------------

for _name in ["statement_card", "statement_sale", "statement_simple", "statement_bank", "statement_headerless",
              "statement_union"]:
    q(_name, f"""
SELECT household_id, okey, date, description, CAST(amount AS DOUBLE) AS amount, category, payer FROM {_name}""", _name)

H_CARD = "Status,Date,Description,Debit,Credit,Member Name"
H_SALE = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"
H_SIMPLE = "Trans. Date,Post Date,Description,Amount,Category"
H_BANK = "Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #"

q("statement_formats", f"""
, fl AS (SELECT household_id, okey AS file_id,
                CASE WHEN layout = 4 THEN concat_ws(',', date_txt, neg_txt, '*', '', description)
                     ELSE ['{H_CARD}', '{H_SALE}', '{H_SIMPLE}', '{H_BANK}'][CAST(layout + 1 AS INTEGER)]
                          || CASE WHEN okey % 2 = 1 THEN ',Extra' ELSE '' END END AS first_line
         FROM statement_orders)
SELECT household_id, file_id,
       CASE WHEN contains(first_line, '{H_CARD}') THEN 'card' WHEN contains(first_line, '{H_SALE}') THEN 'sale'
            WHEN contains(first_line, '{H_SIMPLE}') THEN 'simple' WHEN contains(first_line, '{H_BANK}') THEN 'bank'
            ELSE 'headerless' END AS format
FROM fl""", "statement_orders")

FUZZY_NOT_EXISTS = """NOT EXISTS (SELECT 1 FROM expenses e WHERE e.household_id = s.household_id
                    AND e.date = s.date AND e.amount = s.amount
                    AND coalesce(levenshtein(lower(s.description), lower(e.description)) < 5
                                 OR contains(lower(e.description), lower(s.description)), true))"""

q("stage_statements", f"""
, st AS (SELECT household_id, okey, date, description, amount, coalesce(category, '') AS category, payer,
                okey AS id, '' AS subcategory, 'Monthly' AS expense_type, false AS duplicate FROM statement_union),
  st1 AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY household_id, date, description, amount, payer
                                                      ORDER BY okey, id, category, subcategory) = 1)
SELECT s.household_id, s.date, s.description, CAST(s.amount AS DOUBLE) AS amount, s.payer, s.okey, s.category, s.id,
       s.subcategory, s.expense_type, s.duplicate
FROM st1 s WHERE {FUZZY_NOT_EXISTS}""", "statement_union", "expenses")

# ---- maintenance --------------------------------------------------------------------------

LEDGER_OUT = "household_id, date, description, category, subcategory, CAST(amount AS DOUBLE) AS amount, payer, expense_type"

q("ledger_append", f"""
SELECT {LEDGER_OUT} FROM expenses
UNION ALL
SELECT household_id, date, description, coalesce(category, ''), '', CAST(amount AS DOUBLE), payer, 'Monthly'
FROM statement_union""", "expenses", "statement_union")

q("import_batch", f"""
, new AS (SELECT household_id, date, description, amount, coalesce(category, '') AS category, payer FROM staged s
          WHERE NOT EXISTS (SELECT 1 FROM expenses e WHERE e.household_id = s.household_id
                              AND e.date IS NOT DISTINCT FROM s.date AND e.amount IS NOT DISTINCT FROM s.amount
                              AND e.description IS NOT DISTINCT FROM s.description))
SELECT {LEDGER_OUT} FROM expenses
UNION ALL
SELECT household_id, date, description, category, '', CAST(amount AS DOUBLE), payer, 'Monthly' FROM new""",
  "staged", "expenses")

q("ledger_delete", f"""
, req AS (SELECT household_id, date, coalesce(description, '') AS description, coalesce(category, '') AS category,
                 {trim("coalesce(subcategory, '')")} AS subcategory, coalesce(amount, 0) AS amount,
                 coalesce(payer, '') AS payer, count(*) AS r
          FROM expense_base WHERE (_ok + _ln) % 7 = 0 GROUP BY 1, 2, 3, 4, 5, 6, 7),
  led AS (SELECT * FROM expenses UNION ALL SELECT * FROM expenses),
  num AS (SELECT l.*, row_number() OVER (PARTITION BY household_id, date, description, category, subcategory, amount,
                                                      payer ORDER BY expense_type NULLS FIRST) AS n FROM led l)
SELECT n.household_id, n.date, n.description, n.category, n.subcategory, CAST(n.amount AS DOUBLE) AS amount, n.payer,
       n.expense_type
FROM num n LEFT JOIN req r ON n.household_id = r.household_id AND n.date = r.date AND n.description = r.description
  AND n.category = r.category AND n.subcategory = r.subcategory AND n.amount = r.amount AND n.payer = r.payer
WHERE r.r IS NULL OR n.n > r.r""", "expenses", "expense_base")

E1_OUT = """
SELECT household_id, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, effective_date,
       CAST(lead(effective_date) OVER (PARTITION BY household_id, category, subcategory
                                ORDER BY effective_date, "limit", frequency) - 1 AS DATE) AS conclusion_date
FROM allr"""


def upsert(upd_sql: str, case_sensitive: bool = False) -> str:
    if case_sensitive:
        match = "u.category = b.category AND u.subcategory = b.subcategory"
    else:
        match = (f"lower(u.category) = lower(b.category) "
                 f"AND lower({trim('u.subcategory')}) = lower({trim('b.subcategory')})")
    return f""", upd AS ({upd_sql}),
  kept AS (SELECT household_id, category, subcategory, "limit", frequency, effective_date FROM budgets b
           WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.household_id = b.household_id AND {match}
                               AND u.effective_date = b.effective_date)),
  allr AS (SELECT * FROM kept UNION ALL
           SELECT household_id, category, {trim('subcategory')}, "limit", frequency, effective_date FROM upd)
""" + E1_OUT


q("budget_upsert", upsert(f"""
  SELECT household_id, CASE WHEN household_id % 2 = 0 THEN lower(category) ELSE category END AS category,
         subcategory, CAST("limit" + 100 AS DECIMAL(18,2)) AS "limit", frequency,
         CASE WHEN household_id % 3 = 0 THEN effective_date ELSE DATE '2000-07-01' END AS effective_date
  FROM {snapshot('budgets', AS_OF)} t"""), "budgets")

q("budget_archive", upsert(f"""
  SELECT household_id, category, subcategory, CAST(0 AS DECIMAL(18,2)) AS "limit", frequency,
         CASE WHEN effective_date > {AS_OF} THEN effective_date ELSE DATE '2000-07-01' END AS effective_date
  FROM budgets WHERE conclusion_date IS NULL"""), "budgets")

q("budget_delete", f"""
, req AS (SELECT household_id, lower(category) AS c, lower({trim('subcategory')}) AS s, effective_date
          FROM budgets WHERE conclusion_date IS NULL),
  allr AS (SELECT household_id, category, subcategory, "limit", frequency, effective_date FROM budgets b
           WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.household_id = b.household_id AND r.c = lower(b.category)
                               AND r.s = lower({trim('b.subcategory')}) AND r.effective_date = b.effective_date))
""" + E1_OUT, "budgets")

q("apply_suggestions", SUGG + upsert("""
  SELECT household_id, category, subcategory, CAST(hasty_limit AS DECIMAL(18,2)) AS "limit", 'Monthly' AS frequency,
         DATE '2000-07-01' AS effective_date FROM sugg""", case_sensitive=True), "scoped", "budgets")

GOAL_OUT = "household_id, goal, CAST(target_amount AS DOUBLE) AS target_amount, target_month, created_date, completed"

q("goal_upsert", f"""
, new AS (SELECT household_id, {trim("CASE WHEN household_id % 2 = 0 THEN goal || ' 2' ELSE goal END")} AS goal,
                 CAST(target_amount + 1000 AS DECIMAL(18,2)) AS target_amount, DATE '2000-12-01' AS target_month,
                 {AS_OF} AS created_date, false AS completed FROM goals)
SELECT {GOAL_OUT} FROM goals g
WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.household_id = g.household_id AND n.goal = g.goal)
UNION ALL SELECT {GOAL_OUT} FROM new""", "goals")

q("goal_delete", """
SELECT household_id, goal, month, saved FROM goal_progress p
WHERE NOT EXISTS (SELECT 1 FROM goals g WHERE g.completed AND g.household_id = p.household_id AND g.goal = p.goal)""",
  "goals", "goal_progress")

q("goal_delete_goals", """
SELECT household_id, goal, CAST(target_amount AS DOUBLE) AS target_amount, target_month, created_date, completed
FROM goals WHERE NOT completed""", "goals")

q("goal_progress_upsert", f"""
, upd AS (SELECT household_id, goal, {REPORT_START} AS month, NOT completed AS saved FROM goals)
SELECT coalesce(p.household_id, u.household_id) AS household_id, coalesce(p.goal, u.goal) AS goal,
       coalesce(p.month, u.month) AS month, coalesce(u.saved, p.saved) AS saved
FROM goal_progress p FULL OUTER JOIN upd u
  ON p.household_id = u.household_id AND p.goal = u.goal AND p.month = u.month""", "goals", "goal_progress")

q("dimension_values", f"""
, eb AS (SELECT household_id, category, {trim("coalesce(subcategory, '')")} AS subcategory FROM expenses
         UNION ALL SELECT household_id, category, {trim("coalesce(subcategory, '')")} FROM budgets),
  ledgers AS (SELECT DISTINCT household_id FROM expenses)
SELECT DISTINCT * FROM (
  SELECT household_id, 'category' AS dimension, category AS value, CAST(NULL AS VARCHAR) AS value2
  FROM eb WHERE category <> ''
  UNION ALL SELECT household_id, 'subcategory', category, subcategory FROM eb WHERE category <> '' AND subcategory <> ''
  UNION ALL SELECT household_id, 'payer', payer, NULL FROM expenses WHERE payer <> ''
  UNION ALL SELECT household_id, 'payer', unnest(['Joint', 'Olive', 'Ned']), NULL FROM ledgers
  UNION ALL SELECT household_id, 'goal', goal, NULL FROM goals
  UNION ALL SELECT household_id, 'month', strftime(CAST(date_trunc('month', date) AS DATE), '%Y-%m-%d'), NULL
            FROM expenses WHERE date IS NOT NULL
  UNION ALL SELECT household_id, 'month', '2000-06-01', NULL FROM ledgers) t""", "expenses", "budgets", "goals")

q("staged_edit", f"""
, st AS (SELECT household_id, date, description, amount, coalesce(category, '') AS category, payer, seq, seq AS id,
                '' AS subcategory, 'Monthly' AS expense_type, false AS duplicate FROM staged),
  ed AS (SELECT DISTINCT household_id, id, CASE WHEN id % 2 = 0 THEN 'EDITED' ELSE '' END AS ec, ' sub ' AS es,
                CASE WHEN id % 4 = 0 THEN 'Joint' ELSE '' END AS ep FROM st)
SELECT st.household_id, st.date, st.description, CAST(st.amount AS DOUBLE) AS amount,
       CASE WHEN ed.id IS NOT NULL AND coalesce(ed.ec, '') <> '' THEN ed.ec ELSE st.category END AS category,
       CASE WHEN ed.id IS NOT NULL THEN {trim("coalesce(ed.es, '')")} ELSE st.subcategory END AS subcategory,
       CASE WHEN ed.id IS NOT NULL AND coalesce(ed.ep, '') <> '' THEN ed.ep ELSE st.payer END AS payer,
       st.seq, st.id, st.expense_type, st.duplicate
FROM st LEFT JOIN ed ON st.household_id = ed.household_id AND st.id = ed.id
WHERE st.id % 5 <> 0 AND NOT st.duplicate""", "staged")

q("validate_entries", f"""
, ent AS (SELECT household_id, CASE WHEN _ln = 5 THEN NULL ELSE date END AS date,
                 CASE (_ok + _ln) % 7 WHEN 5 THEN NULL WHEN 6 THEN '  ' ELSE description END AS description,
                 CASE WHEN (_ok + _ln) % 7 IN (1, 2) THEN '' ELSE category END AS category,
                 CAST(CASE WHEN _ln = 7 THEN -amount WHEN _ln = 6 THEN 0 ELSE amount END AS DECIMAL(18,2)) AS amount,
                 {norm_type('expense_type')} AS expense_type, _ok * 100 + _ln AS row_id FROM expense_base),
  gn AS (SELECT DISTINCT household_id, goal FROM goals),
  chk AS (SELECT e.*, concat_ws(',',
            CASE WHEN e.date IS NULL THEN 'date' END,
            CASE WHEN {trim("coalesce(e.description, '')")} = '' THEN 'description' END,
            CASE WHEN e.expense_type <> 'Goal' AND coalesce(e.category, '') = '' THEN 'category' END,
            CASE WHEN e.expense_type = 'Goal' AND gn.goal IS NULL THEN 'goal' END,
            CASE WHEN e.amount IS NULL OR e.amount <= 0 THEN 'amount' END) AS errors
          FROM ent e LEFT JOIN gn ON e.household_id = gn.household_id AND e.category = gn.goal)
SELECT household_id, date, description, category, CAST(amount AS DOUBLE) AS amount, expense_type, row_id, errors,
       errors = '' AS valid FROM chk""", "expense_base", "goals")

AMOUNT_TXT = "TRY_CAST(regexp_replace(val, '[^0-9.-]', '', 'g') AS DECIMAL(18,2))"

q("patch_expenses", f"""
, ledr AS (SELECT household_id, _ok * 100 + _ln AS row_id, date, coalesce(description, '') AS description,
                  coalesce(category, '') AS category, {trim("coalesce(subcategory, '')")} AS subcategory,
                  coalesce(amount, 0) AS amount, coalesce(payer, '') AS payer,
                  {norm_type('expense_type')} AS expense_type FROM expense_base),
  pt AS (SELECT household_id, _ok * 100 + _ln AS row_id,
                ['amount', 'category', 'subcategory', 'date', 'amount', 'description', 'expense_type'][_ln] AS col,
                ['$1,234.50', ' Travel ', '(Unspecified)', '2001-02-30', '-5', '  new text ', 'GOAL'][_ln] AS val
         FROM expense_base),
  typed AS (SELECT *, CASE WHEN col = 'date' THEN TRY_CAST({trim('val')} AS DATE) END AS nd,
                   CASE WHEN col = 'amount' THEN {AMOUNT_TXT} END AS na,
                   CASE WHEN col = 'category' THEN {trim('val')} END AS nc,
                   CASE WHEN col = 'subcategory' THEN CASE WHEN {trim('val')} = '(Unspecified)' THEN ''
                                                           ELSE {trim('val')} END END AS ns,
                   CASE WHEN col = 'description' THEN {trim('val')} END AS nde,
                   CASE WHEN col = 'payer' THEN {trim('val')} END AS np,
                   CASE WHEN col = 'expense_type' THEN {norm_type('val')} END AS nt
            FROM pt),
  ok AS (SELECT * FROM typed WHERE coalesce(CASE col WHEN 'date' THEN nd IS NOT NULL
                                                     WHEN 'amount' THEN na IS NOT NULL AND na > 0
                                                     WHEN 'category' THEN nc <> ''
                                                     WHEN 'subcategory' THEN true WHEN 'description' THEN true
                                                     WHEN 'payer' THEN true WHEN 'expense_type' THEN true
                                                     ELSE false END, false)),
  acc AS (SELECT household_id, row_id, max(nd) AS nd, bool_or(col = 'date') AS sd, max(na) AS na,
                 bool_or(col = 'amount') AS sa, max(nc) AS nc, bool_or(col = 'category') AS sc, max(ns) AS ns,
                 bool_or(col = 'subcategory') AS ss, max(nde) AS nde, bool_or(col = 'description') AS sde,
                 max(np) AS np, bool_or(col = 'payer') AS sp, max(nt) AS nt, bool_or(col = 'expense_type') AS st
          FROM ok GROUP BY 1, 2)
SELECT l.household_id, l.row_id,
       CASE WHEN a.sd THEN a.nd ELSE l.date END AS date,
       CASE WHEN a.sde THEN a.nde ELSE l.description END AS description,
       CASE WHEN a.sc THEN a.nc ELSE l.category END AS category,
       CASE WHEN a.ss THEN a.ns ELSE l.subcategory END AS subcategory,
       CAST(CASE WHEN a.sa THEN a.na ELSE l.amount END AS DOUBLE) AS amount,
       CASE WHEN a.sp THEN a.np ELSE l.payer END AS payer,
       CASE WHEN a.st THEN a.nt ELSE l.expense_type END AS expense_type
FROM ledr l LEFT JOIN acc a ON l.household_id = a.household_id AND l.row_id = a.row_id""", "expense_base")

q("patch_budgets", f"""
, pt AS (SELECT household_id, category, subcategory, effective_date,
                ['limit', 'limit', 'subcategory'][CAST(month(effective_date) % 3 + 1 AS INTEGER)] AS col,
                ['1,500', '-3', ' Patched ' || subcategory][CAST(month(effective_date) % 3 + 1 AS INTEGER)] AS val
         FROM budgets),
  typed AS (SELECT *, CASE WHEN col = 'limit' THEN {AMOUNT_TXT} END AS nl,
                   CASE WHEN col = 'subcategory' THEN CASE WHEN {trim('val')} = '(Unspecified)' THEN ''
                                                           ELSE {trim('val')} END END AS ns
            FROM pt),
  ok AS (SELECT * FROM typed WHERE coalesce(CASE col WHEN 'limit' THEN nl IS NOT NULL AND nl >= 0
                                                     WHEN 'subcategory' THEN true ELSE false END, false)),
  acc AS (SELECT household_id, category, subcategory, effective_date, max(nl) AS nl, bool_or(col = 'limit') AS sl,
                 max(ns) AS ns, bool_or(col = 'subcategory') AS ss FROM ok GROUP BY 1, 2, 3, 4),
  allr AS (SELECT b.household_id, b.category, CASE WHEN a.ss THEN a.ns ELSE b.subcategory END AS subcategory,
                  CASE WHEN a.sl THEN a.nl ELSE b."limit" END AS "limit", b.frequency, b.effective_date
           FROM budgets b LEFT JOIN acc a ON b.household_id = a.household_id AND b.category = a.category
             AND b.subcategory = a.subcategory AND b.effective_date = a.effective_date)
""" + E1_OUT, "budgets")

q("patch_budgets_rejected", f"""
, pt AS (SELECT household_id, category, subcategory, effective_date,
                ['limit', 'limit', 'subcategory'][CAST(month(effective_date) % 3 + 1 AS INTEGER)] AS col,
                ['1,500', '-3', ' Patched ' || subcategory][CAST(month(effective_date) % 3 + 1 AS INTEGER)] AS val
         FROM budgets),
  typed AS (SELECT *, CASE WHEN col = 'limit' THEN {AMOUNT_TXT} END AS nl,
                   CASE WHEN col = 'subcategory' THEN CASE WHEN {trim('val')} = '(Unspecified)' THEN ''
                                                           ELSE {trim('val')} END END AS ns
            FROM pt)
SELECT household_id, category, subcategory, effective_date, col AS "column", val AS value
FROM typed WHERE NOT coalesce(CASE col WHEN 'limit' THEN nl IS NOT NULL AND nl >= 0
                                                     WHEN 'subcategory' THEN true ELSE false END, false)""", "budgets")

q("report_bundle", f"""
, cats AS (SELECT household_id, CAST(date_trunc('month', date) AS DATE) AS month, category,
                  {label_sub('subcategory')} AS subcategory, sum(amount) AS total
           FROM scoped WHERE budget_scope = 'Monthly' AND date IS NOT NULL GROUP BY 1, 2, 3, 4),
  months AS (SELECT DISTINCT household_id, unnest([CAST(date_trunc('month', date) AS DATE), DATE '2000-06-01']) AS month
             FROM scoped WHERE date IS NOT NULL),
  snap AS (SELECT m.household_id, m.month, b.category, b.subcategory, b."limit", b.frequency
           FROM months m JOIN budgets b ON b.household_id = m.household_id AND b.effective_date <= m.month
           QUALIFY row_number() OVER (PARTITION BY m.household_id, m.month, b.category, b.subcategory
                                      ORDER BY b.effective_date DESC) = 1),
  s AS (SELECT household_id, month, category, {label_sub('subcategory')} AS subcategory,
               {twelfths('"limit"', 'frequency')} AS limit_x12 FROM snap),
  j AS (SELECT coalesce(s.household_id, c.household_id) AS household_id, coalesce(s.month, c.month) AS month,
               coalesce(s.limit_x12, 0) AS limit_x12, coalesce(c.total, 0) AS total
        FROM s FULL OUTER JOIN cats c ON s.household_id = c.household_id AND s.month = c.month
                                     AND s.category = c.category AND s.subcategory = c.subcategory
        UNION ALL SELECT household_id, month, 0, 0 FROM months)
SELECT household_id, month AS report_month, CAST(sum(limit_x12) AS DOUBLE) / 12.0 AS total_limit,
       CAST(sum(total) AS DOUBLE) AS total_spent,
       CAST(sum(limit_x12) - sum(total) * 12 AS DOUBLE) / 12.0 AS difference,
       CASE WHEN sum(limit_x12) - sum(total) * 12 >= 0 THEN 'Under Budget' ELSE 'Over Budget' END AS status
FROM j GROUP BY 1, 2""", "scoped", "budgets")


q("patch_expenses_rejected", f"""
, pt AS (SELECT household_id, _ok * 100 + _ln AS row_id,
                ['amount', 'category', 'subcategory', 'date', 'amount', 'description', 'expense_type'][_ln] AS col,
                ['$1,234.50', ' Travel ', '(Unspecified)', '2001-02-30', '-5', '  new text ', 'GOAL'][_ln] AS val
         FROM expense_base),
  typed AS (SELECT *, CASE WHEN col = 'date' THEN TRY_CAST({trim('val')} AS DATE) END AS nd,
                   CASE WHEN col = 'amount' THEN {AMOUNT_TXT} END AS na,
                   CASE WHEN col = 'category' THEN {trim('val')} END AS nc FROM pt)
SELECT household_id, row_id, col AS "column", val AS value FROM typed
WHERE NOT coalesce(CASE col WHEN 'date' THEN nd IS NOT NULL WHEN 'amount' THEN na IS NOT NULL AND na > 0
                            WHEN 'category' THEN nc <> '' WHEN 'subcategory' THEN true WHEN 'description' THEN true
                            WHEN 'payer' THEN true WHEN 'expense_type' THEN true ELSE false END, false)""",
  "expense_base")


q("trend_by_category_selected", f"""
SELECT household_id, CAST(date_trunc('month', date) AS DATE) AS period, {label_cat('category')} AS category,
       CAST(sum(coalesce(amount, 0)) AS DOUBLE) AS total
FROM scoped WHERE budget_scope = 'Monthly' AND date IS NOT NULL AND {label_cat('category')} IN ('ECONOMY', 'PROMO')
GROUP BY 1, 2, 3""", "scoped")

q("validate_budgets", f"""
, ent AS (SELECT household_id, CASE WHEN month(effective_date) = 1 THEN NULL ELSE effective_date END AS effective_date,
                 category, subcategory,
                 CASE WHEN month(effective_date) = 2 THEN -"limit" ELSE "limit" END AS "limit", frequency
          FROM budgets_raw),
  chk AS (SELECT *, concat_ws(',', CASE WHEN effective_date IS NULL THEN 'date' END,
                              CASE WHEN {trim("coalesce(category, '')")} = '' THEN 'category' END,
                              CASE WHEN "limit" IS NULL OR "limit" < 0 THEN 'limit' END) AS errors FROM ent)
SELECT household_id, effective_date, category, subcategory, CAST("limit" AS DOUBLE) AS "limit", frequency, errors,
       errors = '' AS valid FROM chk""", "budgets_raw")

q("validate_goals", f"""
, ent AS (SELECT household_id, CASE WHEN completed THEN ' ' ELSE goal END AS goal,
                 CASE WHEN household_id % 5 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE target_amount END AS target_amount,
                 target_month FROM goals),
  chk AS (SELECT *, concat_ws(',', CASE WHEN {trim("coalesce(goal, '')")} = '' THEN 'goal' END,
                              CASE WHEN target_amount IS NULL OR target_amount <= 0 THEN 'target' END,
                              CASE WHEN target_month IS NULL THEN 'month' END) AS errors FROM ent)
SELECT household_id, goal, CAST(target_amount AS DOUBLE) AS target_amount, target_month, errors,
       errors = '' AS valid FROM chk""", "goals")

q("validate_income", """
, chk AS (SELECT *, concat_ws(',', CASE WHEN amount IS NULL OR amount < 0 THEN 'amount' END) AS errors FROM income)
SELECT household_id, source, CAST(amount AS DOUBLE) AS amount, errors, errors = '' AS valid FROM chk""", "income")


q("goal_spending_month", f"""
SELECT s.household_id, s.goal, CAST(s.total AS DOUBLE) AS total, s.transactions,
       CAST(t.goal_target AS DOUBLE) AS goal_target,
       CASE WHEN t.goal_target IS NOT NULL AND t.goal_target > 0
            THEN least(100.0, CAST(s.total AS DOUBLE) / CAST(t.goal_target AS DOUBLE) * 100.0) END AS progress_pct
FROM (SELECT household_id, allocated_goal AS goal, sum(amount) AS total, count(*) AS transactions
      FROM scoped WHERE budget_scope = 'Goal' AND allocated_goal <> ''
        AND date >= {REPORT_START} AND date <= {REPORT_END} GROUP BY 1, 2) s
LEFT JOIN (SELECT household_id, goal, max(target_amount) AS goal_target FROM goals GROUP BY 1, 2) t
  ON s.household_id = t.household_id AND s.goal = t.goal""", "scoped", "goals")

q("recent_spending_all", f"""
SELECT household_id, date, {label_cat('category')} AS category, CAST(sum(amount) AS DOUBLE) AS amount
FROM expenses WHERE date >= {AS_OF} - 28 AND date <= {AS_OF} GROUP BY 1, 2, 3""", "expenses")


q("category_percent_all", cat_percent("budgets").replace(
    f"AND date >= {REPORT_START} AND date <= {REPORT_END}", ""), "scoped", "budgets")


q("goal_completion_update", """
, upd AS (SELECT household_id, goal, bool_or(household_id % 2 = 1) AS c FROM goals GROUP BY 1, 2)
SELECT g.household_id, g.goal, CAST(g.target_amount AS DOUBLE) AS target_amount, g.target_month, g.created_date,
       coalesce(u.c, g.completed) AS completed
FROM goals g LEFT JOIN upd u ON g.household_id = u.household_id AND g.goal = u.goal""", "goals")
