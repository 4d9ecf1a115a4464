"""SQL counterparts of the registered queries, stated over the given tables.

Written from the meaning of each query rather than from its DataFrame plan:
joins, DISTINCT counts and window functions where the plan uses masks and glued
aggregates. Shared building blocks are CTEs.
"""

from __future__ import annotations

from tallyspark.schemas import MEASURE, MONEY


def _exact(x: str, kind: str) -> str:
    """A value as the declared decimal; by its text, so that both engines see the same digits."""
    return f"CAST(CAST({x} AS VARCHAR) AS {kind})"


def _double(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DOUBLE)"


def _sum(x: str, where: str = "", kind: str = MONEY) -> str:
    """Exact sum; 0 without rows."""
    rows = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce({_double(f'sum({_exact(x, kind)}){rows}')}, 0)"


def _avg(x: str, where: str = "", kind: str = MONEY) -> str:
    """Exact mean; NULL without rows."""
    rows = f" FILTER (WHERE {where})" if where else ""
    total = _double(f"sum({_exact(x, kind)}){rows}")
    return f"{total} / CAST(nullif(count({x}){rows}, 0) AS DOUBLE)"


def _clock(seconds: str) -> str:
    return (
        f"lpad(CAST(({seconds}) // 3600 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST(({seconds}) % 3600 // 60 AS VARCHAR), 2, '0')"
    )


def _clock12(seconds: str) -> str:
    return (
        f"lpad(CAST((({seconds}) // 3600 + 11) % 12 + 1 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST(({seconds}) % 3600 // 60 AS VARCHAR), 2, '0')"
    )


def _circular(x: str) -> str:
    """Mean time of day in seconds: cut towards midnight after a microsecond's nudge."""
    angle = f"({x}) * 2 * pi() / 86400"
    mean = f"atan2(avg(sin({angle})), avg(cos({angle}))) * 86400 / (2 * pi())"
    return f"(CAST(trunc({mean} + sign({mean}) * 1e-6) AS BIGINT) + 86400) % 86400"


def _ymd(day: str) -> str:
    return (
        f"CAST(year({day}) AS BIGINT) AS year, CAST(month({day}) AS BIGINT) AS month, "
        f"CAST(day({day}) AS BIGINT) AS day"
    )


CTES = {
    "txn": """
        SELECT CAST(o_custkey % 50 AS VARCHAR) AS "user", CAST(o_orderdate AS DATE) AS date,
               o_orderstatus AS description, CAST(o_custkey AS VARCHAR) AS accountId,
               o_orderpriority AS name,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE -1 END
                 * (CAST(round(o_totalprice * 100) AS BIGINT) // 2000) / CAST(100 AS DOUBLE)
                 AS amount,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'credit' ELSE 'debit' END
                 AS type,
               CASE WHEN o_orderstatus = 'F' THEN 'Root' ELSE 'Spending' END AS parentName
        FROM orders""",
    "cat": """
        SELECT * FROM (VALUES ('income', 'paycheck', '1-URGENT'), ('income', 'bonus', '2-HIGH'),
            ('spending', 'groceries', '3-MEDIUM'), ('spending', 'housing', '4-NOT SPECIFIED'),
            ('saving', 'investments', '5-LOW')) AS t(meta_category, category, name)""",
    "daily": f"""
        SELECT "user", {_ymd("date")}, category, {_sum("amount")} AS total, date AS "timestamp"
        FROM txn JOIN cat USING (name) GROUP BY "user", date, category""",
    "budgets": """
        SELECT "user", CAST(date_trunc('month', date) AS DATE) AS budgetDate,
               CAST(sum(CAST(round(abs(amount) * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount,
               (sum(CAST(round(abs(amount) * 100) AS BIGINT)) // count(*)) / CAST(100 AS DOUBLE)
                 AS budgetAmount,
               name
        FROM txn GROUP BY 1, 2, name""",
    "current": """
        SELECT * FROM budgets b
        WHERE budgetDate = (SELECT max(budgetDate) FROM budgets x WHERE x."user" = b."user")""",
    "budget": f"""
        SELECT "user", category,
               CASE WHEN category = 'paycheck' THEN 1 ELSE -1 END * ({_sum("budgetAmount")})
                 AS budget
        FROM current JOIN cat USING (name) GROUP BY "user", category""",
    "accounts": """
        SELECT CAST(c_custkey % 50 AS VARCHAR) AS "user", c_name AS name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CreditAccount'
                    WHEN 'BUILDING' THEN 'BankAccount' WHEN 'FURNITURE' THEN 'CashAccount'
                    WHEN 'HOUSEHOLD' THEN 'InvestmentAccount' WHEN 'MACHINERY' THEN 'LoanAccount'
               END AS type,
               CASE WHEN c_acctbal > 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS systemStatus,
               c_acctbal AS currentBalance, c_acctbal AS availableBalance
        FROM customer""",
    "classified": """
        SELECT *, CASE WHEN type IN ('CreditAccount', 'BankAccount', 'CashAccount') THEN 'bank'
                       WHEN type = 'InvestmentAccount' THEN 'investment'
                       WHEN type = 'LoanAccount' THEN 'loan' ELSE 'other' END AS account_type
        FROM accounts""",
    "totals": f"""
        SELECT "user", account_type, {_sum("currentBalance")} AS total
        FROM classified WHERE systemStatus = 'ACTIVE' GROUP BY "user", account_type""",
    "monthly": f"""
        SELECT "user", year, month, category, {_sum("total")} AS total
        FROM daily GROUP BY "user", year, month, category""",
    # habits: the later of the two entries at the event's time, and one an hour later
    "history": """
        SELECT CAST(user_id AS VARCHAR) AS "user", event_type AS name,
               event_type <> 'error' AS positive, epoch_us(ts) // 1000 + 3600000 * k AS time_ms,
               value AS count,
               CASE event_type WHEN 'click' THEN 50.0 WHEN 'error' THEN 60.0
                    WHEN 'purchase' THEN 70.0 WHEN 'signup' THEN 80.0 ELSE 90.0 END AS target,
               CASE WHEN event_type = 'signup' THEN 'day' ELSE 'week' END AS period,
               CAST(ts + to_hours(k) AS DATE) AS day
        FROM events, (VALUES (0), (1)) AS h(k)""",
    "habit_week": f"""
        SELECT "user", name, positive, CAST(weekofyear(day) AS BIGINT) AS week_number,
               CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month,
               {_sum("count", kind=MEASURE)} AS value, {_avg("target", kind=MEASURE)} AS target
        FROM history WHERE period = 'week'
        GROUP BY "user", name, positive, weekofyear(day), year(day), month(day)""",
    "attributes": """
        SELECT CAST(user_id AS VARCHAR) AS "user", CAST(ts AS DATE) AS date,
               CASE event_type WHEN 'click' THEN 'productive_min' WHEN 'purchase' THEN 'sleep_start'
                    WHEN 'signup' THEN 'sleep_end' WHEN 'view' THEN 'mood' ELSE 'untracked'
               END AS attribute,
               CASE WHEN value >= 1 THEN value ELSE 0 END AS value
        FROM events""",
    "formatted": """
        SELECT "user", date, attribute, v AS value, CAST(target AS DOUBLE) AS target,
               CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
               CASE WHEN attribute IN ('sleep_start', 'sleep_end') THEN v <= target
                    ELSE v >= target END AS achieved
        FROM (SELECT "user", date, attribute, target,
                     CASE attribute WHEN 'sleep_start' THEN (value / 60 + 12) % 24
                          WHEN 'sleep_end' THEN value / 60 ELSE value END AS v
              FROM attributes JOIN (VALUES ('mood', 50.0), ('productive_min', 60.0),
                                           ('sleep_end', 1.0), ('sleep_start', 12.5))
                   AS t(attribute, target) USING (attribute)
              WHERE date <> DATE '2024-01-15')""",
    "rating": f"""
        SELECT "user", year, month, CAST(weekofyear(date) AS BIGINT) AS week_number,
               {_avg("value", kind=MEASURE)} AS value, {_avg("target", kind=MEASURE)} AS target,
               'Rating' AS name, true AS positive
        FROM formatted WHERE attribute = 'mood'
        GROUP BY "user", year, month, weekofyear(date)""",
    "nights": """
        SELECT DISTINCT "user", bedtime, wakeup,
               CAST(trunc((epoch_us(wakeup) - epoch_us(bedtime)) / 1000000) AS BIGINT)
                 AS duration_seconds
        FROM (SELECT "user", min(s) OVER night AS bedtime, max(e) OVER night AS wakeup
              FROM (SELECT CAST(user_id AS VARCHAR) AS "user", ts AS s,
                           ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS e FROM events)
              WINDOW night AS (PARTITION BY "user", CAST(e AS DATE)))
        WHERE hour(wakeup) NOT IN (0, 1, 2, 3, 22, 23)""",
    "sleep": """
        SELECT "user", CAST(year(wakeup) AS BIGINT) AS year, CAST(month(wakeup) AS BIGINT) AS month,
               CAST(weekofyear(wakeup) AS BIGINT) AS week_number, name,
               CAST(CASE name
                    WHEN 'Wake' THEN hour(wakeup) * 3600 + minute(wakeup) * 60
                    WHEN 'Bed' THEN hour(bedtime) * 3600 + minute(bedtime) * 60
                    ELSE duration_seconds % 86400 // 60 * 60 END AS BIGINT) AS tod_seconds,
               CAST(CASE name WHEN 'Wake' THEN 21600 WHEN 'Bed' THEN 79200 ELSE 30600 END AS BIGINT)
                 AS target_seconds,
               name = 'Duration' AS positive
        FROM nights, (VALUES ('Wake'), ('Bed'), ('Duration')) AS k(name)""",
    "scored": """
        SELECT "user", name, positive, year, month, week_number, value, target,
               CAST(NULL AS BIGINT) AS tod_seconds, CAST(NULL AS BIGINT) AS target_seconds
        FROM habit_week
        UNION ALL
        SELECT "user", name, positive, year, month, week_number, value, target, NULL, NULL
        FROM rating
        UNION ALL
        SELECT "user", name, positive, year, month, week_number, NULL, NULL,
               tod_seconds, target_seconds
        FROM sleep""",
    # tasks
    "tree": """
        SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title,
               CASE WHEN p_partkey // 10 = 0 THEN 'root' ELSE CAST(p_partkey // 10 AS VARCHAR) END
                 AS parentId
        FROM part WHERE p_partkey <> 0""",
    "paths": """
        SELECT _id AS node, title AS path, title AS category FROM tree WHERE parentId = 'root'
        UNION ALL
        SELECT t._id, t.title || '/' || p.path, p.category FROM paths p JOIN tree t
          ON t.parentId = p.node""",
    "docs": """
        SELECT CAST(l_suppkey % 50 AS VARCHAR) AS "user",
               CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS title,
               CASE WHEN l_returnflag = 'R' THEN 'unassigned'
                    ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day,
               CAST(l_partkey AS VARCHAR) AS parentId,
               CASE WHEN l_linenumber > 2 THEN CAST(l_shipdate AS DATE) END AS start_time,
               CASE WHEN l_linenumber > 2 THEN CAST(l_shipdate
                    + to_hours(CAST(l_quantity AS BIGINT)) AS DATE) END AS end_time,
               CASE WHEN l_linenumber > 1 THEN l_quantity END AS duration,
               CASE WHEN l_linenumber <> 3 THEN l_quantity / 2 END AS time_estimate
        FROM lineitem""",
    "tasks": """
        SELECT "user", title AS name, day, time_estimate, path AS parent, category,
               start_time, end_time, duration
        FROM docs JOIN paths ON parentId = node WHERE day <> 'unassigned'""",
    "format_tasks": """
        SELECT "user", name, CAST(day AS DATE) AS day, time_estimate, start_time, end_time, duration,
               CAST(year(CAST(day AS DATE)) AS BIGINT) AS year,
               CAST(month(CAST(day AS DATE)) AS BIGINT) AS month,
               CASE WHEN category IN (SELECT title FROM tree JOIN part
                                        ON _id = CAST(p_partkey AS VARCHAR)
                                      WHERE parentId = 'root' AND p_size >= 25)
                    THEN category ELSE split_part(parent, '/', 1) END AS category
        FROM tasks""",
}

NEEDS = {
    "daily": ("txn", "cat"),
    "budgets": ("txn",),
    "current": ("budgets",),
    "budget": ("current", "cat"),
    "classified": ("accounts",),
    "totals": ("classified",),
    "monthly": ("daily",),
    "habit_week": ("history",),
    "formatted": ("attributes",),
    "rating": ("formatted",),
    "sleep": ("nights",),
    "scored": ("habit_week", "rating", "sleep"),
    "paths": ("tree",),
    "tasks": ("docs", "paths"),
    "format_tasks": ("tasks",),
}


def _with(names: str, body: str) -> str:
    """Prefix a query with the CTEs it names and what those need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"


def _iso(*columns: str) -> str:
    """Dates as text, in place."""
    return ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)


DAILY_OUT = f'"user", year, month, day, category, total, {_iso("timestamp")}'


def _spend(where: str) -> str:
    """Monthly totals joined to the budget month by month, then summed."""
    return f"""
        SELECT "user", category, {_sum("total")} AS total, {_sum("coalesce(budget, 0)")} AS budget
        FROM monthly LEFT JOIN budget USING ("user", category)
        WHERE {where} GROUP BY "user", category
        HAVING abs({_sum("total")}) > 100 AND category NOT IN ('paycheck', 'investments', 'bonus')"""


IN_MONTH = "year = 1997 AND month = 5"
IN_QUARTER = "year = 1997 AND month IN (4, 5, 6)"
IN_YEAR = "year = 1997"


def _kpis(where: str) -> str:
    return f"""
        , flows AS (
            SELECT "user",
                   {_sum("total", "category NOT IN ('paycheck', 'investments', 'bonus')")} AS spending,
                   {_sum("total", "category IN ('paycheck', 'bonus')")} AS paycheck
            FROM daily WHERE {where} GROUP BY "user"),
        planned AS (SELECT "user", {_sum("budget")} AS budget FROM budget GROUP BY "user"),
        held AS (SELECT "user", max(total) FILTER (WHERE account_type = 'bank') AS bank,
                        max(total) FILTER (WHERE account_type = 'investment') AS investment
                 FROM totals GROUP BY "user"),
        users AS (SELECT "user" FROM flows UNION SELECT "user" FROM planned
                  UNION SELECT "user" FROM held),
        wide AS (SELECT "user", bank, investment, coalesce(paycheck, 0) AS paycheck,
                        coalesce(spending, 0) AS spending, coalesce(budget, 0) AS budget
                 FROM users LEFT JOIN flows USING ("user") LEFT JOIN planned USING ("user")
                 LEFT JOIN held USING ("user")),
        long AS (
            SELECT "user", 'bank' AS variable, bank AS v FROM wide
            UNION ALL SELECT "user", 'investment', investment FROM wide
            UNION ALL SELECT "user", 'paycheck', paycheck FROM wide
            UNION ALL SELECT "user", 'spending', spending FROM wide
            UNION ALL SELECT "user", 'budget', budget FROM wide
            UNION ALL SELECT "user", 'delta', budget - abs(spending) FROM wide
            UNION ALL SELECT "user", 'savings', paycheck + spending FROM wide)
        {_KPI_OUT}"""


_KPI_OUT = """
        SELECT "user", variable, round_even(v / 10, 0) * 10 AS value,
               CASE WHEN v < 0 AND round_even(v / 10, 0) = 0 THEN '$-0' WHEN v IS NOT NULL THEN
                 '$' || format('{:,}', CAST(round_even(v / 10, 0) * 10 AS BIGINT)) END AS total
        FROM long"""


def _scorecard(where: str) -> str:
    """Habits, rating and sleep as separate aggregates, unioned."""
    return f"""
        , picked AS (SELECT * FROM scored WHERE {where}),
        weeks AS (SELECT "user", count(DISTINCT week_number) AS n FROM picked GROUP BY "user"),
        card AS (
            SELECT "user", name, positive, 'habit' AS kind,
                   {_sum("value", kind=MEASURE)} AS value,
                   ({_avg("target", kind=MEASURE)}) * any_value(n) AS target,
                   CAST(NULL AS BIGINT) AS tod_seconds, CAST(NULL AS BIGINT) AS target_seconds
            FROM picked JOIN weeks USING ("user")
            WHERE name NOT IN ('Wake', 'Bed', 'Duration', 'Rating')
            GROUP BY "user", name, positive
            UNION ALL
            SELECT "user", name, positive, 'rating',
                   round_even(({_avg("value", kind=MEASURE)}) * 100, 0) / 100,
                   {_avg("target", kind=MEASURE)}, NULL, NULL
            FROM picked WHERE name = 'Rating' GROUP BY "user", name, positive
            UNION ALL
            SELECT "user", name, positive, 'sleep', NULL, NULL, {_circular("tod_seconds")},
                   target_seconds
            FROM picked WHERE name IN ('Wake', 'Bed') GROUP BY "user", name, positive, target_seconds
            UNION ALL
            SELECT "user", name, positive, 'sleep', NULL, NULL,
                   CAST(floor(avg(tod_seconds)) AS BIGINT), target_seconds
            FROM picked WHERE name = 'Duration' GROUP BY "user", name, positive, target_seconds)"""


# Seconds are missing for habits and ratings; a nullable number travels as DOUBLE.
SECONDS_AS_DOUBLE = """CAST(tod_seconds AS DOUBLE) AS tod_seconds,
    CAST(target_seconds AS DOUBLE) AS target_seconds"""
IN_WEEK_2 = "year = 2024 AND week_number = 2"
SLEEP_VALUES = f"""
        , mean AS (
            SELECT "user", name, target_seconds, positive, {_circular("tod_seconds")} AS tod_seconds
            FROM sleep WHERE name <> 'Duration' GROUP BY "user", name, target_seconds, positive
            UNION ALL
            SELECT "user", name, target_seconds, positive, CAST(floor(avg(tod_seconds)) AS BIGINT)
            FROM sleep WHERE name = 'Duration' GROUP BY "user", name, target_seconds, positive)"""

FLOWS = f"""
        , flows AS (
            SELECT "user", year, month, make_date(year, month, 1) AS datetime,
                   CASE WHEN count(*) FILTER (WHERE category NOT IN ('bonus', 'investments')) > 0
                        THEN {_sum("total", "category NOT IN ('bonus', 'investments')")} END AS net,
                   CASE WHEN count(*) FILTER (WHERE category NOT IN ('paycheck', 'bonus')) > 0
                        THEN {_sum("total", "category NOT IN ('paycheck', 'bonus')")} END AS spend,
                   {_sum("total", "category = 'paycheck'")} AS income
            FROM daily WHERE year >= 1997 OR (year = 1996 AND month = 12)
            GROUP BY "user", year, month)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # inputs
    sql["read_accounts"] = _with("accounts", "SELECT * FROM accounts")
    sql["read_transactions"] = _with(
        "txn",
        f'SELECT "user", {_iso("date")}, description, amount, type, accountId, name, parentName '
        "FROM txn",
    )
    sql["read_investments"] = """
        SELECT p_brand AS "user", p_name AS description, p_retailprice * p_size AS initialTotalCost,
               p_retailprice * 2 AS currentValue, p_retailprice AS averagePricePaid,
               p_retailprice AS currentPrice FROM part"""
    twice = " , (VALUES (1), (2)) AS copies(k) WHERE k = 1 OR name = '5-LOW'"
    sql["read_budgets"] = _with(
        "budgets",
        f'SELECT "user", {_iso("budgetDate")}, amount, budgetAmount, name FROM budgets{twice}',
    )
    sql["select_docs"] = _with("tree", "SELECT _id, parentId, title FROM tree")
    label = """CASE event_type WHEN 'click' THEN 'Productive min' WHEN 'purchase' THEN 'Bedtime'
               WHEN 'signup' THEN 'Wake time' WHEN 'view' THEN 'Mood' ELSE 'Untracked' END"""
    sql["read_attributes"] = f"""
        SELECT CAST(user_id AS VARCHAR) AS "user", CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
               value, {label} AS attribute
        FROM events, (VALUES (1), (2)) AS copies(k) WHERE k = 1 OR value >= 10"""
    sql["latest_attribute_values"] = f"""
        SELECT CAST(user_id AS VARCHAR) AS "user", {label} AS attribute,
               first(value ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS value
        FROM events GROUP BY 1, 2"""
    sql["read_sleep_xml"] = """
        SELECT 'owner' AS "user", strftime(s, '%Y-%m-%d %H:%M:%S') AS sleep_start,
               strftime(e, '%Y-%m-%d %H:%M:%S') AS sleep_end,
               strftime(s, '%Y-%m-%d %H:%M:%S') AS start_wall,
               strftime(e, '%Y-%m-%d %H:%M:%S') AS end_wall
        FROM (SELECT ts AS s, ts + INTERVAL 90 MINUTE AS e FROM events WHERE event_type <> 'click')"""
    sql["month_calendar"] = _with(
        "txn",
        """, spans AS (SELECT "user", date_trunc('month', min(date)) AS first,
                  CAST(ceil((max(date) - CAST(date_trunc('month', min(date)) AS DATE)) / 30.436875)
                    AS BIGINT) AS n FROM txn GROUP BY "user")
           SELECT "user", CAST(last_day(first + to_months(CAST(i AS INTEGER))) AS VARCHAR)
                    AS month_end,
                  CAST(day(last_day(first + to_months(CAST(i AS INTEGER)))) AS BIGINT) AS days
           FROM (SELECT "user", first, unnest(range(n)) AS i FROM spans)""",
    )
    sql["config_dims"] = """
        SELECT DISTINCT 'owner' AS "user", lower(p_type) AS meta_category, p_type AS category,
               p_brand AS name FROM part"""
    sql["habit_targets"] = """
        SELECT 'owner' AS "user", p_type AS attribute, max(p_retailprice) AS target
        FROM part GROUP BY p_type"""
    sql["task_rollup_set"] = """SELECT DISTINCT 'owner' AS "user", p_type AS category FROM part"""
    sql["write_snapshot"] = _with(
        "totals",
        """SELECT "user", account_type, total, snapshot_date FROM totals,
           (VALUES ('2024-01-01'), ('2024-01-02')) AS d(snapshot_date)""",
    )
    sql["latest_snapshot"] = _with("totals", "SELECT * FROM totals")
    sql["latest_snapshot_of_user"] = _with("totals", """SELECT * FROM totals WHERE "user" = '7' """)
    sql["retention_plan"] = _with(
        "budget totals",
        f""", listed AS (SELECT DISTINCT 'monthly_budget' AS dataset, "user" FROM budget
                UNION ALL SELECT DISTINCT 'account_totals', "user" FROM totals),
            refreshed AS (SELECT DISTINCT 'monthly_budget' AS dataset, "user" FROM budget
                UNION ALL SELECT 'account_totals', "user" FROM totals GROUP BY "user"
                HAVING {_sum("total")} > 100000)
            SELECT dataset, "user", '2024-01-01' AS snapshot_date FROM listed
            WHERE "user" IN (SELECT "user" FROM (SELECT "user", count(*) AS n FROM listed GROUP BY 1)
                JOIN (SELECT "user", count(*) AS n FROM refreshed GROUP BY 1) USING ("user", n))""",
    )
    sql["all_users"] = _with(
        "txn cat",
        f"""SELECT description AS "user", {_ymd("date")}, category, {_sum("amount")} AS total,
                   CAST(date AS VARCHAR) AS "timestamp"
            FROM txn JOIN cat USING (name) GROUP BY description, date, category""",
    )

    # ledger
    sql["root_parent_fill"] = _with(
        "txn",
        """SELECT "user", CASE WHEN parentName = 'Root' THEN name ELSE parentName END AS parentName,
                  count(*) AS n FROM txn GROUP BY 1, 2""",
    )
    sql["classify_accounts"] = _with(
        "classified", 'SELECT "user", name, type, account_type FROM classified'
    )
    sql["category_dim"] = _with(
        "txn cat",
        f"""SELECT "user", meta_category, count(*) AS n, {_sum("amount")} AS total
            FROM txn JOIN cat USING (name) GROUP BY 1, 2""",
    )
    sql["daily_finances"] = _with("daily", f"SELECT {DAILY_OUT} FROM daily")
    sql["current_budgets"] = _with(
        "current", f'SELECT "user", {_iso("budgetDate")}, amount, budgetAmount, name FROM current'
    )
    sql["monthly_budget"] = _with("budget", "SELECT * FROM budget")
    sql["account_totals"] = _with("totals", "SELECT * FROM totals")
    sql["budget_by_user"] = _with(
        "budget", f'SELECT "user", {_sum("budget")} AS budget FROM budget GROUP BY "user"'
    )

    # periods and predicates
    sql["period_week"] = _with("habit_week", f"SELECT * FROM habit_week WHERE {IN_WEEK_2}")
    for name, where in (
        ("period_iso_week", "\"timestamp\" BETWEEN DATE '1996-12-30' AND DATE '1997-01-05'"),
        ("period_month", IN_MONTH),
        ("period_quarter", IN_QUARTER),
        ("period_year", IN_YEAR),
    ):
        sql[name] = _with("daily", f"SELECT {DAILY_OUT} FROM daily WHERE {where}")
    sql["category_not_in"] = _with(
        "txn cat",
        """SELECT "user", category, count(*) AS n
           FROM txn LEFT JOIN (SELECT name, category FROM cat WHERE category <> 'housing')
             USING (name)
           WHERE category IS NULL OR category NOT IN ('bonus', 'investments') GROUP BY 1, 2""",
    )

    # spending
    sql["month_sum"] = _with(
        "daily",
        f"""SELECT "user", year, month, {_sum("total")} AS total, CAST(1 AS BIGINT) AS day,
                   CAST(make_date(year, month, 1) AS VARCHAR) AS datetime
            FROM daily WHERE category NOT IN ('bonus', 'investments') GROUP BY "user", year, month""",
    )
    for name, where in (
        ("week", IN_MONTH),
        ("month", IN_MONTH),
        ("quarter", IN_QUARTER),
        ("year", IN_YEAR),
    ):
        sql[f"spend_vs_budget_{name}"] = _with("monthly budget", _spend(where))
    sql["budget_variance"] = _with(
        "monthly budget",
        f"""SELECT *, -(total - budget) AS diff,
                   CASE WHEN -(total - budget) < 0 THEN 'Under-Budget' ELSE 'Over-Budget' END
                     AS positive FROM ({_spend(IN_YEAR)})""",
    )
    sql["spend_budget_long"] = _with(
        "monthly budget",
        f""", spent AS ({_spend(IN_QUARTER)})
            SELECT "user", category, 'total' AS variable, total AS value FROM spent
            UNION ALL SELECT "user", category, 'budget', budget FROM spent""",
    )
    sql["monthly_income"] = _with(
        "daily accounts",
        f"""SELECT "user", {_sum("total", f"{IN_MONTH} AND category = 'paycheck'")} AS income
            FROM (SELECT DISTINCT "user" FROM accounts) LEFT JOIN daily USING ("user")
            GROUP BY "user" """,
    )
    sql["budget_shortfall"] = _with(
        "daily",
        f""", spend AS (SELECT "user", year, month, {_sum("total")} AS total FROM daily
                WHERE year >= 1997 AND category NOT IN ('paycheck', 'bonus')
                GROUP BY "user", year, month),
            mean AS (SELECT "user", {_avg("total")} AS m FROM spend GROUP BY "user"),
            earned AS (SELECT "user", {_sum("total")} AS income FROM daily
                WHERE year = 1999 AND month = 5 AND category = 'paycheck' GROUP BY "user")
            SELECT "user", m + coalesce(income, 0) - 100 AS shortfall
            FROM (SELECT DISTINCT "user" FROM daily WHERE year >= 1997) LEFT JOIN mean USING ("user")
            LEFT JOIN earned USING ("user")""",
    )
    sql["avg_monthly_by_category"] = _with(
        "monthly",
        f"""SELECT "user", category, {_avg("total")} AS total FROM monthly WHERE year >= 1997
            GROUP BY "user", category""",
    )
    sql["avg_past_months_by_category"] = _with(
        "monthly",
        f"""SELECT "user", category, {_avg("total")} AS total FROM monthly
            WHERE year >= 1997 AND NOT (year = 2001 AND month = 7) GROUP BY "user", category""",
    )
    sql["saving_mix"] = _with(
        "monthly",
        f""", means AS (SELECT "user", category, {_avg("total")} AS total FROM monthly
                WHERE year >= 1997 AND NOT (year = 2001 AND month = 7) GROUP BY "user", category),
            nets AS (SELECT "user", year, month, {_sum("total")} AS total FROM monthly
                WHERE year >= 1997 AND category NOT IN ('bonus', 'investments')
                GROUP BY "user", year, month),
            net AS (SELECT "user", ({_sum("total")}) / count(*) AS total FROM nets GROUP BY "user")
            SELECT "user", category, abs(CASE WHEN category = 'housing' THEN -150 ELSE total END)
                     AS total
            FROM means WHERE category NOT IN ('bonus', 'loans', 'music', 'paycheck')
            UNION ALL
            SELECT "user", 'savings', abs(net.total + (-150 - coalesce(h.total, 0)))
            FROM net LEFT JOIN (SELECT * FROM means WHERE category = 'housing') h USING ("user")""",
    )
    sql["account_pivot"] = _with(
        "totals",
        """SELECT "user", max(total) FILTER (WHERE account_type = 'bank') AS bank,
                  max(total) FILTER (WHERE account_type = 'investment') AS investment,
                  max(total) FILTER (WHERE account_type = 'loan') AS loan
           FROM totals GROUP BY "user" """,
    )
    sql["account_kpis"] = _with("daily budget totals", _kpis(IN_MONTH))
    sql["account_kpis_year"] = _with("daily budget totals", _kpis(IN_YEAR))
    sql["account_kpis_v1"] = _with(
        "monthly accounts",
        f""", kinds AS (SELECT "user", {_sum("currentBalance")} AS total,
                  CASE type WHEN 'CreditAccount' THEN 'credit' WHEN 'BankAccount' THEN 'cash'
                    WHEN 'CashAccount' THEN 'cash' ELSE type END AS kind
                FROM accounts WHERE systemStatus = 'ACTIVE' GROUP BY "user", kind),
            held AS (SELECT "user", max(total) FILTER (WHERE kind = 'cash') AS cash,
                  coalesce(max(total) FILTER (WHERE kind = 'credit'), 0) AS credit,
                  max(total) FILTER (WHERE kind = 'InvestmentAccount') AS investment
                FROM kinds GROUP BY "user"),
            mean AS (SELECT "user", category, {_avg("total")} AS total FROM monthly
                WHERE year >= 1997 GROUP BY "user", category),
            flow AS (SELECT "user", max(total) FILTER (WHERE category = 'paycheck') AS income,
                  max(total) FILTER (WHERE category = 'investments') AS investments,
                  coalesce(max(total) FILTER (WHERE category = 'groceries'), 0) AS spending
                FROM mean GROUP BY "user"),
            wide AS (SELECT "user", cash + credit AS bank, investment, income, spending,
                  CAST(-150 AS DOUBLE) AS housing, investments,
                  (-150 + spending + investments) * 6 * -1 AS reserve
                FROM held FULL JOIN flow USING ("user")),
            long AS (
                SELECT "user", 'bank' AS variable, bank AS v FROM wide
                UNION ALL SELECT "user", 'investment', investment FROM wide
                UNION ALL SELECT "user", 'cash savings', reserve FROM wide
                UNION ALL SELECT "user", 'excess savings', bank - reserve FROM wide
                UNION ALL SELECT "user", 'income', income FROM wide
                UNION ALL SELECT "user", 'spending', spending FROM wide
                UNION ALL SELECT "user", 'housing', housing FROM wide
                UNION ALL SELECT "user", 'savings', income + spending + investments + housing
                  FROM wide
                UNION ALL SELECT "user", 'investments', investments FROM wide)
            {_KPI_OUT}""",
    )
    sql["savings_series"] = _with(
        "daily",
        FLOWS
        + f""", shown AS (SELECT * FROM flows WHERE net IS NOT NULL AND year >= 1997),
            span AS (SELECT "user", min(datetime) AS first_date, max(datetime) AS last_date,
                       quantile_cont(datediff('day', DATE '1970-01-01', datetime), 0.5) AS mid,
                       max(net) * 1.1 AS label_height FROM shown GROUP BY "user"),
            mean AS (SELECT "user", {_avg("spend")} AS m FROM flows WHERE year >= 1997
                     GROUP BY "user"),
            result AS (
              SELECT s."user", s.year, s.month, s.datetime, s.net AS total,
                     CAST(100 AS DOUBLE) AS target, m + coalesce(f.income, 0) - 100 AS shortfall,
                     first_date, last_date,
                     DATE '1970-01-01' + CAST(floor(mid) AS INTEGER) AS median_date, label_height
              FROM shown s JOIN span USING ("user") JOIN mean USING ("user")
              LEFT JOIN flows f ON f."user" = s."user"
                AND f.datetime = CAST(last_date - INTERVAL 1 MONTH AS DATE))
            SELECT "user", year, month, {_iso("datetime", "first_date", "last_date", "median_date")},
                   total, target, shortfall, label_height,
                   CAST(round_even(shortfall / 10, 0) * 10 AS BIGINT) AS shortfall_tens
            FROM result""",
    )
    sql["spending_series"] = _with(
        "daily",
        FLOWS
        + f""", shown AS (SELECT * FROM flows WHERE spend IS NOT NULL AND year >= 1997),
            mean AS (SELECT "user", {_avg("spend")} AS m,
                       CAST(max(datetime) - INTERVAL 1 MONTH AS DATE) AS before
                     FROM shown GROUP BY "user"),
            aim AS (SELECT "user", m, -(coalesce(income, 0) - 100) AS target
                    FROM mean LEFT JOIN flows USING ("user") WHERE datetime = before
                    UNION ALL
                    SELECT "user", m, CAST(100 AS DOUBLE) FROM mean WHERE NOT EXISTS
                      (SELECT 1 FROM flows f WHERE f."user" = mean."user" AND f.datetime = before))
            SELECT "user", year, month, {_iso("datetime")}, spend AS total, target,
                   m - target AS mean_diff
            FROM shown JOIN aim USING ("user")""",
    )
    sql["quarterly_profit_loss"] = _with(
        "daily",
        f"""SELECT "user", year, q AS quarter, total, q * 3 - 2 AS month,
                   CAST(make_date(year, q * 3 - 2, 1) AS VARCHAR) AS datetime
            FROM (SELECT "user", year, CAST(quarter("timestamp") AS BIGINT) AS q,
                         {_sum("total")} AS total
                  FROM daily WHERE category <> 'bonus' GROUP BY "user", year, q)""",
    )
    sql["forward_stats"] = _with(
        "monthly",
        f""", m AS (SELECT "user", year, month, {_sum("total")} AS total FROM monthly
                WHERE category <> 'bonus' GROUP BY "user", year, month)
            SELECT "user", 'mean' AS variable, {_avg("total")} AS profit FROM m GROUP BY "user"
            UNION ALL
            SELECT "user", '25%', round(quantile_cont(total, 0.25), 4) FROM m GROUP BY "user" """,
    )

    def stats(name: str, where: str) -> str:
        return f"""{name}_m AS (SELECT "user", year, month, {_sum("total")} AS total FROM monthly
                WHERE year >= 1997 AND {where} GROUP BY "user", year, month),
            {name}_s AS (
                SELECT "user", 'mean' AS variable, {_avg("total")} AS {name}
                FROM {name}_m GROUP BY "user"
                UNION ALL
                SELECT "user", '25%', round(quantile_cont(total, 0.25), 4)
                FROM {name}_m GROUP BY "user")"""

    sql["forward_budget"] = _with(
        "monthly",
        f""", {stats("spending", "category NOT IN ('paycheck', 'bonus')")},
            {stats("income", "category = 'paycheck'")},
            {stats("profit", "category <> 'bonus'")}
            SELECT * FROM spending_s JOIN income_s USING ("user", variable)
            JOIN profit_s USING ("user", variable)""",
    )

    # habits, attributes, sleep, scorecard
    sql["habit_history"] = _with(
        "history",
        """SELECT "user", CAST(day AS VARCHAR) AS "timestamp", time_ms, count, name AS id, name,
                  positive, target, period, CAST(weekofyear(day) AS BIGINT) AS week_number
           FROM history""",
    )
    sql["habit_week"] = _with("habit_week", "SELECT * FROM habit_week")
    sql["format_attributes"] = _with(
        "formatted",
        f"""SELECT "user", {_iso("date")}, attribute, round(value, 6) AS value, target, year, month,
                   achieved FROM formatted""",
    )
    sql["weekly_rating"] = _with("rating", "SELECT * FROM rating")
    achieved = """SELECT "user", attribute, CAST(count(*) FILTER (WHERE achieved) AS BIGINT)
           AS achieved, CAST({days} AS BIGINT) AS month_days
           FROM formatted WHERE year = 2024 AND month = 1 GROUP BY "user", attribute"""
    sql["habit_achievement"] = _with("formatted", achieved.format(days=31))
    sql["habit_achievement_running"] = _with("formatted", achieved.format(days=14))
    sql["sleep_nights"] = _with(
        "nights",
        """SELECT "user", CAST(year(wakeup) AS BIGINT) AS year,
                  CAST(month(wakeup) AS BIGINT) AS month, CAST(weekofyear(wakeup) AS BIGINT) AS week,
                  strftime(bedtime, '%Y-%m-%d %H:%M:%S') AS bedtime,
                  strftime(wakeup, '%Y-%m-%d %H:%M:%S') AS wakeup, duration_seconds FROM nights""",
    )
    sql["format_sleep"] = _with("sleep", "SELECT * FROM sleep")
    sql["avg_time_of_day"] = _with(
        "sleep",
        SLEEP_VALUES
        + f"""SELECT "user", name, tod_seconds, {_clock("tod_seconds")} AS value
              FROM mean WHERE name <> 'Duration'""",
    )
    sql["avg_duration"] = _with(
        "sleep",
        SLEEP_VALUES
        + f"""SELECT "user", tod_seconds, {_clock("tod_seconds")} AS value
              FROM mean WHERE name = 'Duration'""",
    )
    sql["avg_sleep"] = _with(
        "sleep", SLEEP_VALUES + f"""SELECT *, {_clock("tod_seconds")} AS value FROM mean"""
    )
    sql["scored_rows"] = _with(
        "scored", f"SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM scored"
    )
    sql["distinct_weeks"] = _with(
        "scored",
        """SELECT "user", count(DISTINCT week_number) AS week_count FROM scored GROUP BY "user" """,
    )
    sql["scorecard_base"] = _with(
        "scored", _scorecard("year = 2024 AND month = 1") + f" SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM card"
    )
    sql["scorecard_week"] = _with("scored", _scorecard(IN_WEEK_2) + f" SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM card")
    sql["scorecard_quarter"] = _with(
        "scored", _scorecard("year = 2024 AND month BETWEEN 1 AND 3") + f" SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM card"
    )
    sql["scorecard_year"] = _with("scored", _scorecard("year = 2024") + f" SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM card")
    sql["scorecard_success"] = _with(
        "scored",
        _scorecard(IN_WEEK_2)
        + f""" SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM card WHERE kind <> 'sleep'
              AND CASE WHEN positive THEN value >= target ELSE value <= target END""",
    )
    sql["scorecard_fail"] = _with(
        "scored",
        _scorecard(IN_WEEK_2)
        + f""" SELECT * REPLACE ({SECONDS_AS_DOUBLE}) FROM card WHERE kind <> 'sleep'
              AND CASE WHEN positive THEN value < target ELSE value > target END""",
    )
    sql["supporting_table"] = _with(
        "scored",
        _scorecard(IN_WEEK_2)
        + f""" SELECT "user", name, {_clock12("tod_seconds")} || CASE WHEN name = 'Duration' THEN ''
                 WHEN tod_seconds < 43200 THEN ' AM' ELSE ' PM' END AS value, tod_seconds
              FROM card WHERE kind = 'sleep'""",
    )

    # tasks
    sql["task_duration"] = _with(
        "docs",
        f'SELECT "user", title, {_iso("start_time", "end_time")}, duration FROM docs',
    )
    sql["category_path"] = _with("paths", "SELECT * FROM paths")
    sql["task_table"] = _with(
        "tasks",
        f"""SELECT "user", name, day, time_estimate, parent, category,
                   {_iso("start_time", "end_time")}, duration FROM tasks""",
    )
    sql["format_tasks"] = _with(
        "format_tasks",
        f"""SELECT "user", name, {_iso("day", "start_time", "end_time")}, time_estimate, duration,
                   year, month, category FROM format_tasks""",
    )
    sql["task_time_by_category"] = _with(
        "format_tasks",
        """SELECT "user", category, year, month, sum(duration) AS duration FROM format_tasks
           WHERE year = 1998 AND month = 7 GROUP BY "user", category, year, month
           HAVING sum(duration) > 40""",
    )

    # scalar functions
    sql["date_functions"] = f"""
        SELECT o_orderkey, {_ymd("d")}, CAST(quarter(d) AS BIGINT) AS quarter,
               CAST(weekofyear(d) AS BIGINT) AS iso_week,
               CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start,
               CAST(day(last_day(d)) AS BIGINT) AS days_in_month,
               CAST(datediff('day', d, DATE '2002-01-01') AS BIGINT) AS age_days
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
    sql["clock_functions"] = f"""
        SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, s AS seconds,
               s - s % 60 AS minute_seconds, strftime(ts, '%H:%M') AS clock_24,
               strftime(ts, '%I:%M %p') AS clock_12, strftime(ts, '%I:%M') AS clock_12_bare,
               CAST(CAST(ts AS DATE) AS VARCHAR) AS local_date
        FROM (SELECT *, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS s
              FROM events)"""
    sql["rounding_functions"] = """
        SELECT c_custkey, round_even(c_custkey * 5 / 10, 0) * 10 AS tens,
               round_even(c_custkey / 8 * 100, 0) / 100 AS hundredths,
               CASE WHEN c_acctbal < 0 AND round_even(c_acctbal / 10, 0) = 0 THEN '$-0' ELSE
               '$' || format('{:,}', CAST(round_even(c_acctbal / 10, 0) * 10 AS BIGINT)) END AS money,
               abs(c_acctbal) AS magnitude
        FROM customer"""
    sql["text_functions"] = """
        SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS normalised, p_type AS nearest,
               p_name AS topmost FROM part"""
    return sql
