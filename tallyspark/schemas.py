"""Fixed schemas of the landed inputs. Nothing is inferred: an absent field reads as NULL."""

from __future__ import annotations

# Exact types of what is added up. Money and measured values keep every digit their sources
# give up to this scale, whatever way rows are partitioned; a wider scale is set here.
MONEY = "DECIMAL(24,6)"
MEASURE = "DECIMAL(28,10)"

ACCOUNTS = (
    "user STRING, name STRING, type STRING, systemStatus STRING, "
    f"currentBalance {MONEY}, availableBalance {MONEY}"
)

TRANSACTIONS = (
    f"user STRING, date STRING, description STRING, amount {MONEY}, type STRING, "
    "category STRUCT<name: STRING, parentName: STRING>, accountId STRING"
)

INVESTMENTS = (
    "user STRING, description STRING, initialTotalCost DOUBLE, currentValue DOUBLE, "
    "averagePricePaid DOUBLE, currentPrice DOUBLE"
)

BUDGETS = (
    "user STRING, budgetDate STRING, category STRUCT<name: STRING>, "
    f"amount {MONEY}, budgetAmount {MONEY}"
)

# One dataset for the task tracker; ``db`` tells the three document kinds apart.
DOCS = (
    "user STRING, db STRING, _id STRING, id STRING, title STRING, parentId STRING, "
    "day STRING, times ARRAY<BIGINT>, duration BIGINT, timeEstimate BIGINT, "
    "isPositive BOOLEAN, target DOUBLE, period STRING, history ARRAY<DOUBLE>"
)

ATTRIBUTE_PAGES = (
    "user STRING, page_no BIGINT, next STRING, "
    "results ARRAY<STRUCT<label: STRING, values: ARRAY<STRUCT<date: STRING, value: STRING>>>>"
)

SLEEP_XML = "_type STRING, _startDate STRING, _endDate STRING"
