from tallyspark.functions.clock import (
    circular_mean_seconds,
    clock_text,
    floor_minute,
    seconds_of_day,
)
from tallyspark.functions.expressions import (
    as_date,
    date_parts,
    days_in_month,
    distinct_small,
    exact_avg,
    exact_sum,
    half_even,
    iso_week,
    millis_to_date,
    money_text,
    month_start,
    not_in,
    shared_keys,
)

__all__ = [
    "as_date",
    "circular_mean_seconds",
    "clock_text",
    "date_parts",
    "days_in_month",
    "distinct_small",
    "exact_avg",
    "exact_sum",
    "floor_minute",
    "half_even",
    "iso_week",
    "millis_to_date",
    "money_text",
    "month_start",
    "not_in",
    "seconds_of_day",
    "shared_keys",
]
