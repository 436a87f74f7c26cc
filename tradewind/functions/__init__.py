"""Column-expression helpers shared by every operator."""

from .dates import (AsOf, after_days_ago, between_now_and, date_between, lit_date, month_diff,
                    month_floor, month_index, month_window, month_window_dates, months_from, on_or_before_now)
from .rules import apply_rules
from .text import (MONEY, concat_skip_null, historic_season, is_blank, like_any, row_sum, safe_int,
                   season_half_fall_first, season_half_spring_first, season_order, season_year,
                   season_year_text, starts_with, two_digit)

__all__ = [
    "AsOf", "after_days_ago", "between_now_and", "date_between", "lit_date", "month_diff",
    "month_floor", "month_index", "month_window", "month_window_dates", "months_from", "on_or_before_now",
    "apply_rules", "MONEY", "concat_skip_null", "historic_season", "is_blank",
    "like_any", "row_sum", "safe_int", "season_half_fall_first", "season_half_spring_first",
    "season_order", "season_year", "season_year_text", "starts_with", "two_digit",
]
