"""Column functions: cleaning, parsing, keys, calendar and temporal rules."""

from .calendar import calendar_columns, date_range, end_of_day
from .clean import blank_to_null, fold_accents, lenient_int, normalize_state, parse_first, rule
from .keys import content_hash_column, salt, surrogate_key

__all__ = ["blank_to_null", "calendar_columns", "content_hash_column", "date_range", "end_of_day", "fold_accents", "lenient_int", "normalize_state", "parse_first", "rule", "salt", "surrogate_key"]
