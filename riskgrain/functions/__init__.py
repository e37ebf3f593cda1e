from .columns import (  # noqa: F401
    MISSING, as_column, ellipsoid_km, flag, hash_halves, hash_text, hash_unit, haversine_km, interval_ends,
    interval_label, key_date, month_key, number, or_missing, percent_text, ratio, shift_months,
)
from .evidence import entropy2, evidence, gini2  # noqa: F401
