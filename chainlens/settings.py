"""Thresholds and lookup values.

FIXED VALUES: these must equal the behaviour being reproduced, so they are
stated here plainly, in natural order, in one place.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
# Lead-time bands in days: excellent d <= 3, good 3 < d <= 7, poor d > 7.
# The configured 'poor' value (14) is not used for banding; it is the alert
# threshold for long lead times.
LEAD_TIME_THRESHOLDS = {"excellent": 3, "good": 7, "poor": 14}
# Fill-rate bands: excellent >= 0.95, good 0.85 <= x < 0.95, poor < 0.85.
FILL_RATE_THRESHOLDS = {"excellent": 0.95, "good": 0.85, "poor": 0.75}
# A lead / cycle time counts as valid when 0 <= days <= 30 (both inclusive).
VALID_LEAD_TIME_MIN = 0
VALID_LEAD_TIME_MAX = 30
# Alerts.
HIGH_LEAD_TIME_DAYS = 14
MISSING_DATA_ALERT_THRESHOLD = 0.05
INVENTORY_ALERT_THRESHOLD = 0.1  # share of the product's maximum stock level
# Per-category return probabilities and the default for unlisted categories.
RETURN_RATES = {"Furniture": 0.15, "Office Supplies": 0.05, "Technology": 0.10}
DEFAULT_RETURN_RATE = 0.05
# Required columns of the order sheet and of the order API feed.
REQUIRED_ORDER_COLUMNS_SHEET = ["Order ID", "Order Date", "Ship Date", "Customer ID", "Product ID"]
REQUIRED_ORDER_COLUMNS_API = ["Order ID", "Order Date", "Customer ID", "Product ID"]
# Histogram of lead times: at most this many bins.
HISTOGRAM_BINS = 20
# --- end of fixed values ----------------------------------------------------

# Rounding used for non-money doubles (means of ratios, standard deviations,
# percentiles) so results do not depend on summation order.
RATIO_DECIMALS = 6
# Money is summed exactly as DECIMAL(28, MONEY_SCALE): digits below a cent count.
# Sums that are multiplied by row counts keep WEIGHTED_SCALE digits.  Only the
# final value is rounded, to MONEY_DECIMALS.
MONEY_SCALE = 8
WEIGHTED_SCALE = 6
MONEY_DECIMALS = 4
