"""Settings and fixed values shared by all operators."""

# ---------------------------------------------------------------------------
# Labels, thresholds and column lists that define the results.
# ---------------------------------------------------------------------------

CRITICAL = "🔴 CRITICAL"
HIGH = "🟡 HIGH"
MEDIUM = "🟠 MEDIUM"
LOW = "🟢 LOW"
RISK_LEVELS = (CRITICAL, HIGH, MEDIUM, LOW)

CRITICAL_FROM = 0.8
HIGH_FROM = 0.5
MEDIUM_FROM = 0.3
ALERT_FROM = 0.7
VERDICT_FROM = 0.5

# (label when substitutes exist, label when none exist)
ACTION_LABELS = (
    "📞 Contact customer - offer substitutes",
    "📞 Contact customer - notify potential delay",
)
SHORT_ACTION_LABELS = ("📞 Offer substitutes", "📞 Notify of potential delay")

NOTIFIED = "AI Call Generated ✅"
PENDING = "Pending"
NO_SUBSTITUTE = "None Found"
UNKNOWN = "UNKNOWN"

PLACEHOLDER_DATE = "1970-01-01"
DATE_COLUMNS = ("order_created_date", "requested_delivery_date", "picking_confirmed_date")

DEFAULT_ORDER_TIME = 140000
DEFAULT_ORDER_HOUR = 14
DEFAULT_SHORTAGE_RATE = 0.04
WEEKEND_FROM = 5  # ISO weekday: Friday, Saturday and Sunday count as weekend

TRAIN_SHARE = 0.8
SEED = 42

FEATURES = (
    "order_qty",
    "picking_picked_qty",
    "order_day_of_week",
    "order_day_of_month",
    "order_month",
    "order_quarter",
    "is_weekend",
    "lead_time_days",
    "order_hour",
    "product_shortage_rate",
    "product_avg_order_qty",
    "product_order_qty_std",
    "product_order_count",
    "customer_shortage_rate",
    "customer_total_order_qty",
    "customer_order_count",
    "customer_avg_lead_time",
    "customer_product_shortage_rate",
    "customer_product_order_count",
    "vendor_shortage_rate",
    "vendor_order_count",
    "plant_shortage_rate",
    "storage_shortage_rate",
    "replacement_frequency",
    "category_shortage_rate",
    "temp_condition_shortage_rate",
)
LABEL = "is_shortage"
KEYS = ("order_created_date", "order_number", "product_code", "customer_number")

# ---------------------------------------------------------------------------
# Physical settings.
# ---------------------------------------------------------------------------

# A lookup side is broadcast only when it is measured to have at most so many rows
# and bytes; beyond that the join is shuffled with hot keys salted.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64_000_000

# Rows of one key that go to one task of a shuffled join; a key with more is salted.
# Its fixed size keeps tasks alike when the data grow.
SLICE_ROWS = 1_000_000
# Keys that are salted at most. With more keys above SLICE_ROWS the slices grow, so
# that the table of hot keys stays small enough to broadcast.
MOST_HOT_KEYS = 65_536
# Keys that a summary of heavy hitters tracks; it misses no key that holds more than
# 3.5 / TRACKED_KEYS of all rows.
TRACKED_KEYS = 131_072
