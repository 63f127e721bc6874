"""Business constants.

FIXED VALUES — these must equal the source workload's values for the
results to agree. Do not change them to make a check pass.
"""

# Risk tier labels, in the order the tiering rule assigns them.
TIER_HIGH = "High Risk"
TIER_MEDIUM = "Medium Risk"
TIER_LOW = "Low Risk"

# Stand-in satisfaction for accounts that never rated a ticket.
NO_SCORE_DEFAULT = 99.0

# Percentiles (continuous, interpolated) behind the risk tiers.
SATISFACTION_LOW_PCT = 0.10
SATISFACTION_MID_PCT = 0.50
ESCALATION_HIGH_PCT = 0.90

# Separator of the per-account churn reason list.
REASON_SEPARATOR = ", "

# Ticket priorities in report order (others sort first, unranked).
PRIORITY_ORDER = ["urgent", "high", "medium", "low"]

# Days per month in realized revenue (mrr * days / 30.0).
DAYS_PER_MONTH = 30.0

# Row count of the top-features report.
TOP_FEATURES = 15

# Months per year in ARR estimates.
MONTHS_PER_YEAR = 12
