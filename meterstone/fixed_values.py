"""Fixed values. They must equal the ones the analysed platform uses, so results can match."""

from decimal import Decimal

# Usage services and the price class of each. Prices are dollars per credit.
SERVICE_PRICE_CLASS = {
    "ai_functions": "standard",
    "analyst": "standard",
    "search": "standard",
    "intelligence": "ai",
    "agents": "ai",
    "code_cli": "ai",
    "code_web": "ai",
}
DEFAULT_RATES = {"standard": Decimal("3.40"), "ai": Decimal("2.00")}

# Defaults of the periodic spend checks.
DEFAULT_MONTHLY_LIMIT = Decimal("100")
DEFAULT_SPEND_THRESHOLD = Decimal("1000")
DEFAULT_RUNAWAY_CREDITS = Decimal("50")
DEFAULT_NOTIFY_PERCENT = 80
DEFAULT_REVOKE_PERCENT = 100
LIMIT_REASON = "Monthly limit exceeded"
SPEND_ALERT_NAME = "monthly_spend"

# Texts of verdicts and messages. Braces mark the parts filled in.
ALERT_ALREADY_SENT = "Alert already sent for this month"
ALERT_NOT_EXCEEDED = "Threshold not exceeded. Current: {} / {}"
ALERT_SENT = "Alert sent. Credits: {}"
ALERT_SUBJECT = "AI Functions Monthly Spend Alert"
ALERT_BODY = (
    "Monthly AI Function credit consumption has exceeded the threshold.\n\n"
    "Current spend: {} credits\nThreshold: {} credits"
)
ACCESS_GRANTED = "Access granted to {} with limit {} credits"
RUNAWAY_SUBJECT = "Runaway AI Query Cancelled - {}"
RUNAWAY_BODY = (
    "Query cancelled due to excessive cost.\nQuery ID: {}\nUser: {}\nFunction: {}\nModel: {}\nCredits: {}\nStart Time: {}"
)
UNKNOWN_USER = "Unknown"

# Names and failure texts of the health report.
HEALTH_PAID_PACKAGES = ("Paid packages enabled", "FAIL - COST ALERT")
HEALTH_PAID_RUNS = ("Paid scanner runs (last 30d)", "FAIL - UNEXPECTED ACTIVITY")
HEALTH_FREE_PACKAGE = ("Security Essentials active", "WARN - CHECK SE")

# Scanner packages: the free one cannot be switched off.
FREE_PACKAGE_ID = "SECURITY_ESSENTIALS"
FREE_PACKAGE_NAME = "Security Essentials"
CIS_PACKAGE_ID = "CIS_BENCHMARKS"
THREAT_PACKAGE_ID = "THREAT_INTELLIGENCE"
FREE_PACKAGE_SCANNERS = 6

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

ADMIN_ROLES = ("ACCOUNTADMIN", "SECURITYADMIN")

# Credits a package uses per day when every scanner runs on its default schedule (low, high),
# and the number of scheduled scanner runs per day this refers to.
PACKAGE_DAILY_CREDITS = {
    "SECURITY_ESSENTIALS": (Decimal("0"), Decimal("0")),
    "CIS_BENCHMARKS": (Decimal("0.5"), Decimal("2.0")),
    "THREAT_INTELLIGENCE": (Decimal("0.1"), Decimal("0.5")),
    "THREAT_INTELLIGENCE_EVENTS": (Decimal("0.1"), Decimal("1.0")),
}
CREDIT_PRICE = Decimal("3")

# Duration tiers of scanners, in seconds: low below the first bound, high from the second.
MEDIUM_TIER_FROM_SECONDS = 6
HIGH_TIER_FROM_SECONDS = 17
