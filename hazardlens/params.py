"""Fixed values of the hazard domain: grades, alert limits, ranges and time defaults.

Everything here is a default of a function argument, never a hidden global.
"""

from __future__ import annotations

# Fixed values: (severity, exclusive upper bound); None closes the table.
QUAKE_GRADES_4 = [("Low", 4.0), ("Moderate", 6.0), ("High", 7.0), ("Extreme", None)]
FIRE_GRADES_4 = [("Low", 5.0), ("Moderate", 15.0), ("High", 50.0), ("Extreme", None)]
QUAKE_GRADES_3 = [("low", 4.0), ("moderate", 6.0), ("high", None)]
FIRE_GRADES_3 = [("low", 5.0), ("moderate", 15.0), ("high", None)]
QUAKE_GRADES_3_TITLE = [("Low", 4.0), ("Moderate", 6.0), ("High", None)]
FIRE_GRADES_3_TITLE = [("Low", 5.0), ("Moderate", 15.0), ("High", None)]
UNKNOWN_GRADE = "Unknown"

# An alert needs value >= limit of its (type, severity).
ALERT_LIMITS = {
    "earthquake": {"Low": 2.0, "Moderate": 4.0, "High": 6.0, "Extreme": 7.0},
    "fire": {"Low": 1.0, "Moderate": 5.0, "High": 50.0, "Extreme": 100.0},
}
ALERT_COOLDOWN_SECONDS = 60

# Look-back ranges in seconds, each drawn as TREND_BUCKETS equal buckets.
TIME_RANGES = {
    "1m": 60,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "3h": 10800,
    "5h": 18000,
    "6h": 21600,
    "12h": 43200,
}
TREND_BUCKETS = 12
STRONG_INTENSITY = 0.7

# Fixed values: (label, inclusive lower bound of the vulnerability index).
VULNERABILITY_LABELS = [("Critical", 0.8), ("High", 0.6), ("Medium", 0.4), ("Low", None)]

METRIC_WINDOW = "1 minute"
WATERMARK = "2 hours"
EVENT_TRIGGER = "5 seconds"
METRIC_TRIGGER = "60 seconds"
MAX_RECORDS_PER_TRIGGER = 1000
FIRE_LOOKBACK_HOURS = 3

HOTSPOT_RANKS = 5
CORRELATION_DAYS = 7
EARTH_RADIUS_KM = 6371.0088
