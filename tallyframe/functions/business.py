"""Business functions as columns: masks, anonymous ids, bands, labels, formats, ratios, finance, dates.

The named tables hold fixed values (thresholds, labels) in the order in which they apply.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.common import as_ts

# ---- masks and anonymous ids -------------------------------------------------------------------

# ---- Fixed values: text before the visible tail of a masked value, and the length of the tail ----
TAIL_MASKS = {
    "ssn": ("***-**-", 4), "phone": ("***-***-", 4), "phone_intl": ("+1***", 4), "account": ("****", 4), "card": ("****-****-****-", 4),
    "imei": ("*****", 4), "serial": ("SN-***", 4), "plate": ("***", 3), "policy": ("POL-***", 4),
}


def mask_tail(c: Column, kind: str) -> Column:
    prefix, keep = TAIL_MASKS[kind]
    return F.concat(F.lit(prefix), F.right(c.cast("string"), F.lit(keep)))


def mask_email(c: Column, keep: int = 2) -> Column:
    return F.concat(F.left(c, F.lit(keep)), F.lit("***@"), F.get(F.split(c, "@"), F.lit(1)))


def mask_address(c: Column) -> Column:
    """First four characters and the last word."""
    return F.concat(F.left(c, F.lit(4)), F.lit("*** "), F.substring_index(c, " ", -1))


# ---- Fixed values: prefix and length of anonymous ids ----
ANONYMOUS = {"patient": ("PAT-", 12), "customer": ("CUST-", 10), "shopper": ("SHOP-", 8), "subscriber": ("SUB-", 8), "operator": ("OP-", 8), "meter": ("MTR-", 8),
             "student": ("STU-", 8), "property": ("PROP-", 8), "shipment": ("SHP-", 8), "policyholder": ("PH-", 8)}


def anonymous_id(kind: str, *parts: Column) -> Column:
    prefix, n = ANONYMOUS[kind]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*[p.cast("string") for p in parts]), 256), 1, n))


def anonymous_name(first: Column, last: Column) -> Column:
    one = F.lit(1)
    return F.concat(F.left(first, one), F.lit("."), F.left(last, one), F.lit("."), F.substring(F.sha2(F.concat(first, last), 256), 1, 6))


# ---- bands -------------------------------------------------------------------------------------

# ---- Fixed values: lower bounds (value >= bound) with their label, then the label below all ----
AT_LEAST = {
    "risk_score": (((80, "Critical"), (60, "High"), (40, "Medium"), (20, "Low")), "Minimal"),
    "credit_score": (((800, "Exceptional"), (740, "Very Good"), (670, "Good"), (580, "Fair")), "Poor"),
    "churn_risk": (((0.8, "Critical"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")), "Minimal"),
    "signal_quality": (((4, "Excellent"), (3, "Good"), (2, "Fair")), "Poor"),
    "environmental_rating": (((98, "Excellent"), (90, "Good"), (80, "Acceptable")), "Needs Improvement"),
    "voltage_level": (((345, "Extra High"), (115, "High"), (35, "Medium")), "Low"),
    "capacity_factor": (((80, "A"), (60, "B"), (40, "C"), (20, "D")), "F"),
    "academic_standing": (((3.5, "Deans List"), (2.0, "Good Standing"), (1.5, "Probation")), "Suspension Risk"),
    "credit_hours": (((120, "Senior"), (90, "Junior"), (60, "Sophomore")), "Freshman"),
    "donation_tier": (((10000, "Platinum"), (5000, "Gold"), (1000, "Silver")), "Bronze"),
    "school_rating": (((9, "Excellent"), (7, "Good"), (5, "Average")), "Below Average"),
    "walkability": (((90, "Walkers Paradise"), (70, "Very Walkable"), (50, "Somewhat Walkable")), "Car-Dependent"),
    "insurance_fraud": (((80, "Very High"), (60, "High"), (40, "Medium"), (20, "Low")), "Minimal"),
    "catastrophe": (((25000000000, "Mega-Cat"), (5000000000, "Major-Cat"), (1000000000, "Significant")), "Minor"),
    "sentiment": (((4, "positive"), (3, "neutral")), "negative"),
}
# ---- Fixed values: exclusive lower bounds (value > bound) ----
ABOVE = {
    "event_size": (((5000, "Large"), (500, "Medium"), (50, "Small")), "Micro"),
    "claim_severity": (((10000, "Major"), (1000, "Moderate")), "Minor"),
    "claim_severity_insurance": (((100000, "Catastrophic"), (50000, "Major"), (10000, "Moderate"), (1000, "Minor")), "Minimal"),
}
# ---- Fixed values: upper bounds (value < bound) with their label, then the label above all ----
BELOW = {
    "encounter_duration": (((30, "Brief"), (60, "Standard"), (120, "Extended")), "Long"),
    "bmi": (((18.5, "Underweight"), (25, "Normal"), (30, "Overweight")), "Obese"),
    "spectrum_band": (((1000, "Low Band"), (6000, "Mid Band")), "High Band (mmWave)"),
    "market_status": (((7, "Hot"), (30, "Active"), (90, "Slow")), "Stale"),
}


def band(c: Column, name: str) -> Column:
    """Label of a value by one of the tables above."""
    if name in AT_LEAST:
        (rows, default), test = AT_LEAST[name], lambda b: c >= b
    elif name in ABOVE:
        (rows, default), test = ABOVE[name], lambda b: c > b
    else:
        (rows, default), test = BELOW[name], lambda b: c < b
    return cases([(test(b), label) for b, label in rows], default)


def cases(rows: Sequence[tuple], default) -> Column:
    out = F.when(rows[0][0], rows[0][1])
    for cond, label in rows[1:]:
        out = out.when(cond, label)
    return out.otherwise(default)


def stock_level(on_hand: Column, reorder: Column) -> Column:
    return cases([(on_hand == 0, "Out of Stock"), (on_hand < reorder, "Low Stock"), (on_hand < reorder * 3, "Adequate")], "Overstocked")


def sensor_status(v: Column, lo: Column, hi: Column) -> Column:
    return cases([((v < lo) | (v > hi), "Out of Spec"), ((v < lo * 1.1) | (v > hi * 0.9), "Warning")], "Normal")


def supplier_grade(quality: Column, delivery: Column) -> Column:
    return cases([((quality >= q) & (delivery >= d), g) for q, d, g in ((4.5, 95, "A"), (3.5, 85, "B"), (2.5, 75, "C"))], "D")


def limit_status(v: Column, limit: Column) -> Column:
    return cases([(v <= limit * 0.8, "Well Below"), (v <= limit, "Compliant")], "Exceeds Limit")


# ---- labels and ranks --------------------------------------------------------------------------

# ---- Fixed values: value -> label or rank, and the default ----
LABELS = {
    "loan_status": ({"default": 5, "delinquent": 4, "restructured": 3, "active": 2}, 1),
    "insurance_tier": ({"platinum": 4, "gold": 3, "silver": 2}, 1),
    "loyalty_tier": ({"diamond": 5, "platinum": 4, "gold": 3, "silver": 2}, 1),
    "billing_status": ({"overdue": 1, "partial": 2, "pending": 3, "paid": 4}, 5),
    "exception_priority": ({"critical": 1, "severe": 2, "moderate": 3}, 4),
    "filing_priority": ({"rate_filing": 1, "form_filing": 2, "financial_statement": 3}, 4),
    "compliance_priority": ({"SAR": 1, "OFAC_hit": 1, "AML_alert": 2, "PEP_match": 2, "CTR": 3}, 4),
    "drug_schedule": ({"II": "High", "III": "Medium", "IV": "Medium", "V": "Low"}, "None"),
    "shift": ({"morning": "1st Shift (6AM-2PM)", "afternoon": "2nd Shift (2PM-10PM)"}, "3rd Shift (10PM-6AM)"),
    "fuel": ({"solar": "Green", "wind": "Green", "hydro": "Green", "geothermal": "Green", "nuclear": "Blue", "natural_gas": "Gray"}, "Brown"),
    "title_rank": ({"Professor": 5, "Associate Professor": 4, "Assistant Professor": 3, "Lecturer": 2}, 1),
    "shipping": ({"same_day": "Today", "next_day": "1 business day", "express": "2-3 business days", "standard": "5-7 business days"}, "7-14 business days"),
}


def map_label(c: Column, mapping: Mapping, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def label(c: Column, name: str) -> Column:
    return map_label(c, *LABELS[name])


def title_label(c: Column) -> Column:
    """snake_case as words with capitals."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# ---- formats -----------------------------------------------------------------------------------

# ---- Fixed values: currency signs ----
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£"}


def money(c: Column, currency: Column | None = None) -> Column:
    text = F.format_number(c, 2)
    if currency is None:
        return F.concat(F.lit("$"), text)
    sign = map_label(currency, SIGNS, "")
    return F.when(sign != "", F.concat(sign, text)).otherwise(F.concat(currency, F.lit(" "), text))


def scaled(c: Column, steps: Sequence[tuple[float, int, str]], decimals: int, unit: str) -> Column:
    """Value with the unit of the first step it reaches (bound, decimals, unit), else its own unit."""
    def text(div, dec, u):
        return F.concat(F.round(c / div, dec).cast("string"), F.lit(f" {u}"))

    return cases([(c >= b, text(b, d, u)) for b, d, u in steps], text(1, decimals, unit))


def data_size(c: Column) -> Column:
    kb = 1024
    b = F.concat(c.cast("string"), F.lit(" B"))
    return F.when(c >= kb, scaled(c, ((kb ** 3, 2, "GB"), (kb ** 2, 2, "MB"), (kb, 2, "KB")), 0, "B")).otherwise(b)


def weight(c: Column) -> Column:
    return scaled(c, ((1000, 2, "T"),), 1, "kg")


def clock(seconds: Column) -> Column:
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor((seconds % 3600) / 60)), two(seconds % 60))


def hours_minutes(minutes: Column) -> Column:
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))


def phone_display(c: Column) -> Column:
    return F.concat(F.lit("("), F.substring(c, 3, 3), F.lit(") "), F.substring(c, 6, 3), F.lit("-"), F.substring(c, 9, 4))


def iban_display(c: Column) -> Column:
    return F.concat_ws(" ", F.substring(c, 1, 4), F.substring(c, 5, 4), F.substring(c, 9, 4), F.substr(c, F.lit(13)))


def tracking_id(c: Column) -> Column:
    return F.concat(F.lit("TRK-"), F.lpad(c.cast("string"), 12, "0"))


def stars(rating: Column, of: int = 5) -> Column:
    return F.concat(F.repeat(F.lit("★"), rating), F.repeat(F.lit("☆"), F.lit(of) - rating))


# ---- ratios, finance, measures -----------------------------------------------------------------

def safe_ratio(a: Column, b: Column, factor: float = 100, decimals: int = 2, floor=1) -> Column:
    """a / b times a factor, the denominator not below ``floor``."""
    return F.round(a * factor / F.greatest(b, F.lit(floor)), decimals)


def effective_rate(rate: Column, periods: Column) -> Column:
    return F.round(F.pow(1 + rate / periods, periods) - 1, 4)


def annuity(principal: Column, annual_rate: Column, months: Column) -> Column:
    r = annual_rate / 12
    return F.round(principal * r / (1 - F.pow(1 + r, -months)), 2)


def growth(value: Column, rate: Column, years: Column) -> Column:
    """Compound growth; a negative rate is decay."""
    return F.round(value * F.pow(1 + rate, years), 2)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(a) * F.sin(b)
    return F.round(6371 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))), 2)


def cpk(v: Column, lo: Column, hi: Column) -> Column:
    return F.round(F.least(v - lo, hi - v) / ((hi - lo) / 6), 3)


def oee(availability: Column, performance: Column, quality: Column) -> Column:
    return F.round(availability * performance * quality / 10000, 2)


def dimensional_weight(length: Column, width: Column, height: Column) -> Column:
    return F.round(length * width * height / 5000, 2)


# ---- dates -------------------------------------------------------------------------------------

def age_years(born: Column, as_of) -> Column:
    return F.floor(F.datediff(as_ts(as_of), born) / 365.25)


def days_since(day: Column, as_of) -> Column:
    return F.datediff(as_ts(as_of), day)


def tenure_months(start: Column, as_of) -> Column:
    return F.months_between(as_ts(as_of), start).cast("int")


def days_to_maturity(start: Column, months: Column, as_of) -> Column:
    return F.datediff(F.add_months(start, months), as_ts(as_of))


def expiry_status(day: Column, as_of, warn_days: int = 90) -> Column:
    left = F.datediff(day, as_ts(as_of))
    return cases([(left < 0, "Expired"), (left < warn_days, "Expiring Soon")], "Valid")


def maintenance_urgency(days: Column, interval: Column) -> Column:
    return cases([(days > interval * 1.5, "Overdue - Critical"), (days > interval, "Overdue"), (days > interval * 0.9, "Due Soon")], "OK")


# ---- Fixed values: days allowed per priority, and for all others ----
SLA_DAYS = ({"critical": 1, "high": 3, "medium": 5}, 7)


def ticket_sla(created: Column, resolved: Column, priority: Column) -> Column:
    met = F.datediff(resolved, created) <= map_label(priority, *SLA_DAYS)
    return cases([(resolved.isNull(), "Open"), (met, "Met")], "Breached")


def in_business_hours(at: Column) -> Column:
    return F.hour(at).between(9, 17) & F.dayofweek(at).between(2, 6)


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def is_overdue(due: Column, done: Column) -> Column:
    return done.isNull() | (done > due)
