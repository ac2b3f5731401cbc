"""Column encodings: cyclic times, weather categories, masks, ratios."""

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import DAY, HOUR, MINUTE, number, yes

# Feature names and their order.
INSTANT = [
    "Air temperature", "Wind speed", "Wind direction", "Relative humidity", "Precipitation intensity", "Snow depth", "Pressure (msl)",
    "Horizontal visibility", "Cloud amount"
]
CATEGORY_NAMES = [
    "Normal Clear", "Blizzard", "Heavy Snow", "Extreme Cold", "Heavy Rain", "Freezing Rain", "Black Ice", "Dense Fog", "High Winds",
    "Extreme Heat"
]
CATEGORIES = [f"weather_scenario_{c}" for c in CATEGORY_NAMES]
SCHEDULE_FEATURES = ["trainStopping", "month_sin", "month_cos", "hour_sin", "hour_cos", "day_week_sin", "day_week_cos", "train_id"]


def feature_sets(day_of_month: bool = False, keep_cloud: bool = False) -> dict[str, list[str]]:
    base = SCHEDULE_FEATURES + ["day_of_month"] * day_of_month
    raw = [x for x in INSTANT if keep_cloud or x != "Cloud amount"]
    return {"full": base + raw + CATEGORIES, "instant": base + raw, "categories": base + CATEGORIES}


def cycle(value: Column, period: float, name: str) -> list[Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def parts(us: Column) -> dict[str, Column]:
    """Calendar parts (UTC) of microseconds, without any session time zone."""
    day = F.date_from_unix_date(F.floor(us / F.lit(DAY)).cast("int"))
    rest = F.pmod(us, F.lit(DAY))
    minute = F.floor(F.pmod(rest, F.lit(HOUR)) / F.lit(MINUTE))
    return {
        "month": F.month(day), "day": F.dayofmonth(day), "sunday1": F.dayofweek(day), "monday0": F.weekday(day),
        "hour": F.floor(rest / F.lit(HOUR)), "minute": minute, "second": F.floor(F.pmod(rest, F.lit(MINUTE)) / F.lit(1_000_000))
    }


def study_cycles(us: Column, convention: str = "author-legacy") -> list[Column]:
    """Month, hour (seconds ignored) and weekday (Sunday first) of the event; one convention counts months and days from 0."""
    if convention not in ("paper", "author-legacy", "author-current"):
        raise ValueError(f"unknown convention: {convention}")
    p, less = parts(us), int(convention == "author-current")
    return cycle(p["month"] - less, 12, "month") + cycle(p["hour"] + p["minute"] / F.lit(60.0), 24, "hour") + cycle(p["sunday1"] - less, 7, "day_week")


def schedule_cycles(us: Column) -> list[Column]:
    """Month, hour with minutes and seconds, weekday (Monday 0), day of month of a scheduled time."""
    p = parts(us)
    hour = p["hour"] + p["minute"] / F.lit(60.0) + p["second"] / F.lit(3600.0)
    return cycle(p["month"], 12, "month") + cycle(hour, 24, "hour") + cycle(p["monday0"], 7, "weekday") + [p["day"].cast("double").alias("day_of_month")]


# Scenarios in order of precedence, each with what must hold: tests are joined by "and", those in one tuple
# by "or"; a test is (column, operator, bound). NEAR: within 2 degrees of freezing, or of the dew point.
TEMPERATURE, RAIN, RATE = "Air temperature", "Precipitation amount", "Precipitation intensity"
WIND, GUST, HUMIDITY, DEW, SNOW, SIGHT = "Wind speed", "Gust speed", "Relative humidity", "Dew-point temperature", "Snow depth", "Horizontal visibility"
SCENARIOS = {
    "Blizzard": [(TEMPERATURE, "<", 0), ((RATE, ">", 1), (RAIN, ">", 3)), ((WIND, ">", 10), (GUST, ">", 15)), (SIGHT, "<", 1000)],
    "Heavy Snow": [(TEMPERATURE, "<", 0), ((RATE, ">", 2), (RAIN, ">", 5)), (SNOW, ">", 0)],
    "Extreme Cold": [(TEMPERATURE, "<", -20)],
    "Heavy Rain": [(TEMPERATURE, ">", 2), ((RATE, ">", 4), (RAIN, ">", 10))],
    "Freezing Rain": [(TEMPERATURE, "near", 2), ((RAIN, ">", 0), (RATE, ">", 0))],
    "Black Ice": [(TEMPERATURE, "near", 2), (HUMIDITY, ">", 80), (DEW, "spread", 2), (RAIN, "icy", 0)],
    "Dense Fog": [(RAIN, "<=", 0.1), (SIGHT, "<", 1000), (HUMIDITY, ">", 95)],
    "High Winds": [((WIND, ">", 15), (GUST, ">", 20))],
    "Extreme Heat": [(TEMPERATURE, ">", 30)],
}
#: What the variants of the rules change: whether bounds near freezing count, the dew point's side, the ice's rain, what comes first.
VARIANTS = {
    "paper": {"closed": False, "absolute": False, "icy": (">", 0), "ice_first": False},
    "author-legacy": {"closed": True, "absolute": True, "icy": (">", 0), "ice_first": False},
    "author-current": {"closed": True, "absolute": True, "icy": ("<=", 0.5), "ice_first": True},
}
COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le}


def holds(test: tuple, variant: dict) -> Column:
    """A test as a column that is never null."""
    if isinstance(test[0], tuple):
        either = F.lit(False)
        for one in test:
            either = either | holds(one, variant)
        return either
    name, sign, bound = test
    value = number(F.col(f"`{name}`"))
    if sign == "near":
        value, sign = F.abs(value), "<=" if variant["closed"] else "<"
    elif sign == "spread":
        value = value - number(F.col(f"`{TEMPERATURE}`"))
        value, sign = F.abs(value) if variant["absolute"] else value, "<"
    elif sign == "icy":
        sign, bound = variant["icy"]
    return yes(COMPARE[sign](value, F.lit(bound)))


def weather_category(rules: str = "paper") -> Column:
    """The first scenario whose tests all hold; what is missing satisfies none."""
    if rules not in VARIANTS:
        raise ValueError(f"unknown rules: {rules}")
    variant, order = VARIANTS[rules], list(SCENARIOS)
    if variant["ice_first"]:
        at = order.index("Freezing Rain")
        order[at : at + 2] = reversed(order[at : at + 2])
    out = F
    for name in order:
        all_ = F.lit(True)
        for test in SCENARIOS[name]:
            all_ = all_ & holds(test, variant)
        out = out.when(all_, F.lit(name))
    return out.otherwise(F.lit("Normal Clear"))


def one_hot(category: Column, names: list[str], prefix: str = "weather_scenario_") -> list[Column]:
    return [(category == n).cast("float").alias(prefix + n) for n in names]


def study_features(df: DataFrame, us: Column, convention: str = "author-legacy", rules: str = "paper") -> DataFrame:
    """df with the study's cyclic, identity and scenario columns."""
    new = study_cycles(us, convention) + [parts(us)["day"].alias("day_of_month"), F.col("trainNumber").cast("double").alias("train_id")]
    kept = [F.col(f"`{c}`").cast("double").alias(c) if c == "trainStopping" else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *new, weather_category(rules).alias("_scenario")).select("*", *one_hot(F.col("_scenario"), CATEGORY_NAMES)).drop("_scenario")


def wind_vector(speed: Column, direction: Column) -> list[Column]:
    """East and north components of a wind blowing from a direction in degrees."""
    return [(-speed * F.sin(F.radians(direction))).alias("wind_east"), (-speed * F.cos(F.radians(direction))).alias("wind_north")]


def snapshot_ratios() -> list[Column]:
    """Ratios and logarithms of a history row; null where their inputs are."""
    c = F.col
    at_least = lambda x, low: F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))
    return [
        F.try_divide(c("history_count").cast("double"), F.nullif(c("history_count") + c("pending_count"), F.lit(0))).alias("history_progress_fraction"),
        F.log1p(at_least(c("previous_delay"), 0)).alias("positive_delay_log"),
        (c("previous_delay") / at_least(c("previous_scheduled_gap_minutes"), 1)).alias("delay_vs_scheduled_gap"),
        at_least(c("available_home_arrival_delay") - c("scheduled_home_dwell_minutes"), 0).alias("projected_dwell_delay"),
        F.log1p(at_least(c("oldest_pending_minutes"), 0)).alias("pending_minutes_log"),
    ]
