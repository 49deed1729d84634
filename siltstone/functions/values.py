"""Scalar functions: colours, cron shapes, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _channel(hex_: Column, k: int) -> Column:
    c = F.conv(F.substring(hex_, 2 + 2 * k, 2), 16, 10).cast("double") / 255
    return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(hex_: Column) -> Column:
    """Relative luminance of a colour #rrggbb."""
    return 0.2126 * _channel(hex_, 0) + 0.7152 * _channel(hex_, 1) + 0.0722 * _channel(hex_, 2)


def _rgb(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, 2 + 2 * k, 2), 16, 10).cast("double") / 255 for k in range(3)]


def saturation(hex_: Column) -> Column:
    """0 to 1, of a colour #rrggbb."""
    most, least = F.greatest(*_rgb(hex_)), F.least(*_rgb(hex_))
    return F.when(most == 0, 0.0).otherwise((most - least) / F.when(most != 0, most))


def hue(hex_: Column) -> Column:
    """Degrees, 0 to 360, halves up; 0 for greys."""
    r, g, b = _rgb(hex_)
    most, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    d = F.when(span != 0, span)
    sixth = F.when(most == r, ((g - b) / d) % 6).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    degrees = F.floor(F.coalesce(sixth, F.lit(0.0)) * 60 + 0.5).cast("int")
    return F.when(degrees < 0, degrees + 360).otherwise(degrees)


def contrast_ratio(fg: Column, bg: Column) -> Column:
    """1 to 21, two decimals, halves up."""
    a, b = luminance(fg), luminance(bg)
    return F.floor((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05) * 100 + 0.5) / 100


def contrast_threshold(size: Column, bold: Column) -> Column:
    return F.when((size >= 24) | (bold & (size >= 18.66)), 3.0).otherwise(4.5)


def describe_cron(expr: Column) -> Column:
    """A plain reading of common five-field shapes; any other expression as it is."""
    f = F.split(F.trim(expr), r"\s+")
    mi, h, dom, mon, dow = (F.get(f, F.lit(k)) for k in range(5))
    number, every, star = (lambda c: c.rlike(r"^\d+$")), (lambda c: c.rlike(r"^\*/\d+$")), (lambda *cs: F.concat(*cs) == "*" * len(cs))
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    step = lambda c: F.substring(c, 3, 10)
    at, daily = F.concat(two(h), F.lit(":"), two(mi), F.lit(" UTC")), number(mi) & number(h)
    day = F.get(F.array(*map(F.lit, DAYS)), (F.when(number(dow), dow).otherwise("0").cast("int") % 7))
    return (
        F.when(F.size(f) != 5, expr)
        .when(every(mi) & star(h, dom, mon, dow), F.concat(F.lit("every "), step(mi), F.lit(" minutes")))
        .when(star(mi, h, dom, mon, dow), "every minute")
        .when(number(mi) & star(h, dom, mon, dow), F.concat(F.lit("hourly at :"), two(mi)))
        .when(number(mi) & every(h) & star(dom, mon, dow), F.concat(F.lit("every "), step(h), F.lit(" hours at :"), two(mi)))
        .when(daily & star(dom, mon, dow), F.concat(F.lit("daily at "), at))
        .when(daily & star(dom, mon) & number(dow), F.concat(F.lit("weekly on "), day, F.lit(" at "), at))
        .when(daily & star(dom, mon) & (dow == "1-5"), F.concat(F.lit("weekdays at "), at))
        .when(daily & number(dom) & star(mon, dow), F.concat(F.lit("monthly on day "), dom, F.lit(" at "), at))
        .otherwise(expr)
    )


def conversion_status(total: Column, todos: Column) -> Column:
    return F.when(total == 0, "manual").when(todos == 0, "converted").when(todos * 2 >= total, "manual").otherwise("partial")
