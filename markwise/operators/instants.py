"""Mixed timestamp notations to exact moments.

Every notation is one branch of a single regular expression with named groups. One ``regexp_replace`` per value
turns the text into a fixed list of components, the calendar is checked on integers, and the moment is put together
by integer day arithmetic. All of it runs inside the JVM; no value is parsed twice.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwise.functions.zones import zone_abbreviations, zone_names

# Month names in English, German, French and Spanish, long and short, lower case, without a final dot.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier fevr febrero",
    3: "march mar märz maerz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
# Words that put an hour of twelve into a half of the day.
MORNING = ("am", "a.m.", "上午", "早上", "凌晨")
EVENING = ("pm", "p.m.", "下午", "晚上", "中午")
# Zone abbreviations with one meaning everywhere (RFC 822 and UTC), used where the zone itself has no such name.
COMMON_ABBREVIATIONS = {"UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}

#: Texts that are longer without the blanks around them and without digits after the ninth of a fraction hold no moment; the longest notation here is about 70 characters.
LONGEST = 120
US = 1_000_000
_SEP = "\u0001"
_BLANKS = " \t\n\u000b\f\r\u200b\ufeff"
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　   −"
_ORDINARY = "".join(chr(c) for c in range(0x21, 0x7F)) + "    -"

#: Components in the order of the replacement.
PARTS = ("year", "short", "month", "name", "day", "week", "weekday", "left", "right", "half", "hour", "minute", "second", "fraction", "offset", "abbreviation", "zone", "epoch")
#: Pattern of each component; {} is the number of the branch.
_GROUP = {
    "year": r"\d{4}", "short": r"\d{2}", "month": r"\d{1,2}", "name": r"\p{L}{3,12}", "day": r"\d{1,2}", "week": r"\d{2}", "weekday": r"\d",
    "left": r"\d{1,2}", "right": r"\d{1,2}", "half": r"[AaPp]\.?[Mm]\.?", "hour": r"\d{1,2}", "minute": r"\d{2}", "second": r"\d{2}", "fraction": r"\d{1,9}",
    "offset": r"[+-]\d{1,2}(?::?\d{2})?", "abbreviation": r"[A-Za-z]{1,5}", "zone": r"[A-Za-z_]+(?:/[A-Za-z0-9_+-]+){1,2}",
}
_TIME = r"<hour>:<minute>(?::<second>(?:[.,]<fraction>)?)?"
_ZONE = r"(?:\s*(?:(?:UTC|GMT|utc|gmt)?<offset>|<abbreviation>))?(?:\s*\[<zone>\])?"
#: The notations. Each names its components in angle brackets.
NOTATIONS = {
    "year first": r"<year>(?:-<month>-<day>|/<month>/<day>|\.<month>\.<day>)(?:[Tt]|,?\s+)" + _TIME + r"(?:\s?<half>)?" + _ZONE,
    "compact": r"<year>(?<month!>\d{2})(?<day!>\d{2})(?:[Tt](?<hour!>\d{2})(?<minute!>\d{2})(?<second!>\d{2})?|(?<hour!>\d{2})(?<minute!>\d{2})(?<second!>\d{2}))(?:[.,]<fraction>)?" + _ZONE,
    "week date": r"<year>-?[Ww]<week>-?<weekday>(?:[Tt]|\s+)" + _TIME + _ZONE,
    "day month-name year": r"(?:\p{L}{2,10}\.?,?\s+)?<day>\.?(?:\s+|-)(?:de\s+)?<name>\.?(?:\s+|-)(?:de\s+)?<year>,?\s+" + _TIME + r"(?:\s?<half>|\s?Uhr)?" + _ZONE,
    "month-name day year": r"(?:\p{L}{2,10}\.?,?\s+)?<name>\.?\s+<day>,?\s+<year>,?\s+" + _TIME + r"(?:\s?<half>)?" + _ZONE,
    "zone before year": r"(?:\p{L}{2,10}\.?,?\s+)?<name>\s+<day>\s+" + _TIME + r"(?:\s+(?:(?:UTC|GMT)?<offset>|<abbreviation>))?\s+<year>",
    "year last": r"(?:<left>/<right>/(?:<year>|<short>)|<left>\.<right>\.(?:<year>|<short>)|<left>-<right>-<year>),?\s+" + _TIME + r"(?:\s?<half>|\s?Uhr)?" + _ZONE,
    "ideographic": r"<year>年\s?<month>月\s?<day>日\s*(?<half!>上午|下午|凌晨|早上|中午|晚上)?\s*<hour>(?:[:时]|点)<minute>(?:(?:[:分])<second>(?:[.,]<fraction>)?秒?|分)?" + _ZONE,
    "epoch": r"(?<epoch!>\d{9,10}(?:\.\d{1,9})?|\d{12,13}|\d{15,16})",
}


def alternation() -> tuple[str, dict[str, list[str]]]:
    """The one pattern, and for each component the names of its groups in the pattern."""
    names: dict[str, list[str]] = {part: [] for part in PARTS}
    count = itertools.count()

    def named(found: re.Match) -> str:
        part = found[1] or found[2]
        names[part].append(f"{part}{next(count)}")
        return f"(?<{names[part][-1]}>" + ("" if found[1] else f"{_GROUP[part]})")

    branches = [re.sub(r"\(\?<(\w+)!>|<(\w+)>", named, text) for text in NOTATIONS.values()]
    return rf"\A(?:{'|'.join(branches)})\z", names


def _split(text: Column) -> Column:
    """Array of the components of ``text`` (empty where absent), of one element where no notation fits."""
    pattern, names = alternation()
    replacement = _SEP.join("".join(f"${{{g}}}" for g in names[part]) for part in PARTS)
    trimmed = F.btrim(F.translate(text, _FULL_WIDTH, _ORDINARY), F.lit(_BLANKS))
    cut = F.regexp_replace(trimmed, r"([.,][0-9]{9})[0-9]+", "$1")  # finer than any moment here
    return F.split(F.regexp_replace(F.when((F.length(cut) <= LONGEST) & ~F.contains(text, F.lit(_SEP)), cut), pattern, replacement), _SEP)


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * F.pmod(month + 9, F.lit(12)) + 2) / 5) + day - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("bigint")


def _month_days(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def with_instant(df: DataFrame, text: str, zone: str, day_first: str, out: str = "instant_us") -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01T00:00:00Z of the moment that ``text`` names, or null.

    ``zone`` (IANA name) and ``day_first`` are columns of the row's context. A written offset decides over a written
    abbreviation, that over a bracketed zone, that over ``zone``. An abbreviation means what it means in ``zone``,
    else its RFC 822 meaning. Numeric dates that end with the year follow ``day_first``; two-digit years mean 1970 to
    2069. A local time that occurs twice means the earlier moment; one that the clock skipped has none.

    Null: null, empty, blank or longer texts than ``LONGEST`` (blanks around them not counted); no notation fits; a date without time of day; a
    date, time or offset that does not exist; a local time without a known zone; a numeric year-last date with null
    ``day_first``; an unknown abbreviation. Fractions finer than a microsecond are cut. All other columns are kept;
    helper columns carry a prefix that no table uses.
    """
    p = "__instant_"
    spark = df.sparkSession
    abbreviations = F.broadcast(spark.createDataFrame([(z, a, o) for z, a, o in zone_abbreviations()], f"{p}z string, {p}a string, {p}o int"))
    part = lambda name: F.nullif(F.get(F.col(f"{p}parts"), F.lit(PARTS.index(name))), F.lit(""))
    number = lambda name: part(name).cast("int")
    months = F.create_map(*[F.lit(x) for m, words in MONTHS.items() for w in words.split() for x in (w, m)])

    # a column of its own first, so that the expression is evaluated once per value
    df = df.withColumn(f"{p}found", _split(F.col(text).cast("string")))
    df = df.withColumn(f"{p}parts", F.when(F.size(f"{p}found") == len(PARTS), F.col(f"{p}found")))
    hour, half = number("hour"), F.lower(part("half"))
    columns = {
        "year": F.coalesce(number("year"), number("short") + F.when(number("short") < 70, 2000).otherwise(1900)),
        "month": F.coalesce(number("month"), F.try_element_at(months, F.lower(part("name"))), F.when(F.col(day_first), number("right")).when(~F.col(day_first), number("left"))),
        "day": F.coalesce(number("day"), F.when(F.col(day_first), number("left")).when(~F.col(day_first), number("right"))),
        "hour": F.when(half.isNull(), hour).when(~hour.between(1, 12) & half.rlike("^[ap]"), None).when(half.isin(*EVENING), F.when(hour < 12, hour + 12).otherwise(hour)).otherwise(F.when(hour == 12, 0).otherwise(hour)),
        "minute": number("minute"),
        "second": F.coalesce(number("second"), F.lit(0)),
        "us": F.coalesce(F.rpad(F.substring(part("fraction"), 1, 6), 6, "0").cast("int"), F.lit(0)),
        "week": number("week"), "weekday": number("weekday"), "offset": part("offset"), "abbreviation": F.upper(part("abbreviation")), "written": part("zone"), "epoch": part("epoch"),
    }
    df = df.withColumns({f"{p}{k}": v for k, v in columns.items()})
    c = lambda name: F.col(f"{p}{name}")

    jan4 = days_from_civil(c("year"), F.lit(1), F.lit(4))
    first_monday = lambda d: d - F.pmod(d + 3, F.lit(7))  # noqa: E731  # 1970-01-01 was a Thursday
    next_jan4 = days_from_civil(c("year") + 1, F.lit(1), F.lit(4))
    in_year = first_monday(jan4) + (c("week") - 1) * 7 < first_monday(next_jan4)
    days = F.when(
        c("week").isNotNull(), F.when((c("week") >= 1) & c("weekday").between(1, 7) & in_year, first_monday(jan4) + (c("week") - 1) * 7 + c("weekday") - 1)
    ).otherwise(F.when(c("month").between(1, 12) & (c("day") >= 1) & (c("day") <= _month_days(c("year"), c("month"))) & (c("year") >= 1), days_from_civil(c("year"), c("month"), c("day"))))
    right_time = c("hour").between(0, 23) & c("minute").between(0, 59) & c("second").between(0, 59)
    local = F.when(right_time, ((days * 24 + c("hour")) * 60 + c("minute")) * (60 * US) + c("second").cast("bigint") * US + c("us"))

    digits = F.regexp_replace(F.substring(c("offset"), 2, 9), ":", "")
    wide = F.when(F.length(digits) <= 2, F.concat(digits, F.lit("00"))).otherwise(digits)
    hours, minutes = F.expr(f"cast(substring({p}wide, 1, length({p}wide) - 2) as int)"), F.expr(f"cast(right({p}wide, 2) as int)")
    offset = F.when((hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * F.when(c("offset").startswith("-"), -1).otherwise(1))
    number_of = F.length(F.split_part(c("epoch"), F.lit("."), F.lit(1)))
    epoch = F.when(number_of <= 10, F.floor(c("epoch").cast("decimal(28,9)") * US)).when(number_of <= 13, c("epoch").cast("bigint") * 1000).otherwise(c("epoch").cast("bigint")).cast("bigint")
    known = F.create_map(*[F.lit(x) for a, h in COMMON_ABBREVIATIONS.items() for x in (a, h * 3600)])

    df = df.withColumns({f"{p}local": local, f"{p}wide": wide, f"{p}own": F.col(zone)})
    df = df.join(abbreviations, (F.col(f"{p}own") == F.col(f"{p}z")) & (c("abbreviation") == F.col(f"{p}a")), "left")
    df = df.withColumns({f"{p}shift": F.when(c("offset").isNotNull(), offset).when(c("abbreviation").isNotNull(), F.coalesce(F.col(f"{p}o"), F.try_element_at(known, c("abbreviation"))))})
    named = F.coalesce(c("written"), F.col(zone))
    usable = F.when(named.isin(*zone_names()), named)
    stamp = F.timestamp_micros(c("local"))
    shifted = F.unix_micros(F.to_utc_timestamp(stamp, usable))
    back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(shifted), usable))
    by_zone = F.when(back == c("local"), shifted)
    written = c("offset").isNotNull() | c("abbreviation").isNotNull()
    df = df.withColumn(out, F.when(c("epoch").isNotNull(), epoch).when(written, c("local") - c("shift").cast("bigint") * US).otherwise(by_zone))
    return df.drop(*[f"{p}{k}" for k in (*columns, "found", "parts", "local", "wide", "own", "shift", "z", "a", "o")])


def moments(rows: DataFrame, context: DataFrame, key: str, text: str, context_key: str, zone: str = "time_zone", day_first: str = "day_first", out: str = "submitted_us") -> DataFrame:
    """Distinct (``key``, ``out``) of the rows whose ``text`` names a moment.

    ``context`` gives zone and day order by ``context_key``; rows without context keep their moment where the text
    alone decides. Repeated rows count once; an empty table gives no row.
    """
    own = context.select(F.col(context_key).alias("__key"), F.col(zone).alias("__zone"), F.col(day_first).alias("__day_first"))
    joined = rows.select(F.col(key).alias(key), F.col(text).alias("__text"), F.col(context_key).alias("__of")).join(own, F.col("__of") == F.col("__key"), "left")
    return with_instant(joined, "__text", "__zone", "__day_first", out).where(F.col(out).isNotNull()).select(key, out).distinct()
