"""Dates in many formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in order; those of days before months come first where a source writes so.
YEAR_FIRST = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX][XX]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "d MMM yyyy HH:mm[:ss] XX")
DAY_FIRST = ("dd/MM/yyyy[ HH:mm[:ss]]", "dd-MM-yyyy[ HH:mm[:ss]]", "dd.MM.yyyy[ HH:mm[:ss]]", "d MMMM yyyy", "d MMM yyyy")
MONTH_FIRST = ("MM/dd/yyyy[ HH:mm[:ss]]", "MM-dd-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")

# Names of the months from January to December.
MONTHS = {
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "ro": "ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie",
    "hu": "január február március április május június július augusztus szeptember október november december",
    "da": "januar februar marts april maj juni juli august september oktober november december",
    "sv": "januari februari mars april maj juni juli augusti september oktober november december",
}


def _months() -> Column:
    number = {name: k + 1 for names in MONTHS.values() for k, name in enumerate(names.split())}
    return F.create_map(*[F.lit(x) for kv in sorted(number.items()) for x in kv])


def named_month(text: Column) -> Column:
    """A date whose month is a word of another language: ``3 mai 2024``, ``12. juni 2024``, ``3 de marzo de 2024``, ``2024. május 3.``."""
    day, year = r"(?iU)^(\d{1,2})(?:\.|er|º)?\s+(?:de\s+)?(\p{L}+)\.?,?\s+(?:de\s+|del\s+)?(\d{4})\b.*$", r"(?iU)^(\d{4})\.?\s+(\p{L}+)\s+(\d{1,2})\.?$"
    of = lambda pattern, y, d: F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", F.regexp_extract(text, pattern, y), F.try_element_at(_months(), F.lower(F.regexp_extract(text, pattern, 2))).cast("string"), F.regexp_extract(text, pattern, d)), "yyyy-M-d"))
    return F.coalesce(of(day, 3, 1), of(year, 1, 3))


def writes_day_first(actor: Column, platform: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether the row's actor and platform are among the pairs that write days before months."""
    out = F.lit(False)
    for a, p in pairs:
        out = out | ((actor == a) & (platform == p))
    return F.coalesce(out, F.lit(False))


def parsed_date(text: Column, day_first: Column | None = None) -> Column:
    """A date, or null for null, blank or unknown formats. ``day_first`` tells rows whose days stand before months.

    A week day in front and the name of Greenwich time behind are read over; names of months may be English or those of ``MONTHS``.
    """
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,\s*", ""), r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    tried = lambda formats: F.coalesce(*[F.to_date(F.try_to_timestamp(clean, F.lit(f))) for f in formats])
    day, month = tried(DAY_FIRST), tried(MONTH_FIRST)
    rest = F.coalesce(month, day) if day_first is None else F.when(day_first, F.coalesce(day, month)).otherwise(F.coalesce(month, day))
    return F.coalesce(tried(YEAR_FIRST), rest, named_month(clean))


def video_date(value: Column) -> Column:
    """``20250608`` becomes ``2025-06-08``; everything else stays as it is."""
    text = value.cast("string")
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", text.substr(1, 4), text.substr(5, 2), text.substr(7, 2))).otherwise(text)


def relative_date(text: Column, scraped: Column, today: str = "idag", yesterday: str = "igår") -> Column:
    """Words for today and yesterday as the date of scraping or the day before, with the time of day that follows."""
    lowered, day = F.lower(F.trim(text)), scraped.try_cast("date")
    tail = lambda word: F.trim(F.substring(F.trim(text), len(word) + 1, 1000))
    dated = lambda d, word: F.trim(F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), F.nullif(tail(word), F.lit(""))))
    return F.when(lowered.startswith(today) & day.isNotNull(), dated(day, today)).when(lowered.startswith(yesterday) & day.isNotNull(), dated(F.date_sub(day, 1), yesterday)).otherwise(text)
