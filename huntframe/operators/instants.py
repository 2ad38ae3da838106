"""Mixed timestamp texts and units as one UTC instant each.

Texts are deduplicated together with the zone and the date order of their source (and, if
they state no year, the year of arrival) into a dictionary of distinct values. A dictionary
entry is parsed once, by JVM expressions over every known form, into its candidate instants:
one for most texts, two for an hour that occurs twice, one per year where the year is open.
The dictionary is kept as a versioned table; a later batch parses only values it lacks. Rows
then look their value up and take the candidate that lies nearest to their arrival.

Defined cases: null, blank and senseless texts, dates and times that do not exist (also local
times that a clock change skips) and zone abbreviations that are unknown give null; digits
beyond microseconds are cut off; a text without a zone whose source has none gives null; with
equal distance the earlier candidate holds; without arrival the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.text import stripped
from huntframe.sources.versioned import VersionedTable
from huntframe.types import schema

US = 1_000_000
DAY = 86_400 * US

# Month names (English, German) and offsets of zone abbreviations in minutes.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mär": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "npt": 345, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_ZONE = r"(z|[a-z]{3,5}|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)? *(am|pm|a\.m\.|p\.m\.)? *" + _ZONE + "$"
_MONTH = r"(jan|feb|mar|mär|mae|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez)[a-zä]*\.?"
_WEEKDAY = r"^(?:[a-zäöü]{2,10}\.?,? +)?"

#: Forms of lower-case texts, rewritten to ``year|month|day|hour|minute|second|fraction|half|zone``.
_YEAR_FIRST = (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:t| +|, *)" + _CLOCK, "$1|$2|$3|$4|$5|$6|$7|$8|$9")
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:t| +|, *)" + _CLOCK
_COMPACT = (r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,12}))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8")
_MONTH_FIRST = (_WEEKDAY + _MONTH + r" +(\d{1,2})(?:,? +(\d{4}))?,? +" + _CLOCK, "$3|$1|$2|$4|$5|$6|$7|$8|$9")
_CTIME = (_WEEKDAY + _MONTH + r" +(\d{1,2}) +(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,12}))? +" + _ZONE + r" *(\d{4})$", "$8|$1|$2|$3|$4|$5|$6||$7")
_DAY_FIRST = (_WEEKDAY + r"(\d{1,2})[. /-]+" + _MONTH + r"[ /-]+(\d{4})[: t]+ *" + _CLOCK, "$3|$2|$1|$4|$5|$6|$7|$8|$9")

DICTIONARY = schema("ts_text string, zone string, date_order string, near_year int, candidates array<bigint>")
KEYS = ["ts_text", "zone", "date_order", "near_year"]


def unit_to_us(ts: Column) -> Column:
    """Epoch seconds, milli-, micro- or nanoseconds as microseconds.

    Units are a factor of 1000 apart, so an instant from 1973 to 2286 tells its unit by its size.
    """
    ts = ts.cast("bigint")
    size = F.abs(ts)
    return F.when(size < 10**10, ts * US).when(size < 10**13, ts * 1000).when(size < 10**16, ts).otherwise(F.call_function("div", ts, F.lit(1000)))


def to_utc_candidates(local_us: Column, zone: Column) -> Column:
    """The instants at which clocks in ``zone`` show ``local_us``: none, one or two, ascending.

    The offsets in force a day before and a day after are the only ones possible, as no zone
    changes its clock twice within two days.
    """

    def shown(instant: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone))

    def candidate(near: Column) -> Column:
        return local_us - (shown(near) - near)

    both = F.array(candidate(local_us - DAY), candidate(local_us + DAY))
    return F.array_sort(F.array_distinct(F.filter(both, lambda c: shown(c) == local_us)))


def parse(entries: DataFrame) -> DataFrame:
    """Adds ``candidates`` to dictionary keys; null where the text denotes no instant."""
    low = F.lower(stripped(F.col("ts_text")))
    dmy = F.regexp_replace(low, _YEAR_LAST, "$3|$2|$1|$4|$5|$6|$7|$8|$9")
    mdy = F.regexp_replace(low, _YEAR_LAST, "$3|$1|$2|$4|$5|$6|$7|$8|$9")
    canon = (
        F.when(low.rlike(r"^\d{9,11}(?:\.\d+)?$|^\d{13}$|^\d{16}$|^\d{19}$"), F.concat(F.lit("#"), low))
        .when(low.rlike(_YEAR_FIRST[0]), F.regexp_replace(low, *_YEAR_FIRST))
        .when(low.rlike(_YEAR_LAST), F.when(F.col("date_order") == "mdy", mdy).otherwise(dmy))
        .when(low.rlike(_MONTH_FIRST[0]), F.regexp_replace(low, *_MONTH_FIRST))
        .when(low.rlike(_DAY_FIRST[0]), F.regexp_replace(low, *_DAY_FIRST))
        .when(low.rlike(_COMPACT[0]), F.regexp_replace(low, *_COMPACT))
        .when(low.rlike(_CTIME[0]), F.regexp_replace(low, *_CTIME))
    )
    d = entries.withColumn("p", F.split(canon, r"\|"))
    p = F.col("p")
    epoch = F.when(F.get(p, F.lit(0)).startswith("#"), F.substring(F.get(p, F.lit(0)), 2, 40))
    whole, fraction = F.substring_index(epoch, ".", 1), F.when(F.instr(epoch, ".") > 0, F.substring_index(epoch, ".", -1)).otherwise("")
    micro = lambda digits: F.substring(F.rpad(digits, 6, "0"), 1, 6).try_cast("bigint")
    epoch_us = unit_to_us(whole.try_cast("bigint")) + F.when(fraction != "", micro(fraction)).otherwise(0)
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.coalesce(F.get(p, F.lit(1)).try_cast("int"), F.try_element_at(months, F.substring(F.get(p, F.lit(1)), 1, 3)))
    hour, half = F.get(p, F.lit(3)).try_cast("int"), F.substring(F.get(p, F.lit(7)), 1, 1)
    hour24 = F.when(half == "", F.when(hour < 24, hour)).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = F.get(p, F.lit(4)).try_cast("int"), F.when(F.get(p, F.lit(5)) == "", 0).otherwise(F.get(p, F.lit(5)).try_cast("int"))
    clock = F.when((minute < 60) & (second < 60), (hour24 * 3600 + minute * 60 + second).cast("bigint") * US + micro(F.get(p, F.lit(6))))
    zone = F.regexp_replace(F.get(p, F.lit(8)), "^(?:utc|gmt)(?=[+-])", "")
    digits = F.regexp_replace(F.substring(zone, 2, 9), ":", "")
    numeric = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))) * F.when(zone.startswith("-"), -1).otherwise(1)
    names = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    offset = F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(names, zone))
    d = d.select(
        *KEYS,
        epoch_us.alias("epoch_us"),
        F.when(F.get(p, F.lit(0)) == "", None).otherwise(F.get(p, F.lit(0)).try_cast("int")).alias("year"),
        F.lpad(month.cast("string"), 2, "0").alias("mm"),
        F.lpad(F.get(p, F.lit(2)), 2, "0").alias("dd"),
        clock.alias("clock"),
        (zone != "").alias("stated"),
        offset.alias("offset"),
        (F.get(p, F.lit(0)) == "").alias("yearless"),
    )
    # 29 February may be eight years away from the nearest one.
    near = F.when((F.col("mm") == "02") & (F.col("dd") == "29"), 8).otherwise(1)
    years = F.when(F.col("yearless"), F.sequence(F.col("near_year") - near, F.col("near_year") + near)).otherwise(F.array("year"))

    def local(year: Column) -> Column:
        day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.col("mm"), F.col("dd")).try_cast("date")
        return F.unix_date(day).cast("bigint") * DAY + F.col("clock")

    found = F.flatten(
        F.transform(
            F.filter(F.transform(years, local), lambda u: u.isNotNull()),
            lambda u: F.when(F.col("stated"), F.array(u - F.col("offset").cast("bigint") * 60 * US)).when(F.col("zone").isNotNull(), to_utc_candidates(u, F.col("zone"))),
        )
    )
    found = F.filter(found, lambda c: c.isNotNull())
    answer = F.when(F.col("epoch_us").isNotNull(), F.array("epoch_us")).when(F.size(found) > 0, F.array_sort(found))
    return d.select(*KEYS, answer.alias("candidates"))


class InstantDictionary:
    """The persisted dictionary of distinct timestamp texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, DICTIONARY)

    @staticmethod
    def keyed(rows: DataFrame, text: str = "ts_text", zone: str = "zone_name", order: str = "date_order", arrival: str = "recv_us") -> DataFrame:
        """Adds the dictionary's key columns under ``k_`` names, which clash with no column of the rows."""
        open_year = ~F.col(text).rlike(r"\d{4}")
        return rows.withColumns(
            {
                "k_ts_text": F.col(text),
                "k_zone": F.col(zone),
                "k_date_order": F.col(order),
                "k_near_year": F.when(open_year, F.year(F.timestamp_micros(F.col(arrival)))).otherwise(0),
            }
        )

    def extend(self, rows: DataFrame) -> int:
        """Parses the values of keyed rows that the dictionary lacks and commits them; returns the version.

        Known values are never parsed again. Of two writers that add the same values at once, the
        second finds the first one's and adds the rest.
        """
        words = rows.where(F.col("k_ts_text").isNotNull()).select(*[F.col(f"k_{k}").alias(k) for k in KEYS]).distinct()

        def change(base: int):
            new = words
            if base:
                same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEYS]
                new = new.alias("n").join(self.table.read(version=base).alias("o"), same, "left_anti")
            return self.table.stage(parse(new)), []

        return self.table.transact(change)

    def lookup(self, rows: DataFrame, arrival: str = "recv_us") -> DataFrame:
        """Keyed rows with ``ts_us``; rows whose text has no instant keep null."""
        words = self.table.read().where(F.col("candidates").isNotNull()).select(*[F.col(k).alias(f"_d_{k}") for k in KEYS], F.col("candidates").alias("_d_candidates"))
        same = [F.col("k_ts_text") == F.col("_d_ts_text")] + [F.col(f"k_{k}").eqNullSafe(F.col(f"_d_{k}")) for k in KEYS[1:]]
        nearest = F.array_min(F.transform("_d_candidates", lambda c: F.struct(F.abs(c - F.coalesce(F.col(arrival), F.lit(0))).alias("far"), c.alias("us"))))["us"]
        joined = rows.join(words, same, "left").withColumn("ts_us", nearest)
        return joined.drop("_d_candidates", *[f"_d_{k}" for k in KEYS], *[f"k_{k}" for k in KEYS])
