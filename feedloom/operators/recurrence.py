"""Recurring schedules in wall-clock time, as arrays of instants of one row: no shuffle, and DST never moves a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import utc

#: Weekday codes, Sunday first as in dayofweek() - 1; frequencies; limits.
WEEKDAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")
PERIODS, OCCURRENCES = 2000, 5000
PARTS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "WKST")


def _ntz(day: Column, clock: Column) -> Column:
    """A day with another instant's clock time."""
    return (day.cast("timestamp_ntz") + (clock - F.date_trunc("DAY", clock).cast("timestamp_ntz"))).cast("timestamp_ntz")


def _clock(at: Column) -> Column:
    return at - F.date_trunc("DAY", at).cast("timestamp_ntz")


def _at(day: Column, clock: Column) -> Column:
    return (day.cast("timestamp_ntz") + clock).cast("timestamp_ntz")


def daily(start: Column, every: int, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + F.make_dt_interval(i * every))


def weekly(start: Column, every: int, weekdays: list[str], n: int) -> Column:
    """The given weekdays of every ``every``-th of n weeks from the start's week (Sunday first), ascending, from the start on."""
    sunday = F.date_sub(start.cast("date"), F.dayofweek(start) - 1)
    steps = F.array(*(F.lit(7 * every * i + d) for i in range(n) for d in sorted(WEEKDAYS.index(w) for w in weekdays)))
    return _let({"day": sunday, "clock": _clock(start), "from": start}, lambda a: F.filter(F.transform(steps, lambda d: _at(F.date_add(a["day"], d), a["clock"])), lambda t: t >= a["from"]))


def _months(start: Column, every: int, n: int, day_of) -> Column:
    first, steps = F.trunc(start.cast("date"), "MM"), F.array(*(F.lit(i * every) for i in range(n)))
    # A day that a month lacks is null, and so is its instant, which is not from the start on either.
    return _let({"month": first, "clock": _clock(start), "from": start}, lambda a: F.filter(F.transform(steps, lambda i: _at(day_of(F.add_months(a["month"], i)), a["clock"])), lambda t: t >= a["from"]))


def monthly_nth(start: Column, every: int, weekday: str, nth: int, n: int) -> Column:
    """The nth weekday of each month, from its end if negative; months without one are left out."""
    w = WEEKDAYS.index(weekday) + 1

    def day(m: Column) -> Column:
        if nth > 0:
            d = F.date_add(m, (F.pmod(F.lit(w) - F.dayofweek(m), F.lit(7)) + 7 * (nth - 1)).cast("int"))
        else:
            end = F.last_day(m)
            d = F.date_sub(end, (F.pmod(F.dayofweek(end) - F.lit(w), F.lit(7)) + 7 * (-nth - 1)).cast("int"))
        return F.when(F.trunc(d, "MM") == m, d)

    return _months(start, every, n, day)


def monthly_day(start: Column, every: int, day_of_month: int, n: int) -> Column:
    """A day of each month, from its end if negative; months without it are left out, not shortened."""

    def day(m: Column) -> Column:
        d = F.date_add(m, day_of_month - 1) if day_of_month > 0 else F.date_add(F.last_day(m), day_of_month + 1)
        return F.when(F.trunc(d, "MM") == m, d)

    return _months(start, every, n, day)


def bounded(at: Column, count: int | None = None, until: Column | None = None, exdates: Column | None = None, since: Column | None = None, to: Column | None = None) -> Column:
    """COUNT from the start, then UNTIL, then excluded dates, then the window."""
    if count is not None:
        at = F.slice(at, 1, count)
    if until is not None:
        at = F.filter(at, lambda t: t <= until)
    if exdates is not None:
        at = F.filter(at, lambda t: ~F.array_contains(exdates, t))
    if since is not None:
        at = F.filter(at, lambda t: t >= since)
    return at if to is None else F.filter(at, lambda t: t <= to)


def occurrences(at: Column, uid: Column, zone: str) -> Column:
    """struct(upstream_id, start) of each, in UTC."""
    return F.transform(at, lambda t: F.struct(F.concat_ws("_", uid, F.date_format(utc(t, zone), "yyyyMMdd'T'HHmmss'Z'")).alias("upstream_id"), utc(t, zone).alias("start")))


def _let(values: dict[str, Column], f) -> Column:
    """f of a struct of values that are computed once a row: plain columns would be repeated inside the functions over arrays."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), f), F.lit(0))


def _items(part: Column) -> Column:
    """BYDAY as structs of nth (0: every one) and dow (Sunday 1)."""
    return F.transform(F.split(part, ","), lambda x: F.struct(
        F.coalesce(F.regexp_extract(x, r"^([+-]?\d*)", 1).try_cast("int"), F.lit(0)).alias("nth"),
        (F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.right(x, F.lit(2)))).alias("dow")))


def until_instant(part: Column, zone: Column) -> Column:
    """UNTIL in UTC: as it is with a Z, the end of the local day for a date, else wall clock of the zone."""
    home = lambda t: F.convert_timezone(zone, F.lit("UTC"), t)
    stamp = lambda c, form: F.try_to_timestamp(c, F.lit(form)).cast("timestamp_ntz")
    day = stamp(F.when(F.length(part) == 8, part), "yyyyMMdd")
    zulu = stamp(F.when(part.endswith("Z"), part), "yyyyMMdd'T'HHmmss'Z'")
    wall = stamp(F.when((F.length(part) != 8) & ~part.endswith("Z"), part), "yyyyMMdd'T'HHmmss")
    return F.coalesce(zulu, home((day + F.expr("interval 86399 seconds")).cast("timestamp_ntz")), home(wall))


def _picked(day: Column, first: Column, freq: Column, items: Column, monthdays: Column) -> Column:
    """Whether a rule takes a day of its period; a month's days count from either end."""
    last, n = F.dayofmonth(F.last_day(day)), F.dayofmonth(day)
    fits = lambda x: (x["dow"] == F.dayofweek(day)) & ((x["nth"] == 0) | (x["nth"] == F.ceil(n / 7)) | (x["nth"] == -F.ceil((last - n + 1) / 7)))
    by_day = F.exists(items, fits)
    monthly = F.when(monthdays.isNotNull(), F.array_contains(monthdays, n) | F.array_contains(monthdays, n - last - 1)).when(items.isNotNull(), by_day).otherwise(n == F.dayofmonth(first))
    return F.when(freq == "MONTHLY", monthly).when((freq == "WEEKLY") & items.isNotNull(), by_day).otherwise(F.lit(True))


def expand(records: DataFrame, since: Column, to: Column) -> tuple[DataFrame, DataFrame]:
    """(records, skips): records with an rrule as their occurrences between two UTC instants, both included; others if they start there.

    Needs source_key, upstream_id, start and end (UTC), rrule, exdates (UTC) and
    zone, the one that start was written in; null rrule, exdates, end and zone (UTC)
    are allowed; a null among the exdates, one that could not be read, is a skip.  Dates step in that zone's wall clock; COUNT counts from the start,
    excluded dates go after it, an occurrence is as long as the first, and its id ends
    with its instant.  A rule that has no COUNT is walked from the window on, others
    from their start for at most ``PERIODS`` periods.  Rules that are refused, and
    those with more than ``OCCURRENCES`` occurrences, are skips with their reason.
    """
    ntz = lambda c: c.cast("timestamp_ntz")
    since, to, utc0, exdates = ntz(since), ntz(to), F.lit("UTC"), F.col("exdates")

    def parsed(a: Column) -> dict[str, Column]:
        part = lambda k: F.try_element_at(a["rule"], F.lit(k))
        first, freq, items = a["wall"].cast("date"), part("FREQ"), _items(part("BYDAY"))
        weeks = (freq == "WEEKLY") & items.isNotNull()
        every = F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1))
        return {
            "freq": freq, "items": items, "weeks": weeks, "first": first, "count": part("COUNT").try_cast("int"), "until": until_instant(part("UNTIL"), a["zone"]), "ends": part("UNTIL").isNotNull(),
            "mdays": F.transform(F.split(part("BYMONTHDAY"), ","), lambda x: x.try_cast("int")), "step": F.when(freq == "WEEKLY", every * 7).otherwise(every), "refused": _refused(a["rule"]),
            "anchor": F.when(freq == "MONTHLY", F.trunc(first, "MM")).when(weeks, F.date_sub(first, F.dayofweek(first) - 1)).otherwise(first),
        }

    def bounds(p: Column) -> dict[str, Column]:
        period = lambda at: F.floor(F.when(p["freq"] == "MONTHLY", F.months_between(F.trunc(at, "MM"), p["anchor"])).otherwise(F.datediff(at, p["anchor"])) / p["step"])
        begin = F.when(p["count"].isNull(), F.greatest(F.lit(0), period(F.date_sub(since.cast("date"), 1)) - 1)).otherwise(0).cast("int")
        bad_day = F.exists(p["mdays"], lambda d: d.isNull() | (F.abs(d) < 1) | (F.abs(d) > 31))
        why = F.coalesce(p["refused"], F.when(p["ends"] & p["until"].isNull(), "until"), F.when(bad_day, "month day"), F.when(F.exists(exdates, lambda t: t.isNull()), "excluded date"))
        return {"begin": begin, "last": F.least(period(F.date_add(to.cast("date"), 1)), begin + PERIODS - 1).cast("int"), "why": why}

    def walked(a: Column, p: Column, q: Column) -> Column:
        lo = lambda i: F.when(p["freq"] == "MONTHLY", F.add_months(p["anchor"], (i * p["step"]).cast("int"))).otherwise(F.date_add(p["anchor"], (i * p["step"]).cast("int")))
        hi = lambda d: F.when(p["freq"] == "MONTHLY", F.last_day(d)).when(p["weeks"], F.date_add(d, 6)).otherwise(d)
        days = lambda d: F.filter(F.sequence(d, hi(d), F.expr("interval 1 day")), lambda x: _picked(x, p["first"], p["freq"], p["items"], p["mdays"]))
        at = F.flatten(F.transform(F.sequence(q["begin"], q["last"]), lambda i: days(lo(i))))
        at = F.filter(F.transform(at, lambda d: _ntz(d, a["wall"])), lambda t: t >= a["wall"])
        at = F.when(q["why"].isNull() & (q["last"] >= q["begin"]), F.slice(at, F.lit(1), F.coalesce(p["count"], F.lit(2**31 - 1))))
        at = F.transform(at, lambda t: F.convert_timezone(a["zone"], utc0, t))
        return F.filter(at, lambda t: (t <= to) & F.coalesce(t <= p["until"], F.lit(True)))

    def result(q: Column, at: Column) -> Column:
        why = F.coalesce(q["why"], F.when(F.size(at) > OCCURRENCES, "occurrences"))
        kept = F.filter(at, lambda t: (t >= since) & ~F.coalesce(F.array_contains(exdates, t), F.lit(False)))
        return F.struct(why.alias("reason"), F.when(why.isNull(), kept).alias("at"))

    zone = F.coalesce("zone", utc0)
    found = _let({"rule": rule_parts(F.trim("rrule")), "zone": zone, "wall": F.convert_timezone(utc0, zone, ntz(F.col("start")))}, lambda a: _let(parsed(a), lambda p: _let(bounds(p), lambda q: _let({"at": walked(a, p, q)}, lambda w: result(q, w["at"])))))
    ruled = F.coalesce(F.trim("rrule"), F.lit("")) != ""
    once = F.struct(F.lit(None).cast("string").alias("reason"), F.filter(F.array(ntz(F.col("start"))), lambda t: t.between(since, to)).alias("at"))
    r = records.withColumn("_x", F.when(ruled, found).otherwise(once))
    out = r.select("*", F.explode_outer("_x.at").alias("_t")).filter("_t is not null")  # outer, so that no filter repeats the walk
    long = ntz(F.col("end")) - ntz(F.col("start"))
    uid = F.when(ruled, F.concat_ws("_", "upstream_id", F.date_format("_t", "yyyyMMdd'T'HHmmss'Z'"))).otherwise(F.col("upstream_id"))
    made = {"upstream_id": uid, "end": ntz(F.col("_t") + long), "start": F.col("_t")}
    good = out.select(*(made.get(c, F.col(f"`{c}`")).alias(c) for c in records.columns if c not in ("rrule", "exdates", "zone")))
    return good, r.filter("_x.reason is not null").select("source_key", F.col("upstream_id").alias("ref"), F.concat(F.lit("rule refused ("), "_x.reason", F.lit("): "), "rrule").alias("reason"))


def rule_parts(rule: Column) -> Column:
    return F.str_to_map(F.upper(rule), F.lit(";"), F.lit("="))


def refusal(rule: Column) -> Column:
    """Why a rule cannot be expanded, or null."""
    return _refused(rule_parts(rule))


def _refused(m: Column) -> Column:
    part = lambda k: F.try_element_at(m, F.lit(k))
    number = lambda k: part(k).isNotNull() & ~part(k).rlike("^[1-9][0-9]{0,8}$")
    freq, byday = part("FREQ"), part("BYDAY")
    ordinal = byday.rlike("[0-9]")
    good = byday.rlike(r"^([+-]?[1-5])?(SU|MO|TU|WE|TH|FR|SA)(,([+-]?[1-5])?(SU|MO|TU|WE|TH|FR|SA))*$")
    has = lambda k: part(k).isNotNull()
    return (
        F.when(~F.coalesce(freq.isin("DAILY", "WEEKLY", "MONTHLY"), F.lit(False)), F.lit("frequency"))
        .when(F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, PARTS)))) > 0, F.lit("part"))
        .when(number("INTERVAL") | number("COUNT"), F.lit("number"))
        .when(has("COUNT") & has("UNTIL"), F.lit("count and until"))
        .when(has("BYDAY") & ~good, F.lit("weekday"))
        .when((freq == "DAILY") & (has("BYDAY") | has("BYMONTHDAY")), F.lit("daily by day"))
        .when((freq == "WEEKLY") & (has("BYMONTHDAY") | F.coalesce(ordinal, F.lit(False))), F.lit("weekly by day"))
        .when((freq == "WEEKLY") & has("BYDAY") & (F.coalesce(part("INTERVAL"), F.lit("1")) != "1"), F.lit("weekly interval"))
        .when((freq == "MONTHLY") & has("BYDAY") & has("BYMONTHDAY"), F.lit("monthly by day"))
    )
