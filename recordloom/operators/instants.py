"""Mixed timestamp formats and zones to one UTC instant.

1. Every text is read once by its form: an epoch number of any precision, or a date
   and a time with an offset, a zone name, an abbreviation or nothing. What was
   read is written to the scratch folder.
2. Devices whose zone is missing or contradicted get one by estimation among all
   zones of the time zone database, those that devices declare first. Evidence is
   added up by device and day: rows whose two fields are an instant and a bare
   local time show the offset that was in force; a bare local time can't lie after
   its ingestion, so it shows the least offset that is possible. The zone whose
   offset history leaves the fewest violations is taken. A device without rows of
   the first kind takes, of the zones with hardly more violations than the best one, that whose
   times lie closest before their ingestion. A declared zone stands unless its history is
   violated by most of the rows and another one is hardly violated at all.
3. Local times are converted in that zone. A time that occurs twice takes the
   instant that agrees with the other field of the row, if that one is
   unambiguous, and the first otherwise. A time that a zone skips is read with the
   offset in force before the change.

Defined cases: null, blank and placeholder texts (``null``, ``0``, ``-`` and the
like) and texts in no known form give no row; a value without zone of a device
without known zone is read as UTC; repeated rows are converted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut

#: Texts that stand for no timestamp.
PLACEHOLDERS = frozenset(("", "0", "-", "--", "null", "none", "nan", "n/a", "na", "unknown", "(unknown)", "?"))
#: Month names, English, German, French and Spanish.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mrz": 3, "mai": 5, "okt": 10, "dez": 12,
    "janv": 1, "fév": 2, "févr": 2, "mars": 3, "avr": 4, "juin": 6, "juil": 7, "aoû": 8, "août": 8, "déc": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}
#: Offsets of zone abbreviations in minutes, used when the device's zone doesn't know the abbreviation.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Locales that write the month first.
MONTH_FIRST = ("en_US",)
_EPOCH = datetime(1970, 1, 1)

_COMPACT = re.compile(r"^(\d{4})(\d\d)(\d\d)[T ]?(\d\d)(\d\d)(\d\d)?(?:[.,](\d+))?\s*(.*)$")
_TIME = re.compile(r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?!\d)\s*([AaPp])?(?(5)\.?[Mm]\.?(?![A-Za-z]))")
_OFFSET = re.compile(r"^(?:UTC|GMT)?\s*([+-])(\d{2}):?(\d{2})$")
_NAMED = re.compile(r"^\[?([A-Z][A-Za-z_]+/[A-Za-z_/+-]+)\]?$")
_YMD = re.compile(r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)T?")
_NUMERIC = re.compile(r"(?<!\d)(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)")
_MONTH_FIRST = re.compile(r"([^\W\d_]{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)")
_DAY_FIRST = re.compile(r"(?<!\d)(\d{1,2})\.?\s+(?:de\s+)?([^\W\d_]{3,})\.?\s+(?:de\s+)?(\d{4})(?!\d)")
_YEAR_LAST = re.compile(r"([^\W\d_]{3,})\s+(\d{1,2})\s")
_NOISE = re.compile(r"\b(?:at|um|à|a las|Uhr|mon|tue|wed|thu|fri|sat|sun)\b\.?|[,\s]+", re.I)


def _ms(fraction: str | None) -> int:
    return int((fraction or "").ljust(3, "0")[:3] or 0)


def _month(word: str) -> int | None:
    w = word.lower()
    return MONTHS.get(w) or MONTHS.get(w[:4]) or MONTHS.get(w[:3])


def _epoch(text: str) -> int | None:
    """Epoch milliseconds of an epoch number by its digits: seconds, milli-, micro- or nanoseconds."""
    whole, _, fraction = text.partition(".")
    sign, digits = (-1, whole[1:]) if whole[:1] == "-" else (1, whole)
    n = len(digits)
    if 8 <= n <= 10:
        return sign * (int(digits) * 1000 + _ms(fraction))
    if 11 <= n <= 13:
        return sign * int(digits)
    if 14 <= n <= 16:
        return sign * (int(digits) // 1000)
    if 17 <= n <= 19:
        return sign * (int(digits) // 1_000_000)
    return None


Local = tuple[int, int, int, int, int, int, int]


def read_stamp(text: str | None, month_first: bool) -> tuple[int | None, Local | None, str | None]:
    """(epoch milliseconds, local time, zone text) of a timestamp; the first for an instant, the others for a local time. All None: no timestamp."""
    nothing = (None, None, None)
    if text is None or (t := text.strip()).lower() in PLACEHOLDERS:
        return nothing
    if re.fullmatch(r"-?\d+(\.\d+)?", t) and not re.fullmatch(r"(19|20)\d{12}", t):
        return _epoch(t), None, None
    if m := _COMPACT.match(t):
        y, mo, d, h, mi, s, f, zone = m.groups()
        parts = (int(y), int(mo), int(d), int(h), int(mi), int(s or 0), _ms(f))
    else:
        clock = _TIME.search(t)
        if not clock:
            return nothing
        h, mi, s, f, half = clock.groups()
        hour = int(h)
        if half:
            hour = hour % 12 + (12 if half in "Pp" else 0)
        before, after = t[: clock.start()], t[clock.end() :]
        rest = before + " " + after
        if m := _YMD.search(rest):
            y, mo, d = map(int, m.groups())
        elif m := _NUMERIC.search(rest):
            a, sep, b, y = m.groups()
            a, b, y = int(a), int(b), int(y) + (2000 if len(y) == 2 else 0)
            first = month_first and sep == "/"
            mo, d = (a, b) if (first and a <= 12) or b > 12 else (b, a)
        elif (m := _DAY_FIRST.search(rest)) and _month(m.group(2)):
            d, mo, y = int(m.group(1)), _month(m.group(2)), int(m.group(3))
        elif (m := _MONTH_FIRST.search(rest)) and _month(m.group(1)):
            mo, d, y = _month(m.group(1)), int(m.group(2)), int(m.group(3))
        else:
            m = next((x for x in _YEAR_LAST.finditer(rest) if _month(x.group(1))), None)
            year = re.search(r"(?<![\d+:-])(\d{4})\s*$", rest)
            if not m or not year:
                return nothing
            mo, d, y = _month(m.group(1)), int(m.group(2)), int(year.group(1))
            rest = rest[: year.start()] + rest[year.end() :]
            m = re.search(re.escape(m.group()), rest)
        rest = rest[: m.start()] + " " + rest[m.end() :]
        zone = " ".join(_NOISE.sub(" ", rest).split())
        parts = (y, mo, d, hour, int(mi), int(s or 0), _ms(f))
    try:
        moment = datetime(*parts[:6])
    except ValueError:
        return nothing
    zone = (zone or "").strip()
    local_ms = (moment - _EPOCH) // timedelta(milliseconds=1) + parts[6]
    if zone in ("Z", "z"):
        return local_ms, None, None
    if m := _OFFSET.match(zone):
        minutes = int(m.group(2)) * 60 + int(m.group(3))
        return local_ms - (minutes if m.group(1) == "+" else -minutes) * 60_000, None, None
    if zone in ("UTC", "GMT"):
        return local_ms, None, None
    return None, parts, zone or None


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


def _at(parts: Local, zone, fold: int) -> int:
    offset = datetime(*parts[:6], tzinfo=zone, fold=fold).utcoffset()
    return (datetime(*parts[:6]) - _EPOCH - offset) // timedelta(milliseconds=1) + parts[6]


def candidates(parts: Local, zone_text: str | None, device_zone: str | None) -> list[int]:
    """The one or two instants of a local time, earliest first."""
    home = _zone(device_zone) or timezone.utc
    if zone_text:
        if m := _NAMED.match(zone_text):
            home = _zone(m.group(1)) or home
        else:
            word = zone_text.strip("()").upper()
            for fold in (0, 1):
                if datetime(*parts[:6], tzinfo=home, fold=fold).tzname() == word:
                    return [_at(parts, home, fold)]
            if word in ABBREVIATIONS:
                return [_at(parts, timezone(timedelta(minutes=ABBREVIATIONS[word])), 0)]
    a, b = _at(parts, home, 0), _at(parts, home, 1)
    return [a] if b <= a else [a, b]  # b < a: a time that the zone skips


def _resolve(own: list[int], other: list[int]) -> int | None:
    if not own:
        return None
    if len(own) == 2 and len(other) == 1:
        near = [abs(x - other[0]) for x in own]
        if min(near) < 30 * 60_000:
            return own[near.index(min(near))]
    return own[0]


def _stamps(date: str | None, readable: str | None, month_first: bool, zone: str | None) -> tuple[int | None, int | None]:
    out = []
    for text in (date, readable):
        ms, parts, zone_text = read_stamp(text, month_first)
        out.append([ms] if ms is not None else candidates(parts, zone_text, zone) if parts else [])
    return _resolve(out[0], out[1]), _resolve(out[1], out[0])


#: What is kept of a text: an instant, or a local time (as milliseconds since 1970 by the wall clock) and its zone text.
_READ = "import_id bigint, device_id bigint, arrived bigint, normal boolean, ms_a bigint, local_a bigint, zone_a string, ms_b bigint, local_b bigint, zone_b string"


def read_fields(rows: DataFrame) -> DataFrame:
    """What the two fields of each row say; ``rows``: import_id, device_id, imported_at, date, readable_date, locale."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read: list[list] = [[] for _ in range(6)]
            normal = []
            for date, readable, locale in zip(batch["date"], batch["readable_date"], batch["locale"]):
                first = locale in MONTH_FIRST
                normal.append(date is not None and len(date) == 13 and date.isascii() and date.isdigit())
                for k, text in ((0, date), (3, readable)):
                    ms, parts, zone = read_stamp(text, first)
                    read[k].append(ms)
                    read[k + 1].append(None if parts is None else _wall(parts))
                    read[k + 2].append(zone)
            out = pd.DataFrame({"import_id": batch["import_id"], "device_id": batch["device_id"].astype("Int64"), "arrived": batch["arrived"].astype("Int64"), "normal": normal})
            for name, k in (("a", 0), ("b", 3)):
                out[f"ms_{name}"], out[f"local_{name}"] = (pd.array(read[k + j], dtype="Int64") for j in (0, 1))
                out[f"zone_{name}"] = pd.Series(read[k + 2], dtype="object")
            yield out

    return rows.select(F.col("import_id").cast("bigint").alias("import_id"), "device_id", F.unix_millis(F.col("imported_at").cast("timestamp")).alias("arrived"), "date", "readable_date", "locale").mapInPandas(run, _READ)


def _wall(parts: Local) -> int:
    return (datetime(*parts[:6]) - _EPOCH) // timedelta(milliseconds=1) + parts[6]


def _parts(wall: int) -> Local:
    t = _EPOCH + timedelta(milliseconds=wall)
    return t.year, t.month, t.day, t.hour, t.minute, t.second, wall % 1000


def offset_evidence(read: DataFrame) -> DataFrame:
    """device_id, day, paired, offset_min, n: offsets (in steps of a quarter of an hour) that rows with an instant beside a bare local time show,
    and the least offsets at which bare local times don't lie after their ingestion.

    Least offsets that every zone reaches say nothing and are left out. The counts combine before they are shuffled.
    """
    bare_a, bare_b = F.col("local_a").isNotNull() & F.col("zone_a").isNull(), F.col("local_b").isNotNull() & F.col("zone_b").isNull()
    instant = F.when(bare_a, F.col("ms_b")).when(bare_b, F.col("ms_a"))
    wall = F.when(bare_a & (F.col("ms_b").isNotNull() | ~bare_b), F.col("local_a")).when(bare_b, F.col("local_b"))
    shown = F.round((F.expr("wall div 1000 * 1000") - F.expr("instant div 60000 * 60000")) / 900_000).cast("int") * 15
    least = F.ceil((F.col("wall") - F.col("arrived")) / 900_000).cast("int") * 15
    paired = F.col("instant").isNotNull()
    return (
        read.select("device_id", "arrived", instant.alias("instant"), wall.alias("wall")).where("device_id is not null and wall is not null and (instant is not null or arrived is not null)")
        .select("device_id", F.expr("coalesce(instant, wall) div 86400000").cast("int").alias("day"), paired.alias("paired"), F.when(paired, shown).otherwise(least).alias("offset_min"))
        .where(f"offset_min between -{_WIDEST} and {_WIDEST}")
        .groupBy("device_id", "day", "paired", "offset_min").agg(F.count(F.lit(1)).alias("n"))
    )


#: No zone is further from UTC than this many minutes.
_WIDEST = 16 * 60
#: Zones that a task holds evidence against, and by how much more of the rows a zone may be violated than the best one to be as good.
ZONES_A_TASK, AS_GOOD = 40, 0.02


@lru_cache(maxsize=1_000_000)
def _offsets(zone: str, day: int) -> tuple[int, int]:
    """Offsets in minutes at the beginning and the end of a day."""
    z = _zone(zone)
    if z is None:
        return 0, 0
    try:
        return tuple(int((_EPOCH + timedelta(days=day + k)).replace(tzinfo=timezone.utc).astimezone(z).utcoffset().total_seconds() // 60) for k in (0, 1))
    except OverflowError:  # a day at the end of time
        return 0, 0


def zone_votes(evidence: DataFrame) -> DataFrame:
    """device_id, zone, paired, rows, violations, gap: evidence held against zones; ``evidence``: as ``offset_evidence``, and zones array<string>.

    ``gap``: minutes between the local times and their ingestion, where they lie before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, list[float]] = {}
            for device, day, paired, seen, n, zones in batch.itertuples(index=False, name=None):
                for z in zones:
                    begin, end = _offsets(z, day)
                    s = sums.setdefault((device, z, paired), [0, 0, 0])
                    s[0] += n
                    if paired:  # the day of a change may show either offset
                        s[1] += 0 if seen in (begin, end) else n
                    elif max(begin, end) < seen:
                        s[1] += n
                    else:
                        s[2] += n * (min(begin, end) - seen)
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["device_id", "zone", "paired", "rows", "violations", "gap"]).astype(
                {"device_id": "int64", "zone": "object", "paired": "bool", "rows": "int64", "violations": "int64", "gap": "int64"})

    votes = evidence.select("device_id", "day", "paired", "offset_min", "n", "zones").mapInPandas(run, "device_id bigint, zone string, paired boolean, rows bigint, violations bigint, gap bigint")
    return votes.groupBy("device_id", "zone", "paired").agg(*[F.sum(c).alias(c) for c in ("rows", "violations", "gap")])


def estimated_zones(read: DataFrame, devices: DataFrame) -> DataFrame:
    """device_id (bigint), zone: for every device with a usable or estimable zone."""
    spark = devices.sparkSession
    declared = devices.select(F.col("device_id").cast("bigint").alias("device_id"), F.col("zone_id").alias("declared")).where("device_id is not null").dropDuplicates(["device_id"])
    evidence = offset_evidence(read)
    own = zone_votes(evidence.join(declared.where("declared is not null"), "device_id").withColumn("zones", F.array("declared")))
    own = own.groupBy("device_id").agg((F.sum("violations") / F.sum("rows")).alias("own_share"))
    known = sorted(available_timezones())
    judged = cut(
        evidence.select("device_id").distinct().join(declared, "device_id", "full_outer").join(own, "device_id", "left")
        .withColumn("usable", F.coalesce(F.col("declared").isin(known), F.lit(False)))
    )
    stands = F.coalesce("own_share", F.lit(0.0)) <= 0.5
    doubted = judged.where(~F.col("usable") | ~stands)
    if doubted.isEmpty():
        return judged.select("device_id", F.col("declared").alias("zone"))
    # all zones of the database, in a fixed order; a zone that devices declare goes before others
    usual = judged.where("usable").groupBy(F.col("declared").alias("zone")).agg(F.count(F.lit(1)).alias("devices"))
    shares = [known[i : i + ZONES_A_TASK] for i in range(0, len(known), ZONES_A_TASK)]
    lists = F.explode(F.array(*[F.array(*map(F.lit, share)) for share in shares]))
    asked = evidence.join(doubted.select("device_id"), "device_id", "left_semi").withColumn("zones", lists)
    votes = zone_votes(asked.repartition(max(len(shares), int(spark.conf.get("spark.sql.shuffle.partitions"))), "device_id", F.col("zones")[0])).withColumn("share", F.col("violations") / F.col("rows"))
    votes = cut(votes)
    kinds = votes.groupBy("device_id").agg(F.max("paired").alias("paired"))
    votes = votes.join(kinds, ["device_id", "paired"])  # offsets that were seen count alone, where there are any
    least = votes.groupBy("device_id").agg(F.min("share").alias("least"))
    close = votes.join(least, "device_id").where(F.col("share") <= F.col("least") + F.when(F.col("paired"), 0.0).otherwise(AS_GOOD)).join(usual, "zone", "left")
    order = F.struct(F.when(F.col("paired"), F.lit(0.0)).otherwise(F.col("gap") / F.col("rows")), -F.coalesce("devices", F.lit(0)), "zone")
    best = close.groupBy("device_id").agg(F.min_by(F.struct("zone", "share", "paired"), order).alias("best"))
    joined = judged.join(best, "device_id", "left")
    stands = F.col("usable") & ~(~stands & (F.col("best.share") < 0.05) & F.col("best.paired"))
    return joined.select("device_id", F.when(F.coalesce(stands, F.col("usable")), F.col("declared")).otherwise(F.coalesce(F.col("best.zone"), F.col("declared"))).alias("zone"))


def utc_instants(imports: DataFrame, devices: DataFrame) -> DataFrame:
    """import_id, field_name, utc_ms of the values of ``date`` that aren't epoch milliseconds yet and of ``readable_date``."""
    base = imports.select("import_id", F.col("device_id").cast("bigint").alias("device_id"), "date", "readable_date", "imported_at")
    locales = devices.select(F.col("device_id").cast("bigint").alias("device_id"), "locale").dropDuplicates(["device_id"])
    read = cut(read_fields(base.join(locales, "device_id", "left")))
    # an instant needs no zone
    plain = read.where("local_a is null and local_b is null")
    apart = F.explode(F.array(
        F.struct(F.lit("date").alias("field_name"), F.when(~F.col("normal"), F.col("ms_a")).alias("utc_ms")), F.struct(F.lit("readable_date").alias("field_name"), F.col("ms_b").alias("utc_ms"))
    ))
    done = plain.select("import_id", apart.alias("x")).select("import_id", "x.field_name", "x.utc_ms").where("utc_ms is not null")
    local = read.where("local_a is not null or local_b is not null").join(estimated_zones(read, devices), "device_id", "left")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, fields, values = [], [], []
            columns = [batch["import_id"].tolist(), batch["normal"].tolist(), *(batch[c].astype("object").where(batch[c].notna(), None).tolist() for c in ("zone", "ms_a", "local_a", "zone_a", "ms_b", "local_b", "zone_b"))]
            for i, normal, zone, ms_a, local_a, zone_a, ms_b, local_b, zone_b in zip(*columns):
                a = [int(ms_a)] if ms_a is not None else _instants(local_a, zone_a, zone)
                b = [int(ms_b)] if ms_b is not None else _instants(local_b, zone_b, zone)
                if a and not normal:
                    ids.append(i)
                    fields.append("date")
                    values.append(_resolve(a, b))
                if b:
                    ids.append(i)
                    fields.append("readable_date")
                    values.append(_resolve(b, a))
            yield pd.DataFrame({"import_id": pd.Series(ids, dtype="int64"), "field_name": pd.Series(fields, dtype="object"), "utc_ms": pd.Series(values, dtype="int64")})

    schema = "import_id bigint, field_name string, utc_ms bigint"
    return done.unionByName(local.select("import_id", "normal", "zone", "ms_a", "local_a", "zone_a", "ms_b", "local_b", "zone_b").mapInPandas(convert, schema))


def _instants(wall: int | None, zone_text: str | None, zone: str | None) -> list[int]:
    return [] if wall is None else candidates(_parts(int(wall)), zone_text, zone)
