"""Column expressions: geography, addresses, bands, labels, units, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Least delay over a distance, at two thirds of the speed of light: ms per km.
MS_PER_KM = 0.005


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in its atan2 form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same, and 0 where either place is (0, 0), which stands for unknown."""
    unknown = ((lat1 == 0) & (lon1 == 0)) | ((lat2 == 0) & (lon2 == 0))
    return F.when(unknown, F.lit(0.0)).otherwise(great_circle_km(lat1, lon1, lat2, lon2))


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    ok = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    part = lambda k: F.get(F.split(ip, r"\."), k).cast("bigint")
    number = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
    return F.when(ok & (F.greatest(*[F.when(ok, part(k)) for k in range(4)]) <= 255), number)


def slash30(number: Column) -> Column:
    return number.bitwiseAND(F.lit(0xFFFFFFFC))


def slash31(number: Column) -> Column:
    return number.bitwiseAND(F.lit(0xFFFFFFFE))


def delay_band(ms: Column) -> Column:
    """Bands of graph drawings and heat maps."""
    return F.when(ms < 2, "green").when(ms <= 10, "yellow").otherwise("red")


def report_band(ms: Column) -> Column:
    """Bands of reports; a negative delay is an alarm."""
    return F.when(ms < 0, "red").when(ms < 5, "green").when(ms < 20, "yellow").otherwise("red")


def identifiable_label(mask: Column) -> Column:
    return F.when(mask, "yes").otherwise("NO")


def pad_right(text: Column, width: int) -> Column:
    """Pads to a visible width: escape sequences count nothing, longer texts stay whole."""
    seen = F.length(F.regexp_replace(text, "\x1b\\[[0-9;]*m", ""))
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - seen, F.lit(0))))


def bar_length(ms: Column, width: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(ms / 50 * width), F.lit(width))).cast("int")


def soft_threshold(v: Column, k: float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - F.lit(k), F.lit(0.0))


def ms_to_ns(ms: Column) -> Column:
    """Truncates toward zero."""
    return (ms * 1e6).cast("bigint")


def us_to_ns(us: Column) -> Column:
    return (us * 1e3).cast("bigint")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def retry_after_seconds(header: Column) -> Column:
    """5 for a missing, bad or negative header, a tenth of a second for 0."""
    n = F.expr("0") if header is None else header.try_cast("int")
    return F.when(n.isNull() | (n < 0), F.lit(5.0)).when(n == 0, F.lit(0.1)).otherwise(n.cast("double"))


def truncated(body: Column, most: int = 200) -> Column:
    """The first bytes of a text, marked where they are not all."""
    raw = body.cast("binary")
    return F.when(F.octet_length(body) <= most, body).otherwise(F.concat(F.decode(F.substring(raw, 1, most), "UTF-8"), F.lit("...")))


def node_label(label: Column, node_id: Column) -> Column:
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", node_id.cast("string")).otherwise(label)


def label_matches(label: Column, query: str) -> Column:
    return F.contains(F.lower(label), F.lower(F.lit(query)))
