"""Identifiers, JSON and text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's alphabet, a fixed value.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_of(ms: Column, digits: Column) -> Column:
    """A sortable id of a time in milliseconds and a number, without randomness."""
    at = lambda n, i: F.substring(F.lit(CROCKFORD), (F.shiftright(n, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*(at(ms, i) for i in range(9, -1, -1)), F.lit("0000"), *(at(digits, i) for i in range(11, -1, -1)))


def ulid_ms(ulid: Column) -> Column:
    return sum(((F.position(F.substring(ulid, i + 1, 1), F.lit(CROCKFORD)) - 1).cast("long") * (1 << 5 * (9 - i)) for i in range(10)), F.lit(0).cast("long"))


def frame_parts(ref: Column) -> tuple[Column, Column, Column]:
    """Camera, epoch and sequence of cam/eN/fM; what is missing is 0."""
    part = lambda p: F.coalesce(F.try_to_number(F.regexp_extract(ref, p, 1), F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))
    return F.split_part(ref, F.lit("/"), F.lit(1)), part(r"/e(\d+)"), part(r"/f(\d+)")


def state_of_answer(raw: Column) -> Column:
    said = F.lower(F.trim(raw))
    return F.when(raw.isNull(), None).when(said == "not_visible", "NOT_VISIBLE").when(said == "unknown", "UNKNOWN").when(said.isin("none", "absent"), "ABSENT").otherwise("PRESENT")


def bounded(text: Column, most: int = 255) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def scrubbed(text: Column) -> Column:
    """Text with secret-shaped parts replaced; at most 2000 characters."""
    plain = F.regexp_replace(text, r"(?i)(password|secret|token|api_?key)\s*[:=]\s*\S+", "$1=[redacted]")
    return F.substring(F.regexp_replace(plain, r"[0-9a-f]{32,}", "[redacted]"), 1, 2000)


def path_safe(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def key_values(raw: Column, declared: tuple[str, ...]) -> Column:
    """Declared keys of `key: value` lines as a map; the last line of a key counts."""
    pairs = F.transform(F.split(raw, "\n"), lambda line: F.struct(F.trim(F.split_part(line, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_extract(line, ":(.*)$", 1)).alias("v")))
    return F.map_from_arrays(F.array(*(F.lit(k) for k in declared)), F.array(*(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(pairs, _of(k)), lambda p: p["v"])), -1) for k in declared)))


def _of(key: str):  # noqa: ANN202
    return lambda p: p["k"] == key


def percentile_floor(values: Column, f: float) -> Column:
    """The sorted value at index min(n-1, int(f*n))."""
    s = F.array_sort(values)
    return F.element_at(s, F.least(F.size(s), F.floor(F.lit(f) * F.size(s)).cast("int") + 1))


def percentile_nearest(values: Column, f: float) -> Column:
    """The sorted value at index round(f*n)-1, halves to even, from 0."""
    s = F.array_sort(values)
    return F.element_at(s, F.greatest(F.lit(1), F.bround(F.lit(f) * F.size(s)).cast("int")))
