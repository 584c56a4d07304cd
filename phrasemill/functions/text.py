"""Text functions as Column expressions. They run in the JVM; those with higher-order functions outside whole-stage code generation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels and their aliases.
LABELS = ("commercial", "informational", "garbage")
ALIASES = {
    "коммерческий": "commercial",
    "коммерческие": "commercial",
    "commercial": "commercial",
    "transactional": "commercial",
    "информационный": "informational",
    "информационные": "informational",
    "informational": "informational",
    "information": "informational",
    "мусор": "garbage",
    "garbage": "garbage",
    "irrelevant": "garbage",
}
#: Fixed value: letters of a productive wildcard's stem at least.
LEAST_STEM = 4


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def folded(text: Column | str) -> Column:
    """Lower case with ё as е; punctuation stays."""
    return F.replace(F.lower(as_column(text)), F.lit("ё"), F.lit("е"))


def normalize(text: Column | str) -> Column:
    """Lower case, ё as е, every run of other characters than a-z, а-я and digits one space, trimmed.

    What stays is searched: Java takes ten times as long to search for the complement of several ranges.
    """
    return F.array_join(F.regexp_extract_all(folded(text), F.lit("[a-zа-я0-9]+"), F.lit(0)), " ")


def dashed(text: Column | str, most: int, default: str) -> Column:
    """Normalised words joined by dashes, at most `most` characters, or the default."""
    slug = F.replace(normalize(text), F.lit(" "), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(slug, 1, most), F.lit("")), F.lit(default))


def topic_key(text: Column | str) -> Column:
    return dashed(text, 100, "topic")


def slugify(text: Column | str) -> Column:
    return dashed(text, 80, "seo-job")


def word_count(text: Column | str) -> Column:
    return F.size(F.split(F.trim(as_column(text)), r"\s+"))


def label_of(raw: Column | str) -> Column:
    """The label that a raw value names in either language, or null."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(as_column(raw))))


def number(raw: Column | str) -> Column:
    """A lenient number: what does not parse is 0."""
    return F.coalesce(as_column(raw).try_cast("double"), F.lit(0.0))


def rounded(x: Column | str, digits: int) -> Column:
    """Half to even at `digits` decimals, on the double itself."""
    scale = float(10**digits)
    return F.rint(as_column(x) * scale) / scale


def hash32(key: Column | str) -> Column:
    """A stable number from 0 to 2^32 - 1: the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(as_column(key)), 1, 8), 16, 10).cast("bigint")


def unit_interval(key: Column | str, salt: str) -> Column:
    """A stable pseudo-random number from 0 to 1."""
    return hash32(F.concat(as_column(key), F.lit(salt))).cast("double") / F.lit(4294967295.0)


def in_sample(key: Column | str, divisor: int) -> Column:
    """Whether the key falls in the fixed 1/divisor sample."""
    return hash32(key) % divisor == 0


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


# -- markers: lists on the driver, one alternation on the executors --------------------------------------------------


def marker_text(marker: str) -> str:
    """A marker in normal form; `*` stays."""
    return re.sub(r"\s+", " ", re.sub(r"[^a-zа-я0-9*]+", " ", str(marker).lower().replace("ё", "е"))).strip()


def marker_regex(markers: Iterable[str]) -> str | None:
    """One pattern for a list of markers, each between white space or ends; None for an empty list."""
    forms = [marker_text(m) for m in markers]
    bodies = [f.replace("*", "[a-zа-я0-9]*") for f in dict.fromkeys(forms) if f]
    return rf"(?:^|\s)(?:{'|'.join(bodies)})(?:$|\s)" if bodies else None


def hits(text: Column | str, markers: Iterable[str]) -> Column:
    """Whether any marker occurs in the (normalised or folded) text."""
    pattern = marker_regex(markers)
    return F.coalesce(as_column(text).rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def unsafe_reason(marker: str) -> str | None:
    """Why a marker must not decide: nothing in it, or a wildcard with a short stem."""
    form = marker_text(marker)
    if not form:
        return "empty"
    short = any("*" in t and len(t.replace("*", "")) < LEAST_STEM for t in form.split())
    return "wildcard_stem_too_short" if short else None


def safe_markers(markers: Iterable[str]) -> list[str]:
    return [str(m) for m in markers if unsafe_reason(m) is None]


def unsafe_reason_column(marker: Column | str) -> Column:
    """unsafe_reason for a column of markers."""
    form = F.trim(F.regexp_replace(folded(marker), "[^a-zа-я0-9*]+", " "))
    short = F.exists(F.split(form, " "), lambda t: t.contains("*") & (F.char_length(F.replace(t, F.lit("*"), F.lit(""))) < LEAST_STEM))
    return F.when(form == "", "empty").when(short, "wildcard_stem_too_short")


def overlaps(marker: str, signals: Iterable[str]) -> bool:
    """Whether the marker's stem begins like a token of a signal, or the other way round."""
    stem = marker_text(marker).rstrip("*")
    others = [t.rstrip("*") for s in signals for t in marker_text(s).split()]
    return bool(stem) and any(o and (stem.startswith(o) or o.startswith(stem)) for o in others)


# -- delimited text in a cell --------------------------------------------------------------------------------------------


def inline_fields(text: Column | str, arity: int) -> Column:
    """The ';'-separated entries of '|'-separated fields, trimmed, as arrays; entries of another arity or with an empty field are left out."""
    entries = F.transform(F.split(as_column(text), ";"), lambda e: F.transform(F.split(e, r"\|"), lambda x: F.trim(x)))
    return F.filter(entries, lambda e: (F.size(e) == arity) & F.forall(e, lambda x: x != ""))


def policy_list(text: Column | str, most: int) -> Column:
    """The ';'-separated values, white space collapsed, the first of those that differ only in case, at most `most`."""
    values = F.filter(F.transform(F.split(as_column(text), ";"), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    lowered = F.transform(values, lambda v: F.lower(v))
    first = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: F.array_position(lowered, F.lower(s["v"])) == s["i"] + 1)
    return F.slice(F.transform(first, lambda s: s["v"]), 1, most)
