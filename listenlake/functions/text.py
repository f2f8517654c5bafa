"""Column functions on names, identifiers and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Words for operators in names of columns; fixed values.
OPERATOR_WORDS = ((" - ", "_minus_"), (" + ", "_plus_"), (" * ", "_mul_"), (" / ", "_div_"))


def clean_uuid(c: Column) -> Column:
    """The trimmed id if it is a whole UUID, else null."""
    return F.when(F.trim(c).rlike(UUID), F.trim(c))


def is_identifier(c: Column) -> Column:
    """36 hexadecimal digits or dashes: an id; anything else is taken for a name."""
    return c.rlike(r"^[0-9a-fA-F-]{36}$")


def blank(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def empty(c: Column) -> Column:
    """Null or the empty string."""
    return F.coalesce(c == "", F.lit(True))


def epoch_to_timestamp(c: Column) -> Column:
    """UTC timestamp of epoch seconds; null where the text is not a whole number."""
    return F.timestamp_seconds(c.try_cast("long"))


def parse_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def split_variants(c: Column, seps: str = "{") -> Column:
    """Trimmed, non-empty parts in order; ``seps`` are the characters that part them."""
    return F.filter(F.transform(F.split(c, "[" + "".join("\\" + s for s in seps) + "]"), lambda x: F.trim(x)), lambda x: x != "")


def signature(parts: Column) -> Column:
    """Trimmed, non-blank names, sorted and joined: what a group of variants is known by."""
    return F.array_join(F.array_sort(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")), "{")


def signature_hash(sig: Column) -> Column:
    return F.sha2(sig.cast("binary"), 256)


def length_stats(c: Column) -> Column:
    """Struct of sum, number, mean, maximum and population deviation of the lengths of the trimmed variants; nulls if none."""
    n = F.transform(split_variants(c), lambda x: F.length(x))
    count, total = F.size(n), F.aggregate(n, F.lit(0), lambda a, x: a + x)
    mean = F.try_divide(total.cast("double"), count)
    spread = F.sqrt(F.try_divide(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x), count) - mean * mean)
    return F.struct(
        F.when(count > 0, total).cast("long").alias("sig_len"),
        F.when(count > 0, count).cast("long").alias("n_variants"),
        mean.alias("avg_len"),
        F.array_max(n).cast("long").alias("max_len"),
        F.sqrt(F.greatest(spread * spread, F.lit(0.0))).alias("var_len"),
    )


def fold(c: Column) -> Column:
    """Case folding: texts that differ in case alone are equal after it, sharp s and its two letters and all forms of sigma among them; accents stay.

    Upper case first spells out what has no single lower letter; what stands between the two keeps the optimizer from leaving it out. The
    dotless i keeps apart from the dotted one.
    """
    upper = F.translate(F.upper(F.translate(c, "ıẞ", "\ue000ß")), "\ue000", "ı")
    return F.translate(F.lower(upper), "ς", "σ")


def alike(c: Column, accents: bool = False) -> Column:
    """A key for joins and groupings that are blind to case, and to accents unless they are to count; texts that are canonically equal are equal."""
    return F.collate(c, "UNICODE_CI" if accents else "UNICODE_CI_AI")


def token_sort(c: Column) -> Column:
    """Trimmed words without regard to case, in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.split(F.trim(fold(c)), r"\s+")), " ")


def sanitize(c: Column) -> Column:
    """A name of word characters only: signs of operators become words, all else between words one underscore, none at the ends."""
    for sign, word in OPERATOR_WORDS:
        c = F.replace(c, F.lit(sign), F.lit(word))
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\W+", "_"), "^_+|_+$", "")


def json_block(c: Column, schema: str) -> Column:
    """The first {...} block of a text, read by ``schema``; null if there is none or it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*?\}", 0), F.lit("")), schema)


def confident_answer(c: Column) -> Column:
    """(country_iso2, confidence) of an answer that holds a JSON block; a confidence that is no number, or missing, is 0."""
    r = json_block(c, "country_iso2 string, confidence string")
    return F.struct(r["country_iso2"].alias("country_iso2"), F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"))


def strict_date(c: Column) -> Column:
    """A date; text that is none is an error."""
    return F.when(c.isNotNull(), F.coalesce(F.try_to_date(c), F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")))


def zipped_differences(a: Column, b: Column) -> Column:
    """Places at which two texts differ, up to the end of the shorter."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), 1).otherwise(0)))


def request_signature(params: Column, secret: str) -> Column:
    """MD5 of the sorted key-value pairs of a map and a secret."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], e["value"]))
    return F.md5(F.concat(F.array_join(pairs, ""), F.lit(secret)).cast("binary"))
