"""Text expressions: null tokens, labels, names and log-name parsing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions import fixed

_ACCENTS = (
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
    "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy",
)


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: str | Column, tokens: Sequence[str] = fixed.TABLE_NULLS) -> Column:
    """Trimmed text; null for the given tokens, compared in lower case."""
    text = F.trim(_c(value).cast("string"))
    return F.when(~F.lower(text).isin(list(tokens)), text)


def strict_boolean(value: str | Column) -> Column:
    """true / false / unknown. Use ``unknown_boolean`` to list tokens that are none of these."""
    text = _c(value).cast("string")
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def unknown_boolean(value: str | Column) -> Column:
    text = _c(value).cast("string")
    return text.isNotNull() & ~text.isin("", "true", "false")


def lenient_boolean(value: str | Column) -> Column:
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def iso_date(value: str | Column) -> Column:
    """The date text if it reads as an ISO date or timestamp, null for blank or "unknown"."""
    text = _c(value).cast("string")
    return F.when(~text.isin("", "unknown") & text.try_cast("timestamp").isNotNull() & text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)


def broken_date(value: str | Column) -> Column:
    text = _c(value).cast("string")
    return text.isNotNull() & ~text.isin("", "unknown") & iso_date(text).isNull()


def category(value: str | Column) -> Column:
    """Case-insensitive category label, null for the model's missing tokens (ASCII labels)."""
    text = F.lower(F.trim(_c(value).cast("string")))
    return F.when(~text.isin(fixed.MODEL_NULLS), text)


def group_label(value: str | Column, blanks: Sequence[str] = fixed.DISPLAY_NULLS) -> Column:
    """Display label of a mineral group: upper case, words joined by hyphens, null if not a mineral."""
    text = F.regexp_replace(F.upper(F.trim(_c(value).cast("string"))), r"[\s_]+", "-")
    return F.when(~text.isin(list(blanks)), text)


def fold_name(value: str | Column, drop_brackets: bool = True) -> Column:
    """Letters and digits in lower case, so that spellings of one name meet in a join."""
    text = F.coalesce(_c(value).cast("string"), F.lit(""))
    if drop_brackets:
        text = F.regexp_replace(text, r"\[[^\]]*\]", " ")
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")


def file_stem(value: str | Column, fallback: str = "hole") -> Column:
    text = F.regexp_replace(_c(value).cast("string"), r"[^A-Za-z0-9._-]+", "_")
    text = F.regexp_replace(text, r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(fallback)).otherwise(text)


def file_name(value: str | Column, fallback: str = "item", longest: int = 60) -> Column:
    """A safe file name part: accents folded, unsafe runs to one underscore, length capped."""
    text = F.translate(F.trim(F.coalesce(_c(value).cast("string"), F.lit(""))), *_ACCENTS)
    text = F.regexp_replace(text, r"[^\x00-\x7f]", "")
    text = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
    text = F.regexp_replace(text, r"^[._-]+|[._-]+$", "")
    text = F.when(F.length(text) > longest, F.regexp_replace(F.substring(text, 1, longest), r"[._-]+$", "")).otherwise(
        text
    )
    return F.when((text == "") | F.upper(text).isin(fixed.RESERVED_NAMES), F.lit(fallback)).otherwise(text)


def column_label(value: str | Column, fallback: str = "Measurement") -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(_c(value).cast("string"), F.lit("")), r"\s+", " "))
    return F.when(text == "", F.lit(fallback)).otherwise(text)


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def species_group(value: str | Column, table: Mapping[str, str] = fixed.SPECIES_GROUP) -> Column:
    """Mineral group of a species ("Chlorite-FeMg" -> CHLORITE); any other text in upper case."""
    text = _c(value).cast("string")
    return F.coalesce(F.try_element_at(_lookup(table), F.split_part(text, F.lit("-"), F.lit(1))), F.upper(text))


def parse_log_name(value: str | Column) -> Column:
    """struct(family, algorithm, region, variant, token, rank, metric, value_type); null if not a family log."""
    text = _c(value).cast("string")
    pattern = r"^(.+)\s+(" + "|".join(fixed.LOG_FAMILIES) + r")$"
    prefix = F.regexp_extract(text, pattern, 1)
    family = F.regexp_extract(text, pattern, 2)
    ranked = prefix.rlike(r"^(Min|Grp|Wt)\d+$")
    token = F.when(ranked, F.regexp_extract(prefix, r"^(Min|Grp|Wt)\d+$", 1)).otherwise(prefix)
    rank = F.when(ranked, F.regexp_extract(prefix, r"(\d+)$", 1).try_cast("int"))
    part = lambda i: F.try_element_at(_lookup({k: v[i] for k, v in fixed.LOG_FAMILIES.items()}), family)
    metric = lambda i: F.try_element_at(_lookup({k: v[i] for k, v in fixed.LOG_METRICS.items()}), token)
    return F.when(
        text.rlike(pattern),
        F.struct(
            family.alias("family"), part(0).alias("algorithm"), part(1).alias("region"), part(2).alias("variant"),
            token.alias("token"), rank.alias("rank"), metric(0).alias("metric"), metric(1).alias("value_type"),
        ),
    )


def number_text(value: str | Column) -> Column:
    """Compact text of a number: no decimals for whole numbers, six significant digits otherwise (a tie goes to the even one).

    Below 0.0001 and from a million on in magnitude, numbers that are not whole have an
    exponent of two digits at least (1.5e-05).
    """
    x = _c(value).cast("double")
    places = F.floor(F.log10(F.abs(x))).cast("int")
    digits = F.greatest(F.lit(5) - places, F.lit(0))
    scale = F.pow(F.lit(10.0), digits)
    short = lambda c, form: F.regexp_replace(F.regexp_replace(F.format_string(form, c), r"0+$", ""), r"\.$", "")
    plain = short(F.rint(x * scale) / scale, "%.12f")
    # the mantissa may round up to ten
    first = F.rint(x / F.pow(F.lit(10.0), places) * 100000.0) / 100000.0
    over = F.abs(first) >= 10
    power = places + F.when(over, 1).otherwise(0)
    mantissa = short(F.when(over, first / 10.0).otherwise(first), "%.5f")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    long_exponent = F.when(F.abs(power) > 99, F.concat(F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))).otherwise(exponent)
    outside = (power < -4) | (power >= 6)
    return F.when(x == F.floor(x), x.cast("long").cast("string")).when(outside, F.concat(mantissa, long_exponent)).otherwise(plain)


def wavelength_column(value: str | Column, unit: str | Column) -> Column:
    """Column name of one wavelength, e.g. wl_2200p5_nm."""
    number = F.replace(F.replace(number_text(value), F.lit("-"), F.lit("neg_")), F.lit("."), F.lit("p"))
    name = F.lower(F.regexp_replace(F.regexp_replace(_c(unit), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.concat(F.lit("wl_"), number, F.lit("_"), name)


def safe_object_key(value: str | Column) -> Column:
    """True for a relative path that stays below its root."""
    text = F.coalesce(_c(value), F.lit(""))
    return (text != "") & ~text.rlike(r"^[/\\]|:|(^|[/\\])\.\.([/\\]|$)")


def class_name(value: str | Column, classes: str | Column, blanks: Sequence[str] = ()) -> Column:
    """Name of a class code; text that is already a name passes through."""
    text = F.trim(_c(value).cast("string"))
    code = text.try_cast("double").cast("int")
    name = F.when(code.isNotNull(), F.try_element_at(_c(classes), code)).otherwise(text)
    return F.when(~name.isin("", *blanks), name)


def decode_path_name(value: str | Column) -> Column:
    """Percent-decoding that leaves a plus sign alone; malformed escapes give null."""
    return F.try_url_decode(F.replace(_c(value), F.lit("+"), F.lit("%2B")))


def fold_column(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def resolve_columns(
    columns: Iterable[str], roles: Mapping[str, Sequence[str]] = fixed.ROLE_COLUMNS
) -> dict[str, str | None]:
    """Plan-time: the column playing each role, by exact folded name first, then by prefix."""
    folded = {fold_column(c): c for c in columns}
    found: dict[str, str | None] = {}
    for role, names in roles.items():
        exact = next((folded[n] for n in names if n in folded), None)
        prefixed = (column for n in names for key, column in folded.items() if key.startswith(n))
        found[role] = exact or next(prefixed, None)
    return found
