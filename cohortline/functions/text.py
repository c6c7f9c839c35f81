"""Text and key normalisation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Spellings of a missing value, per use.
MISSING_TEXT = ("", "nan", "none")
MISSING_RANGE = ("", "nan", "none", "null", "<na>")
# Spellings of a positive and a negative label.
POSITIVE_TEXT = ("yes", "true", "1", "1.0", "y")
NEGATIVE_TEXT = ("no", "false", "0", "0.0", "n")
# Spellings of death in a follow-up form.
DECEASED_TEXT = ("true", "1", "yes", "y", "死亡", "deceased", "dead")


# All Unicode white space (no-break and ideographic blanks too) and the ASCII separators.
SPACE = r"[\s\x1c-\x1f]"


def stripped(value: Column) -> Column:
    """The text without white space of any script at its ends. It names `value` once, so that uses inside one another stay small code."""
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def squeezed(value: Column) -> Column:
    """Stripped, lower-case, runs of white space as one space."""
    return _squeezed(stripped(value))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), rf"(?U){SPACE}+", " ")


def clean_text(value: Column, missing: Iterable[str] = MISSING_TEXT) -> Column:
    """Stripped text; any spelling of a missing value becomes the empty text."""
    words = "|".join(re.escape(m) for m in missing if m)
    return F.regexp_replace(stripped(F.coalesce(value.cast("string"), F.lit(""))), f"(?i)^(?:{words})$", "")


def item_key(value: Column) -> Column:
    return _squeezed(clean_text(value))


def unit_key(value: Column) -> Column:
    """Unit for counting: both micro signs as u, no white space at all."""
    return F.regexp_replace(F.translate(F.lower(clean_text(value)), "μµ", "uu"), rf"(?U){SPACE}+", "")


def unit_key_loose(value: Column) -> Column:
    """Unit for cross-center discovery: a trailing bracket is dropped, inner spaces stay."""
    return stripped(F.regexp_replace(F.translate(F.lower(clean_text(value)), "μµ", "uu"), rf"(?U){SPACE}*\(.*\){SPACE}*$", ""))


def rule_text(value: Column) -> Column:
    """Label as the concept rules see it: `_`, `-` and `/` read as a space."""
    spaced = F.regexp_replace(F.lower(stripped(value)), r"[_\-/]+", " ")
    return F.regexp_replace(spaced, rf"(?U){SPACE}+", " ")


def unquoted(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(value.cast("string")), r"""^["']+|["']+$""", "")))


def binary_label(value: Column) -> Column:
    """1 for a positive spelling, 0 for a negative one, null for anything else."""
    text = unquoted(value)
    return F.when(text.isin(*POSITIVE_TEXT), F.lit(1)).when(text.isin(*NEGATIVE_TEXT), F.lit(0))


def is_positive(value: Column) -> Column:
    return F.coalesce(unquoted(value).isin(*POSITIVE_TEXT), F.lit(False))


def is_deceased(value: Column) -> Column:
    return F.coalesce(unquoted(value).isin(*DECEASED_TEXT), F.lit(False))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(clean_text(v), F.lit("")) for v in values])


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Look a value up in a small fixed table."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]
    return found if default is None else F.coalesce(found, F.lit(default))


def phenotype_key(item: Column, unit: Column, statistic: Column) -> Column:
    """Stable id of an (item, unit, statistic) target."""
    payload = F.concat(squeezed(item), F.lit("\0"), _unit_only(unit), F.lit("\0"), statistic)
    return F.concat(F.lit("phenotype_"), F.substring(F.sha1(payload), 1, 12), F.lit("_"), statistic)


def _unit_only(unit: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.trim(unit)), "μµ", "uu"), rf"(?U){SPACE}+", "")


def row_digest(*parts: Column) -> Column:
    """MD5 of several parts as JSON: a key for caches and deterministic choices."""
    return F.md5(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))


def hash_order(key: Column, seed: int | str) -> Column:
    """Hash text used wherever an order must be random yet repeatable."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def ndc_key(value: Column) -> Column:
    """Drug code cut at the dot and left-padded to 11 digits, never shortened."""
    code = F.substring_index(F.trim(value), ".", 1)
    return F.when(F.length(code) < 11, F.lpad(code, 11, "0")).otherwise(code)
