"""Identifiers, types, years and dates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.model import dims


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup(c: Column, values: dict, default: object = None) -> Column:
    """A small fixed mapping as a map literal; unknown keys give `default`."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def normalize_doi(c: Column) -> Column:
    """Trimmed, lower case, without the four known beginnings (each goes once, in order)."""
    heads = ("https://doi.org/", "http://doi.org/", "doi.org/", "doi:")
    bare = reduce(lambda x, head: F.regexp_replace(x, f"(?i)^{head.replace('.', '[.]')}", ""), heads, F.trim(c))
    return F.lower(F.trim(bare))


def doi_prefix(c: Column) -> Column:
    return F.substring_index(normalize_doi(c), "/", 1)


def normalize_orcid(c: Column) -> Column:
    """The id at the end of a text or URL, in upper case; null without one."""
    return blank_to_null(F.upper(F.regexp_extract(F.trim(c), r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\s*$", 1)))


def canonical_type(c: Column) -> Column:
    return lookup(F.lower(F.trim(c)), dims.CANONICAL_TYPE)


def source_rank(c: Column) -> Column:
    return lookup(c, dims.SOURCE_RANK, dims.OTHER_RANK)


def oa_version_rank(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(c)), {k.lower(): v for k, v in dims.OA_VERSION_RANK.items()}), F.lit(0))


def short_id(c: Column) -> Column:
    """The last segment of a URL path."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def doi_url(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), c)


def author_key(c: Column) -> tuple[Column, Column]:
    """(orcid, entity id) that a key such as `orcid:…` or `entity:…` names."""
    text = F.trim(c)
    orcid = normalize_orcid(F.regexp_replace(text, "(?i)^orcid:", ""))
    entity = F.when(text.rlike("(?i)^entity:"), F.regexp_replace(text, "(?i)^entity:", "")).when(orcid.isNull(), text)
    return F.when(~text.rlike("(?i)^entity:"), orcid), blank_to_null(F.trim(entity))


def first_year(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"(?:19|20)\d{2}", 0)).try_cast("int")


def reference_year(c: Column) -> Column:
    """A year 18xx to 20xx that no digit touches."""
    return blank_to_null(F.regexp_extract(c, r"(?<!\d)((?:18|19|20)\d{2})(?!\d)", 1)).try_cast("int")


def year_bucket(c: Column, width: int = 5) -> Column:
    low = (F.floor(c / width) * width).cast("int")
    return F.concat(low.cast("string"), F.lit("–"), (low + width - 1).cast("string"))


def date_parts_text(parts: Column) -> Column:
    """[y, m, d] at the precision given, as y-mm-dd."""
    text = F.transform(parts, lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0")))
    return F.array_join(text, "-")


def valid_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), F.lit(False))
