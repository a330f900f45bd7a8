"""Ordered rules, canonical keys and small parsers as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import first_match

# Rules by pattern, first match wins.
DRAWING_CATEGORIES = [(r"(?i)plan|평면", "plan"), (r"(?i)section|단면", "section"), (r"(?i)elev|입면", "elevation"), (r"(?i)detail|상세", "detail")]
ROUTES = [(r"(?i)how many|count|몇", "count"), (r"(?i)where|어디", "location"), (r"(?i)changed|revision|변경", "revision"), (r"(?i)similar|like", "similar")]
MATERIALS = [(r"(?i)concrete|rc", "concrete"), (r"(?i)steel|h-?beam", "steel"), (r"(?i)glass", "glass"), (r"(?i)wood|timber", "wood")]
HTTP = [(r"^429$", "rate_limited"), (r"^(408|5\d\d)$", "retry"), (r"^40[13]$", "denied"), (r"^404$", "missing"), (r"^2\d\d$", "ok")]


def storey(text: Column) -> Column:
    """Canonical storey: basement levels as B1, B2 and so on, floors as 1F, the roof as RF; null without one."""
    t = F.upper(text)
    basement = F.regexp_extract(t, r"(?<![A-Z0-9])B\s*(\d{1,2})\s*F?(?![A-Z0-9])", 1)
    floor = F.regexp_extract(t, r"(?<![A-Z0-9])(\d{1,3})\s*(?:F|FL|층)(?![A-Z0-9])", 1)
    roof = t.rlike(r"(?<![A-Z])(?:RF|ROOF)(?![A-Z])|옥상|지붕")
    return F.when(basement != "", F.concat(F.lit("B"), basement)).when(floor != "", F.concat(floor, F.lit("F"))).when(roof, "RF")


def storey_of(column: Column, name: Column, text: Column) -> Column:
    """The storey column's, or that of name and text if it is blank."""
    return F.when(F.trim(F.coalesce(column, F.lit(""))) != "", storey(column)).otherwise(storey(F.concat_ws(" ", name, text)))


def sections(text: Column) -> Column:
    """Distinct steel sections like H-300x150x6.5x9, in one spelling."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(?<![A-Z0-9])([HCLT]-?\s*\d+(?:\.\d+)?(?:\s*[X×*]\s*\d+(?:\.\d+)?){1,3})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, section_key)))


def section_key(text: Column) -> Column:
    """One spelling of a section: letter, hyphen, sizes joined by x."""
    x = F.regexp_replace(F.regexp_replace(F.upper(text), r"\s+", ""), r"[×*X]", "x")
    return F.regexp_replace(x, r"^([HCLT])-?", "$1-")


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def short_hash(text: Column, n: int = 12) -> Column:
    """First hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(n))


def normalised(text: Column) -> Column:
    """White space in one blank, trimmed, lower-cased: what content hashes are taken of."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def date_token(text: Column) -> Column:
    """A date in a name, as 20240131, 2024-01-31 or 24.01.31."""
    long = F.regexp_extract(text, r"(?<!\d)(20\d{2})[-._]?(0[1-9]|1[0-2])[-._]?(0[1-9]|[12]\d|3[01])(?!\d)", 0)
    brief = F.regexp_extract(text, r"(?<!\d)(\d{2}[-._](?:0[1-9]|1[0-2])[-._](?:0[1-9]|[12]\d|3[01]))(?!\d)", 1)
    digits = F.regexp_replace(F.when(long != "", long).when(brief != "", F.concat(F.lit("20"), brief)), r"\D", "")
    return F.to_date(digits, "yyyyMMdd")


def discipline(path: Column, codes: dict[str, str]) -> Column:
    """The deepest folder that names a discipline wins."""
    parts = F.reverse(F.split(F.upper(path), "/"))
    named = F.create_map(*(F.lit(v) for kv in codes.items() for v in kv))
    return F.get(F.filter(F.transform(parts, lambda p: F.try_element_at(named, p)), lambda v: v.isNotNull()), F.lit(0))


def predicate_name(text: Column) -> Column:
    """Relation types in capitals joined by underscores, with usual synonyms folded."""
    x = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(x.isin("CONTAINS", "HAS_PART"), "CONTAINS").when(x.isin("PART_OF", "BELONGS_TO", "CHILD_OF"), "PART_OF").when(x == "", "RELATED_TO").otherwise(x)


def route(question: Column) -> Column:
    """Route of a question by the first keyword rule."""
    return first_match(question, ROUTES, "search")


def retry_delay(status: Column, attempt: Column) -> Column:
    """Seconds to wait before the next attempt; null if there is none."""
    return F.when(first_match(status.cast("string"), HTTP, "error").isin("retry", "rate_limited"), F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt)))


def room(text: Column, names: list[str]) -> Column:
    """Name, number, area and aliases of a room label such as ``101호 회의실 2 (12,5 m2)``; null if it is none.

    A number may stand before the name, a small index after it; the area is in square metres. Labels over 40 characters
    are none. A name with an index also goes by its spellings with and without a blank.
    """
    known = "|".join(sorted((re.escape(n) for n in names), key=lambda n: (-len(n), n)))
    pattern = rf"(?i)^\s*(?:([A-Z]?\d{{1,4}}[A-Z]?)(?:호실|호)?\s*[-.:)]?\s*)?((?:{known})(?:\s*\d{{1,2}}(?![\d.,]))?)(?:\s*[(\[]?\s*(\d{{1,5}}(?:[.,]\d{{1,3}})?)\s*(?:㎡|m2|m²|sqm)\s*[)\]]?)?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    name = F.regexp_replace(F.trim(part(2)), r"\s+", " ")
    base, index = F.trim(F.regexp_extract(name, r"^(.*?\D)\s*(\d{1,2})$", 1)), F.regexp_extract(name, r"^(.*?\D)\s*(\d{1,2})$", 2)
    aliases = F.when(index != "", F.array_distinct(F.array(name, F.concat(base, index), F.concat(base, F.lit(" "), index))))
    area = F.replace(part(3), F.lit(","), F.lit(".")).cast("double")
    found = F.struct(name.alias("name"), part(1).alias("number"), F.when(area > 0, area).alias("area"), aliases.alias("aliases"))
    return F.when(text.rlike(pattern) & (F.length(text) <= 40), found)


# The semantic type of each schema type that is known.
IFC_TYPES = {
    "IFCPROJECT": "Project", "IFCSITE": "Site", "IFCBUILDING": "Building", "IFCBUILDINGSTOREY": "Storey", "IFCSPACE": "Space", "IFCZONE": "Zone", "IFCWALL": "Wall", "IFCWALLSTANDARDCASE": "Wall",
    "IFCDOOR": "Door", "IFCWINDOW": "Window", "IFCCOLUMN": "Column", "IFCBEAM": "Beam", "IFCSLAB": "Slab", "IFCROOF": "Roof", "IFCSTAIR": "Stair", "IFCRAMP": "Ramp", "IFCFURNITURE": "Furniture",
    "IFCBUILDINGELEMENTPROXY": "BuildingElementProxy",
}


def semantic_type(kind: Column) -> Column:
    """The semantic type of a schema type in any case; ``IFCEntity`` if it is not known."""
    table = F.create_map(*(F.lit(x) for pair in IFC_TYPES.items() for x in pair))
    return F.coalesce(table[F.upper(kind)], F.lit("IFCEntity"))
