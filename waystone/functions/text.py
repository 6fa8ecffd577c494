"""Column functions on names and titles (STR-01 to STR-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII and the ideographic space, by rule: U+FF01 to U+FF5E lie 0xFEE0 above U+0021 to U+007E.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　 "
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "
#: Any character outside ASCII, kana, common ideographs, their punctuation and what translate() folds: only rows with
#: one of these can need true NFKC.
COMPATIBILITY = "[^\\x00-\\x7Eぁ-ゖァ-ヺー・、-〗一-鿿！-～\u3000\u00a0]"


def clean(c: Column) -> Column:
    """STR-01: full-width forms to ASCII, white space collapsed, ends trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.translate(c, WIDE, NARROW), r"\s+", " "))


def station_key(name: Column) -> Column:
    """STR-02: a station's name without the 道の駅 prefix, spaces, dots and dashes."""
    return F.regexp_replace(F.regexp_replace(clean(name), "^道の駅", ""), r"[\s・･.\-‐–—]", "")


def title_key(c: Column) -> Column:
    """STR-03: lower case, without brackets, punctuation and spaces (lower, not casefold)."""
    return F.regexp_replace(F.lower(clean(c)), r"[\s「」『』【】\[\]()!?、。・,.\-]", "")


def canonical_title(c: Column) -> Column:
    """STR-04: without bullets and the leading bracket label."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean(c), r"^[・●◆■*]+\s*", ""), r"^[【\[][^】\]]*[】\]]\s*", ""))


def identity_title(c: Column, station: Column) -> Column:
    """STR-05: drops a leading bracket label only if it names this row's station."""
    text = clean(c)
    label = F.trim(F.regexp_extract(text, r"^[【\[]([^】\]]*)[】\]]", 1))
    rest = F.trim(F.regexp_replace(text, r"^[【\[][^】\]]*[】\]]", ""))
    return F.when(station_key(label) == station_key(station), rest).otherwise(text)


def subject(c: Column) -> Column:
    """STR-06: the last quoted name, else the title without boilerplate."""
    quoted = F.regexp_extract_all(clean(c), F.lit("[「『]([^」』]+)[」』]"), F.lit(1))
    plain = F.trim(F.regexp_replace(canonical_title(c), "(開催|のお知らせ|について|イベント|NEW)", ""))
    return F.coalesce(F.try_element_at(quoted, F.lit(-1)), plain)


def strip_badges(c: Column) -> Column:
    """STR-07: without a trailing NEW badge, a leading publication date and an EVENT or NEWS card prefix."""
    text = F.regexp_replace(clean(c), r"(?i)\s+new!?$", "")
    text = F.regexp_replace(text, r"^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}\s*", "")
    return F.trim(F.regexp_replace(text, r"(?i)^(event|news)\s+", ""))


def prefecture_key(c: Column) -> Column:
    """STR-08: without the suffix 都, 道, 府 or 県."""
    return F.regexp_replace(F.trim(c), "[都道府県]$", "")


def station_from_title(c: Column) -> Column:
    """STR-09: the station that the first bracket or quotation names, else null."""
    text = clean(c)
    label = F.coalesce(F.nullif(F.regexp_extract(text, r"[【\[]([^】\]]+)[】\]]", 1), F.lit("")), F.nullif(F.regexp_extract(text, "道の駅\\s*「([^」]+)」", 1), F.lit("")))
    return F.trim(F.regexp_replace(label, r"^道の駅\s*", ""))


def first_contained(c: Column, names: list[str]) -> Column:
    """STR-10: the first entry of a fixed dictionary, in its order, that the text contains."""
    return F.try_element_at(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(c, n)), F.lit(1))


def summary(c: Column) -> Column:
    """STR-11: blanks collapsed and a final 。; null if nothing is left."""
    text = clean(c)
    return F.when(text == "", None).when(F.rlike(text, F.lit("[。！？]$")), text).otherwise(F.concat(text, F.lit("。")))


def navigation_query(query: Column, prefecture: Column, name: Column) -> Column:
    """STR-12: the given query, or prefecture and name where it is missing or blank."""
    return F.coalesce(F.nullif(F.trim(query), F.lit("")), F.concat_ws(" ", prefecture, name))


def cell(c: Column, most: int) -> Column:
    """STR-13: at most `most` characters; separators, quotes and line ends as spaces; pipes escaped."""
    return F.regexp_replace(F.regexp_replace(F.substring(c, 1, most), r'[,"\r\n\t]', " "), r"\|", r"\\\\|")


def place_key(kind: Column, id: Column, lat: Column, lng: Column) -> Column:
    """STR-14: `kind:id:<id>`, or `kind:geo:<lat>,<lng>` to six places where there is no id."""
    return F.when(id.isNotNull(), F.concat(kind, F.lit(":id:"), id)).otherwise(F.concat(kind, F.format_string(":geo:%.6f,%.6f", lat, lng)))
