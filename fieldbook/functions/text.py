"""Text and key expressions: formatting, normalising, tokens, trigrams, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(value: Column, width: int) -> Column:
    """A code as text with leading zeros; longer values are not cut."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def composite_key(*parts: tuple[Column, int, str]) -> Column:
    """Fixed-width key of (value, width, filler) parts."""
    return F.concat(*[F.lpad(v.cast("string"), w, fill) for v, w, fill in parts])


def key_part(key: Column, start: int, width: int, filler: str = "0") -> Column:
    """A part of a fixed-width key without its filler; a part of zeros only is the number zero."""
    bare = F.ltrim(F.substring(key, start, width), F.lit(filler))
    return F.when(bare == "", "0").otherwise(bare) if filler == "0" else bare


def house_number(text: Column) -> Column:
    """"12B" -> struct(number, letter): numbers of up to three digits and one optional letter, null otherwise. Structs compare with the letterless first."""
    ok = text.rlike("^[0-9]{1,3}[A-Za-z]?$")
    letter = F.upper(F.regexp_extract(text, "([A-Za-z]?)$", 1))
    return F.when(ok, F.struct(F.regexp_extract(text, "^([0-9]+)", 1).cast("short").alias("number"), F.when(letter != "", letter).alias("letter")))


def format_house_number(h: Column) -> Column:
    return F.concat(h["number"].cast("string"), F.coalesce(h["letter"], F.lit("")))


def address_line(street: Column, number: Column, floor: Column, door: Column, locality: Column, postal: Column, city: Column) -> Column:
    """"Street 12B, 3. tv, Locality, 1234 City"; missing parts leave no marks behind."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    level = F.when(blank(floor).rlike("^(st|kl[0-9]*)$"), blank(floor)).when(blank(floor).isNotNull(), F.concat(blank(floor), F.lit(".")))
    unit = F.nullif(F.concat_ws(" ", level, blank(door)), F.lit(""))
    return F.concat_ws(", ", F.nullif(F.concat_ws(" ", blank(street), blank(number)), F.lit("")), unit, blank(locality), F.nullif(F.concat_ws(" ", blank(postal), blank(city)), F.lit("")))


def iso_local(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def for_indexing(text: Column) -> Column:
    """Separators inside words become blanks."""
    return F.regexp_replace(text, r"[\\./-]", " ")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(for_indexing(text)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_distance(a: Column, b: Column) -> Column:
    """1 - shared / all trigrams; 1 if neither has any."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, 1 - shared / every).otherwise(1.0)


def sort_rank_floor(floor: Column) -> Column:
    """Order of floors: none, basements from the deepest, ground floor, upper floors by number, others."""
    f = F.lower(F.trim(floor))
    return (
        F.when(f.isNull() | (f == ""), F.struct(F.lit(0).alias("group"), F.lit(0).alias("n")))
        .when(f.rlike("^kl[0-9]+$"), F.struct(F.lit(1).alias("group"), (-F.regexp_extract(f, "([0-9]+)", 1).try_cast("int")).alias("n")))
        .when(f == "kl", F.struct(F.lit(1).alias("group"), F.lit(0).alias("n")))
        .when(f == "st", F.struct(F.lit(2).alias("group"), F.lit(0).alias("n")))
        .when(f.rlike("^[0-9]+$"), F.struct(F.lit(3).alias("group"), f.try_cast("int").alias("n")))
        .otherwise(F.struct(F.lit(4).alias("group"), F.lit(0).alias("n")))
    )


def sort_rank_door(door: Column) -> Column:
    """Order of doors: none, left, middle, right, by number, others."""
    d = F.lower(F.trim(door))
    side = F.when(d.isNull() | (d == ""), 0).when(d == "tv", 1).when(d == "mf", 2).when(d == "th", 3).when(d.rlike("^[0-9]+$"), 4).otherwise(5)
    return F.struct(side.alias("group"), F.coalesce(d.try_cast("int"), F.lit(0)).alias("n"))


# Letters with marks and the plain ones they are looked up by.
_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüý", "aaaaaaceeeeiiiinoooooouuuuy"


def unaccented(text: Column) -> Column:
    """Lower case without marks: index and query side alike."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def with_synonyms(tokens: Column, synonyms: dict[str, str]) -> Column:
    """The tokens and, for each that has one, its synonym: index side only."""
    if not synonyms:
        return tokens
    table = F.create_map(*[F.lit(x) for kv in sorted(synonyms.items()) for x in kv])
    return F.array_distinct(F.concat(tokens, F.array_compact(F.transform(tokens, lambda t: table[t]))))


def spoken(address: Column) -> Column:
    """Words for a floor in the register's own form, once each: the last kld behind a number is kl, the first stueplan is st, and the first sal right behind a number goes."""
    out = F.regexp_replace(address, r"(?i)^(.+[0-9]+\s*,?\s+)kld(.+)$", "$1kl$2")
    out = F.regexp_replace(out, r"(?is)^(.*?)stueplan", "$1st")
    return F.regexp_replace(out, r"(?i)^(.*?[0-9][\s.]+)sal([. ,].+)", "$1$2")


# What the parts of a strictly written address may consist of.
_LETTERS = "a-zæøåA-ZÆØÅ"
_STREET = f"[{_LETTERS}0-9äéèëöüÿÄÉÈËÖÜŸ'\\s.,/()-]+?"
_NUMBER = f"[0-9]{{1,3}}\\s*[{_LETTERS}]?(?![{_LETTERS}])"
_FLOOR = "kl|k[1-9]|st|[0-9]{1,2}"
_DOOR = "[a-zæøå0-9/ -]{1,4}"
_LOCALITY = f"[{_LETTERS}éè\\s./,0-9-]+,?"
_CITY = f"[{_LETTERS}\\s.-]+"

#: A strict address: street and number, floor and door behind a comma, locality, postal code and city.
ADDRESS = rf"^\s*({_STREET})\s+({_NUMBER})(?:\s*,\s*(?:({_FLOOR})\.)?\s*({_DOOR})?)?(?:\s*,\s*({_LOCALITY}))?\s*,\s*([0-9]{{4}})\s+({_CITY})$"
_PARTS = ("street", "number", "floor", "door", "locality", "postal", "city")


def address_parts(text: Column) -> Column:
    """Struct of a strictly written address, null where it is none; parts that are missing are null."""
    part = lambda k: F.nullif(F.regexp_extract(text, ADDRESS, k), F.lit(""))
    return F.when(text.rlike(ADDRESS), F.struct(*[part(k).alias(p) for k, p in enumerate(_PARTS, 1)]))


def house_number_between(h: Column, low: Column, high: Column) -> Column:
    """Closed range of house numbers, letters included; an end that is null is open."""
    at = lambda x: F.struct(x["number"], F.coalesce(x["letter"], F.lit("")))
    return F.coalesce(at(h) >= F.when(low.isNotNull(), at(low)), F.lit(True)) & F.coalesce(at(h) <= F.when(high.isNotNull(), at(high)), F.lit(True)) & h.isNotNull()


def house_number_in(h: Column, texts: list[str]) -> Column:
    """Whether a house number is one of some texts; texts that are no house numbers are none's."""
    known = F.filter(F.array(*[house_number(F.lit(t)) for t in texts]), lambda x: x.isNotNull())
    return F.exists(known, lambda x: (x["number"] == h["number"]) & x["letter"].eqNullSafe(h["letter"]))


def postal_blank(code: Column) -> Column:
    """At least four digits behind the blank that a sign would take; longer codes are not cut."""
    return F.concat(F.lit(" "), padded(code, 4))


def local_day(ts: Column, zone: str = "Europe/Copenhagen") -> Column:
    """The day of an instant where the register is kept."""
    return F.date_trunc("day", F.from_utc_timestamp(ts, zone))


def iso_utc(ts: Column) -> Column:
    """An instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def mapped(code: Column, table: dict, other=None) -> Column:
    """A code by a table of values; codes that are not in it give ``other``."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code], F.lit(other)) if other is not None else F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code]


def link(base: str, *parts: Column) -> Column:
    """The address of a row's own page; null where a part of its key is null."""
    return F.concat(F.lit(base.rstrip("/")), *[x for p in parts for x in (F.lit("/"), F.url_encode(p.cast("string")))])


def without_nulls(values: dict[str, Column]) -> Column:
    """Map of the values that are there."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
