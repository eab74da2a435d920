"""Field normalisation of business names and addresses.

Word lists are matched on token arrays and padded phrases, not by regular-expression word boundaries, whose meaning differs between engines and alphabets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions.scripts import INDIC, decompose, romanised

# Word lists of the linkage task.
LEGAL_WORDS = "llc inc incorporated corp corporation co company ltd limited pvt private llp pllc lp plc pc sa sas sasu sarl eurl sci snc gmbh the and of des de du la le les et opc dba praivet limiteda limitad praa".split()
LEGAL_PHRASES = ("l l c", "pvt ltd", "doing business as")
GENERIC_WORDS = "group services service center centre enterprises enterprise solutions holdings associates industries international global india consultants co company trading traders ventures partners agency management systems technologies technology".split()
WEB_WORDS = "com net org in fr biz info www".split()
ADDRESS_STOP = "no h na unit apt ste flr nr near po p o dist pmb india usa france".split()
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
STREETS = {
    "street": "st", "road": "rd", "avenue": "ave", "av": "ave", "drive": "dr", "lane": "ln", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "court": "ct", "place": "pl", "highway": "hwy",
    "parkway": "pkwy", "circle": "cir", "terrace": "ter", "square": "sq", "trail": "trl", "north": "n", "south": "s", "east": "e", "west": "w", "apartment": "apt", "suite": "ste", "rue": "r",
    "allee": "all", "chemin": "ch", "impasse": "imp", "route": "rte", "saint": "st", "sainte": "ste", "nagar": "ngr", "colony": "col", "sector": "sec", "floor": "flr", "building": "bldg",
    "near": "nr", "opposite": "opp", "house": "h", "number": "no", "door": "no", "hno": "h no", "mount": "mt", "fort": "ft",
}
DOMAIN = r"(?i)\.(com|in|net|org|co|fr|biz|info)(?![\p{L}\p{N}_])"


def tokens(text: Column) -> Column:
    """The non-empty words of a string with single spaces."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def base_clean(text: Column) -> Column:
    """Lower case, accents dropped, & as "and", all but letters, digits and spaces as a space, single spaces."""
    plain = F.regexp_replace(decompose(F.lower(text)), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N} ]", " "), " +", " "))


def without(text: Column, words: list[str]) -> Column:
    """The string without the given words."""
    return joined(F.filter(tokens(text), lambda t: ~t.isin(words)))


def with_phrases(text: Column, table: dict[str, str]) -> Column:
    """Whole-word replacement of phrases, one after the other, as one expression over a constant list. Spaces are doubled meanwhile, so that neighbours are both met."""
    padded = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    phrases = F.array(*(F.array(F.lit(f" {phrase.replace(' ', '  ')} "), F.lit(f" {to} ")) for phrase, to in table.items()))
    return F.trim(F.regexp_replace(F.aggregate(phrases, padded, lambda out, p: F.replace(out, p[0], p[1])), " +", " "))


def with_words(text: Column, table: dict[str, str]) -> Column:
    """Word by word replacement by a table."""
    words = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return joined(F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(words, t), t)))


def strip_zeros(text: Column) -> Column:
    """Leading zeros of words that begin with digits; one digit stays."""
    return joined(F.transform(tokens(text), lambda t: F.regexp_replace(t, "^0+([0-9])", "$1")))


def core_name(text: Column) -> Column:
    """The name without legal forms and stop words."""
    return without(with_phrases(text, dict.fromkeys(LEGAL_PHRASES, " ")), LEGAL_WORDS)


def initials(text: Column) -> Column:
    return F.array_join(F.transform(tokens(text), lambda t: F.substring(t, 1, 1)), "")


def numbers(text: Column) -> Column:
    """Distinct digit runs, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))


def pair_text(name: Column, address: Column) -> Column:
    return F.concat(name, F.lit(" | "), address)


def name_key(text: Column) -> Column:
    """Distinct sorted ASCII words without legal and common words: equal for names that differ in order and form only."""
    # The shorter list of this key.
    dropped = "llc inc corp corporation co company ltd limited pvt private llp pllc lp plc sa sas sarl group services service center centre the and of".split()
    plain = with_phrases(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), {"l l c": " "})
    return joined(F.array_sort(F.array_distinct(F.filter(tokens(plain), lambda t: ~t.isin(dropped)))))


def loose_clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]", ""), " +", " "))


def word_set(text: Column) -> Column:
    """Distinct ASCII words of three letters or more, and numbers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}|[0-9]+"), F.lit(0)))


def normalise(records: DataFrame) -> DataFrame:
    """entity_id, business_name, business_address, country (null: empty) with src, nn, an, nc, nsp, ncc, init, nums, nonlatin, addr_empty, is_domain."""
    df = records.fillna("", ["business_name", "business_address", "country"])
    name, address = F.col("business_name"), F.col("business_address")
    df = df.withColumns({
        "src": F.substring("entity_id", 2, 1).cast("tinyint"),
        "nn": base_clean(romanised(name)),
        "an": base_clean(romanised(address)),
        "nonlatin": name.rlike(INDIC),
        "addr_empty": address == "",
        "is_domain": name.rlike(DOMAIN),
    })
    df = df.withColumns({"nn": without(F.col("nn"), WEB_WORDS), "an": strip_zeros(with_words(with_phrases(F.col("an"), STATES), STREETS))})
    df = df.withColumns({"nc": core_name(F.col("nn")), "nums": numbers(F.col("an"))})
    return df.withColumns({"nsp": F.replace("nc", F.lit(" "), F.lit("")), "ncc": without(F.col("nc"), GENERIC_WORDS), "init": initials(F.col("nc"))})
