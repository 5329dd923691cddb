"""Product identity of texts: brand, type, part number, model, model family, variant, key and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brands in order, each with the words that name it; the first that stands in a text wins.
BRANDS = (
    ("HP", r"HEWLETT\s+PACKARD|HEWLETT-PACKARD|HP\s+INC|HP\s+COMPANY|HP"),
    ("DELL", r"DELL\s+MARKETING|DELL\s+COMPUTER|DELL\s+INC|DELL"),
    ("CISCO", r"CISCO\s+SYSTEMS|CISCO\s+MERAKI|CISCO|MERAKI"),
    ("GE", r"GENERAL\s+ELECTRIC|GE\s+ENERGY|GE\s+LIGHTING|GE"),
    ("SQUARE D", r"SQUARE\s+D|SQUARED"),
    ("SCHNEIDER", r"SCHNEIDER\s+ELECTRIC|SCHNEIDER"),
    ("THOMAS & BETTS", r"THOMAS\s*&\s*BETTS|THOMAS\s+AND\s+BETTS|T\s*&\s*B"),
    ("CROUSE HINDS", r"CROUSE[\s\-]+HINDS|COOPER\s+CROUSE[\s\-]+HINDS"),
    ("EATON", r"CUTLER[\s\-]+HAMMER|EATON[\s\/]+CUTLER[\s\-]+HAMMER|EATON"),
    ("BRIGGS & STRATTON", r"BRIGGS\s*&\s*STRATTON|BRIGGS\s+AND\s+STRATTON"),
    ("KLEIN TOOLS", r"KLEIN\s+TOOLS|KLEIN"),
    ("TRIPP LITE", r"TRIPP\s+LITE|TRIPPLITE"),
    ("FORD METER BOX", r"FORD\s+METER\s+BOX|FORD\s+METER"),
    ("MUELLER", r"MUELLER\s+CO|MUELLER\s+COMPANY|MUELLER"),
    ("VICTAULIC", r"VICTAULIC\s+CO|VICTAULIC\s+COMPANY|VICTAULIC"),
    ("MOTOROLA", r"MOTOROLA\s+SOLUTIONS|MOTOROLA"),
    ("3M", r"3M\s+COMPANY|3M\s+CORP|3M"),
    ("CATERPILLAR", r"CATERPILLAR\s+INC|CATERPILLAR|CAT"),
    ("CUMMINS", r"CUMMINS\s+ENGINE|CUMMINS\s+POWER|CUMMINS"),
    ("TYLER", r"TYLER\s+PIPE|TYLER\s+UNION|TYLER"),
    ("KENNEDY", r"KENNEDY\s+VALVE|KENNEDY"),
    ("BADGER", r"BADGER\s+METER|BADGER"),
    ("SENSUS", r"SENSUS\s+METERING|SENSUS"),
    ("NEPTUNE", r"NEPTUNE\s+TECHNOLOGY|NEPTUNE"),
    ("NIBCO", r"NIBCO\s+INC|NIBCO"),
    ("CHEVROLET", r"CHEVROLET|CHEVY"),
    ("ACDELCO", r"AC\s*DELCO|ACDELCO"),
    ("MOTORCRAFT", r"MOTORCRAFT"),
    ("LENOVO", r"LENOVO|THINKPAD|THINKCENTRE"),
    ("APPLE", r"APPLE|MACBOOK|IPAD"),
    ("SAMSUNG", r"SAMSUNG"),
    ("ZEBRA", r"ZEBRA"),
    ("EPSON", r"EPSON"),
    ("CANON", r"CANON"),
    ("BROTHER", r"BROTHER"),
    ("PANASONIC", r"PANASONIC|TOUGHBOOK"),
    ("SONY", r"SONY"),
    ("LOGITECH", r"LOGITECH"),
    ("APC", r"APC|AMERICAN\s+POWER\s+CONVERSION"),
    ("XEROX", r"XEROX"),
    ("RICOH", r"RICOH"),
    ("LEXMARK", r"LEXMARK"),
    ("FORTINET", r"FORTINET"),
    ("ARUBA", r"ARUBA"),
    ("SIEMENS", r"SIEMENS"),
    ("ABB", r"ABB"),
    ("HUBBELL", r"HUBBELL"),
    ("LEVITON", r"LEVITON"),
    ("LUTRON", r"LUTRON"),
    ("SYLVANIA", r"SYLVANIA|OSRAM"),
    ("PHILIPS", r"PHILIPS|SIGNIFY"),
    ("KOHLER", r"KOHLER"),
    ("HONDA", r"HONDA"),
    ("GENERAC", r"GENERAC"),
    ("DEWALT", r"DEWALT"),
    ("MILWAUKEE", r"MILWAUKEE"),
    ("BOSCH", r"BOSCH"),
    ("FLUKE", r"FLUKE"),
    ("HACH", r"HACH"),
    ("CARRIER", r"CARRIER"),
    ("TRANE", r"TRANE"),
    ("YORK", r"YORK"),
)
# Product types in order, each with the words that name it; the first that stands in a text wins.
TYPES = (
    ("LAPTOP", r"laptop|notebook|ultrabook|macbook"),
    ("DESKTOP", r"desktop|tower|workstation|microcomputer|optiplex|sff|thinkcentre"),
    ("SERVER", r"server|poweredge|proliant|blade"),
    ("NETWORK_SWITCH", r"switch|switches|catalyst|meraki\s+ms\d+"),
    ("ROUTER_AP", r"router|firewall|access\s+point|ap|wap|meraki\s+mr\d+"),
    ("PRINTER", r"printer|copier|mfp|all-in-one|laserjet|deskjet"),
    ("TRANSFORMER", r"transformer|padmount|substation"),
    ("PUMP_MOTOR", r"pump|motor|centrifugal\s+pump|submersible\s+pump"),
    ("VALVE", r"valve|ball\s+valve|gate\s+valve|check\s+valve|butterfly\s+valve|plug\s+valve"),
    ("PIPE", r"pipe|tubing|hose|conduit"),
    ("FITTING", r"fitting|coupling|elbow|tee|adapter|nipple|bushing|flange|plug"),
    ("LIGHTING", r"light|fixture|luminaire|ballast|lamp|bulb|led|floodlight"),
    ("METER", r"meter|watt-hour|flowmeter|kwh"),
    ("CHEMICAL", r"chemical|reagent|solvent|chlorine|acid|polymer"),
    ("VEHICLE_PART", r"tire|wheel|battery|filter|brake|alternator|starter"),
    ("APPAREL", r"uniform|shirt|pant|jacket|boot|glove|vest|hat"),
    ("FURNITURE", r"chair|desk|table|cabinet|shelf|bookcase"),
)
# Words before a part number and before a model, series whose next word is a model, and variants in order.
PART_NUMBER = r"part\s*#|part\s*no\.?|part\s*number|p\/n|p\.n\.|pn|mfg\s*#|mfg\s*part\s*#|mfr\s*#|cat\s*#|catalog\s*#|item\s*#"
MODEL = r"model\s*#|model\s*no\.?|model\s*number|model"
CODE = r"\s*[:\-=\/]?\s*([a-zA-Z0-9\-\/\.]{3,35})\b"
SERIES = "Latitude|Optiplex|Precision|ThinkPad|ThinkCentre|PowerEdge|ProLiant|Catalyst|Meraki|LaserJet|DeskJet"
VARIANTS = (("SFF", r"SFF|SMALL\s+FORM\s+FACTOR"), ("MICRO", "MICRO|USFF|TINY"), ("TOWER", "TOWER|MT"))


def word_pattern(words: str) -> str:
    """Any of the words, whatever their case, between boundaries."""
    return rf"(?i)\b(?:{words})\b"


def first_named(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The first name of the table whose words stand in the text, else null.

    Most texts hold none of the words, so one pattern of them all is asked first;
    only texts with a hit go through the table in order.
    """
    anything = word_pattern("|".join(words for _, words in table))
    ordered = F.coalesce(*[F.when(F.regexp_like(text, F.lit(word_pattern(words))), F.lit(name)) for name, words in table])
    return F.when(F.regexp_like(text, F.lit(anything)), ordered)


def token(value: Column) -> Column:
    """Upper case, runs of white space, dashes, underscores and slashes as one dash, no marks at either end; null below two characters."""
    joined = F.regexp_replace(F.upper(F.trim(value)), r"[\s\-_/]+", "-")
    clean = F.regexp_replace(joined, "^[^A-Z0-9]+|[^A-Z0-9]+$", "")
    return F.when(F.length(clean) >= 2, clean)


def _blank(value: Column) -> Column:
    """Null for an empty value."""
    return F.when(value != "", value)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return _blank(F.regexp_extract(text, pattern, group))


def product_identity(text: Column, brand: Column, model: Column, part_number: Column, code: Column, family: Column, unit: Column) -> dict[str, Column]:
    """Columns of a line's identity. brand, model and part_number are what is known beforehand, null or empty where nothing is.

    A part number makes the key, else brand and model, else brand and type, else type
    alone. A series in the text overrides a model that was known.
    """
    series = F.upper(_found(text, rf"(?i)\b({SERIES})\s+([a-zA-Z0-9\-]{{3,15}})\b"))
    number = F.upper(_found(text, rf"(?i)\b({SERIES})\s+([a-zA-Z0-9\-]{{3,15}})\b", 2))
    digits = _found(number, r"(\d{2,4})")
    kind = F.coalesce(first_named(text, TYPES), F.lit("OTHER"))
    maker = token(F.coalesce(_blank(brand), first_named(text, BRANDS)))
    named = token(F.coalesce(F.when(series.isNotNull(), F.concat(series, F.lit(" "), number)), _blank(model), token(_found(text, rf"(?i)\b(?:{MODEL}){CODE}"))))
    part = token(F.coalesce(_blank(part_number), token(_found(text, rf"(?i)\b(?:{PART_NUMBER}){CODE}"))))
    group = F.when(digits.isNull(), series).when(F.length(digits) == 4, F.concat(series, F.lit(" "), F.left(digits, F.lit(1)), F.lit("000"))).otherwise(F.concat(series, F.lit(" "), digits))
    bare = [F.trim(F.coalesce(x.cast("string"), F.lit(""))) for x in (code, family, unit)]
    c, f, u = bare

    def key(*parts: Column) -> Column:
        return F.concat(*[x for p in parts for x in (p, F.lit("|"))][:-1])

    keys = F.when(part.isNotNull(), key(c, F.concat(F.lit("MPN:"), part), u)).when(maker.isNotNull() & named.isNotNull(), key(c, maker, named, u)).when(maker.isNotNull(), key(f, maker, kind, u)).otherwise(key(c, kind, u))
    trust = F.when(part.isNotNull() | (maker.isNotNull() & named.isNotNull()), "HIGH").when(maker.isNotNull(), "MEDIUM").otherwise("LOW")
    return {"brand": maker, "model": named, "model_family": token(group), "part_number": part, "product_type": kind, "variant": first_named(text, VARIANTS), "identity_key": keys, "confidence": trust}


def stratified_key(known: Column, text: Column, code: Column, unit: Column) -> Column:
    """The known key; where it is empty or generic, one of the code, the text's first four words and the unit (EA where none is given)."""
    words = F.slice(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), 1), F.upper), 1, 4)
    own = F.concat_ws("|", F.trim(F.coalesce(code, F.lit(""))), F.lit("GENERIC"), F.coalesce(_blank(F.array_join(words, "_")), F.lit("GENERIC")), F.coalesce(_blank(F.upper(F.trim(unit))), F.lit("EA")))
    given = F.trim(F.coalesce(known, F.lit("")))
    return F.when((given != "") & ~F.contains(given, F.lit("GENERIC")), given).otherwise(own)
