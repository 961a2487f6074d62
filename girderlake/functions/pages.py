"""What a page of a structure book shows: identity, coordinates, category, photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderlake.functions import geo
from girderlake.functions.text import collapsed, first_of, without_marks

#: Signs of a page's content.
PHOTO_LABEL = r"(?iu)\bfotos?\b|lichtbild(?:er)?|photographie|photograph(?:ie|en)?"
STRUCTURE_VIEW = r"(?iu)bauwerksansicht|ansicht des bauwerks|gesamtansicht|ansicht der br[uü]cke"
WEAK_VIEW = r"(?iu)\bansicht\b"
DRAWING = r"(?iu)querschnitt|l[aä]ngsschnitt|grundriss|lageplan|bewehrung|regelquerschnitt|konstruktionszeichnung|schnitt\s+[a-zäöü]"
BOOK_COVER = r"(?iu)bauwerksbuch"
CATEGORIES = [
    (r"\[\d+\]\s*S\s*=|(?iu)7\.4\s+Sch[äa]den", "FINDINGS_DAMAGE"),
    (r"Ma[sß]nahmenempfehlung\s*\{|(?iu)Dringlichkeit\s+\S+|7\.6\s+Empfehlungen", "RECOMMENDATIONS"),
    (r"(?:Hauptprüfung|Einfache Prüfung|Sonderprüfung)\s+\d{1,2}\.\d{1,2}\.\d{4}|(?iu)7\.3\s+Durchgef[üu]hrte Pr[üu]fungen", "INSPECTIONS"),
]
#: Pages that may show the photo, and the least score that does.
PHOTO_PAGES, PHOTO_SCORE = 20, 5
#: Words of a document's type or file name that tell its kind.
KINDS = {"is_drawing": "DRAWING|ZEICHNUNG|BAUWERKSPLAN|BESTANDSPLAN", "is_photo": "PHOTO|FOTO|BILD"}
#: A structure's number behind its label, in a table's head, or on one of the lines below a lone label; a road's number.
NUMBER_LABELLED = r"(?i)bauwerks(?:nummer|-?nr\.?)\D{0,20}(\d{5,8})"
NUMBER_HEADED = r"(?iu)nummer\s+stra(?:ss|ß)e\s+ibwnr\s+(\d{5,8})"
NUMBER_BELOW = r"(?i)(?:^|\n)\s*nummer\s*(?:\n[^\n]*){0,3}?\n\s*(\d{5,8})\b"
ROAD_NUMBER = r"\b([ABLK]\s?\d{1,4})\b"
#: The label above a structure's name, lines that are no name, lines that are read below the label, a name's least length.
NAME_LABEL = r"(?i)^bauwerksname\b"
NO_NAME = r"(?iu)nächst|ort|verwaltung|titelblatt|bemerkung|autobahn|die autobahn|version|seite|akten|overath|vilkerath"
NAME_LINES, NAME_LENGTH = 4, 4
#: A page's most categories, the one that gives way to others, and the confidence of those told from text.
MOST_CATEGORIES, GIVES_WAY, TOLD = 4, "DRAWINGS_IMAGES_OTHER", 0.95
#: A labelled value of coordinates.
_LABELLED = r"(?i)(rechtswert|hochwert)\s*:?\s*([0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+|[0-9]+(?:[.,][0-9]+)?)"


def has(text: Column, pattern: str) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(pattern))


def categories(text: Column) -> Column:
    """Categories that a page's own text shows."""
    return F.array_compact(F.array(*[F.when(has(text, p), F.lit(c)) for p, c in CATEGORIES]))


def with_told_categories(given: Column, text: Column) -> Column:
    """A page's given categories (structs of category and confidence, best first), and those that its text shows.

    One that is there stays as it is. A new one goes to the end; where the page has four or more already, its first
    ``DRAWINGS_IMAGES_OTHER`` makes room, and if four are left the new one is not taken. Null means none.
    """
    kind = "array<struct<category:string,confidence:double>>"

    def add(have: Column, new: Column) -> Column:
        names = F.transform(have, lambda x: x["category"])
        at = F.array_position(names, F.lit(GIVES_WAY)).cast("int")
        fewer = F.filter(have, lambda x, i: i != at - 1)
        room = F.when((F.size(have) >= MOST_CATEGORIES) & (at > 0), fewer).otherwise(have)
        one = F.array(F.struct(new.alias("category"), F.lit(TOLD).alias("confidence"))).cast(kind)
        return F.when(F.array_contains(names, new), have).when(F.size(room) < MOST_CATEGORIES, F.concat(room, one)).otherwise(room)

    return F.aggregate(categories(text), F.coalesce(given.cast(kind), F.array().cast(kind)), add)


def photo_score(text: Column, number: Column, by_sight: Column) -> Column:
    """how likely a page shows the structure's photo; by_sight: its text comes from character recognition."""
    size = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    drawing, label = has(text, DRAWING), has(text, PHOTO_LABEL)
    rules = [
        (label, 12),
        (has(text, STRUCTURE_VIEW), 10),
        (~has(text, STRUCTURE_VIEW) & has(text, WEAK_VIEW) & ~drawing, 5),
        ((number <= 12) & size.between(15, 220) & ~drawing, 4),
        ((number == 1) & (size <= 350), 2),
        (by_sight & (number <= 8) & (size <= 200) & ~drawing, 6),
        (has(text, BOOK_COVER) & ~label, -4),
        (drawing, -15),
    ]
    total = F.lit(0)
    for condition, weight in rules:
        total = total + F.when(condition, weight).otherwise(0)
    return total


def structure_number(text: Column) -> Column:
    """the number after its label, else after a table's head."""
    x = collapsed(text)
    labelled = F.regexp_extract(x, NUMBER_LABELLED, 1)
    headed = F.regexp_extract(x, NUMBER_HEADED, 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(headed, F.lit("")))


def road(text: Column) -> Column:
    """the first road number."""
    return F.nullif(F.regexp_extract(collapsed(text), ROAD_NUMBER, 1), F.lit(""))


def metres(text: Column) -> Column:
    grouped = F.rlike(text, F.lit(r"^\d{1,3}(?:\.\d{3})+,\d+$"))
    return F.replace(F.when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text), F.lit(","), F.lit(".")).try_cast("double")


def coordinates(pages: DataFrame, text_col: str) -> DataFrame:
    """M9: adds latitude, longitude and method of the first labelled pair; the values' ranges tell which is which, and which map."""
    values = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(_LABELLED), F.lit(2)), metres)
    df = pages.withColumn("_values", values).withColumns({"_a": F.get("_values", F.lit(0)), "_b": F.get("_values", F.lit(1))})
    between = lambda lo, hi: first_of((F.col("_a").between(lo, hi), F.col("_a")), (F.col("_b").between(lo, hi), F.col("_b")))
    df = df.withColumns({"_up": between(5_200_000, 6_200_000), "_utm": between(250_000, 850_000), "_gk": between(2_400_000, 5_600_000)})
    df = df.withColumn("method", first_of((F.col("_up").isNotNull() & F.col("_utm").isNotNull(), "UTM_ETRS89_TO_WGS84"), (F.col("_up").isNotNull() & F.col("_gk").isNotNull(), "GAUSS_KRUEGER_DHDN_TO_WGS84")))
    df = geo.utm(df, F.col("_utm"), F.col("_up"), F.lit(32)).withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    df = geo.gauss_krueger(df, F.col("_gk"), F.col("_up"))
    by = lambda one, two: first_of((F.col("method") == "UTM_ETRS89_TO_WGS84", F.col(one)), (F.col("method").isNotNull(), F.col(two)))
    return df.select(*pages.columns, geo.clamped(by("_lat", "latitude"), 90).alias("latitude"), geo.clamped(by("_lon", "longitude"), 180).alias("longitude"), "method")


def safe_filename(name: Column) -> Column:
    """the last part of a path, in plain characters, with its ending."""
    leaf = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    plain = without_marks(leaf)
    stem = F.regexp_replace(F.regexp_replace(plain, r"(?i)\.pdf$", ""), r"[^A-Za-z0-9._-]+", "-")
    stem = F.substring(F.regexp_replace(stem, r"^[.-]+|[.-]+$", ""), 1, 176)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("bauwerksbuch")), F.lit(".pdf"))


def document_kinds(type_: Column, filename: Column) -> dict[str, Column]:
    """whether a document shows drawings, and whether it shows photos."""
    told = F.upper(F.concat_ws(" ", type_, filename))
    return {name: F.rlike(told, F.lit(words)) for name, words in KINDS.items()}


def page_url(url: Column, number: Column) -> Column:
    """An http address with the page as its fragment; anything else is null."""
    base = F.regexp_replace(url, "#.*$", "")
    good = F.rlike(url, F.lit(r"(?i)^https?://[^\s/]+"))
    return F.when(good, F.when(number.isNotNull(), F.concat(base, F.lit("#page="), number.cast("string"))).otherwise(url))
