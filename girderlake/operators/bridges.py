"""One bridge record per document: merged from its sections, then completed from text, coordinates and file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderlake.functions import pages
from girderlake.functions.text import collapsed, compatible, first_of
from girderlake.operators import sections
from girderlake.sources.cuts import dealt

#: Fields of a bridge record that sections give and merging keeps.
FIELDS = ["structure_number", "name", "road", "latitude", "longitude"]


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def with_next_lines(book: DataFrame, document: str, number: str, text_col: str, tasks: int | None = None) -> DataFrame:
    """Adds ``own``, a page's trimmed lines, and ``lines``, those and the first four of each of the next four page numbers.

    What a label asks for may stand on a later page. Only heads of pages travel, by a key that one page has, so a
    document of very many pages is nowhere whole. Pages and heads meet in ``tasks`` tasks.
    """
    df = dealt(book, tasks, document, number).withColumn("own", _lines(F.col(text_col)))
    head = F.slice("own", 1, pages.NAME_LINES)
    heads = df.select(F.col(document).alias("_of"), F.explode(F.array(*[F.struct((F.col(number) - k).alias("at"), F.lit(k).alias("k"), head.alias("head")) for k in range(1, pages.NAME_LINES + 1)])).alias("x"))
    heads = dealt(heads.select("_of", F.col("x.at").alias("_at"), "x"), tasks, "_of", "_at").groupBy("_of", "_at").agg(F.array_sort(F.collect_list(F.struct("x.k", "x.head"))).alias("_heads"))
    df = df.join(heads, (F.col(document) == F.col("_of")) & (F.col(number) == F.col("_at")), "left")
    below = F.coalesce(F.flatten(F.transform("_heads", lambda x: x["head"])), F.array().cast("array<string>"))
    return df.withColumn("lines", F.concat("own", below)).drop("_of", "_at", "_heads")


def _told_name() -> Column:
    """the first fit line of the four below a page's first label of a name."""
    at = F.array_position(F.transform("own", lambda x: F.rlike(x, F.lit(pages.NAME_LABEL))), F.lit(True)).cast("int")
    fit = lambda x: (F.length(x) >= pages.NAME_LENGTH) & ~F.rlike(x, F.lit(pages.NO_NAME)) & ~F.rlike(x, F.lit(r"^\d"))
    return F.when(at > 0, F.struct(F.get(F.filter(F.slice("lines", at + 1, pages.NAME_LINES), fit), F.lit(0)).alias("name")))


def told_identity(book: DataFrame, document: str, number: str, text_col: str, tasks: int | None = None) -> DataFrame:
    """by document the structure's number, name and road that its text tells; null where it tells none.

    A rule's first match in page order counts; a number behind its label comes before one in a table's head, and that
    before one on the lines below. Of the name's labels only the first counts, even if no line below it is a name. A
    value is found up to four lines into each of the next four pages. Page numbers are unique within a document.
    """
    df = with_next_lines(book, document, number, text_col, tasks)
    raw = F.array_join("lines", "\n")
    found = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    df = df.select(document, number, _told_name().alias("_name"), raw.alias("_raw"), collapsed(compatible(raw)).alias("_flat"))
    rules = {"_labelled": found(F.col("_flat"), pages.NUMBER_LABELLED), "_headed": found(F.col("_flat"), pages.NUMBER_HEADED), "_below": found(F.col("_raw"), pages.NUMBER_BELOW), "_road": found(F.col("_flat"), pages.ROAD_NUMBER)}
    df = df.withColumns(rules)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(number))).alias(c)
    df = df.groupBy(document).agg(*[first(c) for c in (*rules, "_name")])
    return df.select(document, F.coalesce("_labelled", "_headed", "_below").alias("structure_number"), F.col("_name.name").alias("name"), F.col("_road").alias("road"))


def told_place(book: DataFrame, document: str, number: str, text_col: str) -> DataFrame:
    """M9: by document latitude and longitude of the first page that gives a pair of coordinates, and that page."""
    found = sections.coordinate_pairs(book.select(document, number, text_col), text_col)
    at = F.when(F.col("method").isNotNull(), F.col(number))
    first = found.groupBy(document).agg(F.min_by(F.struct("method", "east", "north"), at).alias("_pair"), F.min(at).alias("place_page"))
    return sections.located(first.select(document, "_pair.*", "place_page")).select(document, "latitude", "longitude", "place_page")


def _ranked(field: str, sources: dict[str, Column]) -> list[Column]:
    """The first source that has a value, and its name."""
    return [F.coalesce(*sources.values()).alias(field), first_of(*[(c.isNotNull(), name) for name, c in sources.items()]).alias(f"{field}_from")]


def completed(books: DataFrame, records: DataFrame, identity: DataFrame, places: DataFrame, document: str, order: str) -> DataFrame:
    """Of every book its bridge: each field's first value over the sections' records in order, else by the fallbacks' ranks.

    books: ``document``, uid, filename; records: ``document``, ``order`` and the fields of a bridge. Number: MODEL, TEXT,
    else DOCUMENT, which is ``DOC-`` and the first 12 characters of the uid without hyphens (``unknown`` without uid).
    Name: MODEL, TEXT, FILENAME (without its ending). Road: MODEL, TEXT. Latitude and longitude, each for itself:
    MODEL, PAGE. A book without any record gets a bridge as well. An empty text is a value, a null is none.
    """
    model = records.groupBy(document).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in FIELDS], F.count("*").alias("n_merged"))
    told = identity.select(document, *[F.col(c).alias(f"_told_{c}") for c in ("structure_number", "name", "road")])
    place = places.select(document, F.col("latitude").alias("_page_latitude"), F.col("longitude").alias("_page_longitude"), "place_page")
    df = books.select(document, "uid", "filename").join(model, document, "left").join(told, document, "left").join(place, document, "left")
    c = F.col
    made = F.concat(F.lit("DOC-"), F.coalesce(F.substring(F.replace(c("uid"), F.lit("-"), F.lit("")), 1, 12), F.lit("unknown")))
    stem = F.nullif(F.regexp_replace(F.regexp_replace(c("filename"), r"(?i)\.pdf$", ""), r"(?U)^\s+|\s+$", ""), F.lit(""))
    fields = {
        "structure_number": {"MODEL": c("_structure_number"), "TEXT": c("_told_structure_number"), "DOCUMENT": made},
        "name": {"MODEL": c("_name"), "TEXT": c("_told_name"), "FILENAME": stem},
        "road": {"MODEL": c("_road"), "TEXT": c("_told_road")},
        "latitude": {"MODEL": c("_latitude"), "PAGE": c("_page_latitude")},
        "longitude": {"MODEL": c("_longitude"), "PAGE": c("_page_longitude")},
    }
    return df.select(document, *[x for f, sources in fields.items() for x in _ranked(f, sources)], "place_page", F.coalesce("n_merged", F.lit(0)).alias("n_merged"))
