"""Identity from text, one bridge per document, and categories told from text: cases written out."""

import pytest
from pyspark.sql import functions as F

from girderlake.functions import pages
from girderlake.operators import bridges

BOOK = "document_id long, number long, text string"


def told(spark, *texts):
    rows = [(1, n, t) for n, t in enumerate(texts, 1)]
    row = bridges.told_identity(spark.createDataFrame(rows, BOOK), "document_id", "number", "text").first()
    return (row.structure_number, row.name, row.road)


def test_identity_from_text(spark):
    assert told(spark, "Bauwerksnummer: 5412345\nBauwerksname\nTalbrücke Süd\nA  45") == ("5412345", "Talbrücke Süd", "A 45")
    # Lines that are no name are passed over, a value may stand on a later page.
    assert told(spark, "Bauwerksname", "Seite 3\n12 a\nabc", None, "Hangbrücke") == (None, None, None)
    assert told(spark, "Bauwerksname", "Seite 3\r\n 12 a\r\nabc\r\nHangbrücke ") == (None, "Hangbrücke", None)
    assert told(spark, "Bauwerks-Nr.", "", "1234567") == ("1234567", None, None)
    # Only the first label of a name counts, even without a name below.
    assert told(spark, "Bauwerksname\n1\n2\n3\n4\nSteg", "Bauwerksname\nSteg") == (None, None, None)
    # A label comes before a table's head on an earlier page, and that before the lines below.
    assert told(spark, "Nummer\nTeil\n7000001 x", "Nummer Straße IBWNR 6000001", "Bauwerksnr 5000001") == ("5000001", None, None)
    assert told(spark, "Nummer\nTeil\n7000001 x", "Nummer Strasse\nIBWNR 6000001") == ("6000001", None, None)
    assert told(spark, "x\nNummer\nTeil\n7000001 x", "") == ("7000001", None, None)
    assert told(spark, "Ｂ ５５", "A 1") == (None, None, "B 55")
    assert told(spark, None, "") == (None, None, None)


def test_completed(spark):
    utm = "UTM-Koordinaten Rechtswert: 382394,03 Hochwert: 5646659,71"
    book = spark.createDataFrame([(1, 1, "Bauwerksnummer 5000001"), (1, 2, utm), (1, 3, utm.replace("382394", "482394")), (2, 1, None)], BOOK)
    fields = "document_id long, place long, structure_number string, name string, road string, latitude double, longitude double"
    records = spark.createDataFrame([(1, 2, "9", "spät", None, None, 7.5), (1, 1, None, "früh", None, None, None), (2, 1, "", None, None, 0.0, None)], fields)
    books = spark.createDataFrame([(1, "a", "x.pdf"), (2, "b", " Steg .PDF"), (3, "0f-aa-bbbbbbbbbbbbb", ".pdf"), (None, None, None)], "document_id long, uid string, filename string")
    identity, places = bridges.told_identity(book, "document_id", "number", "text"), bridges.told_place(book, "document_id", "number", "text")
    got = {r.document_id: r for r in bridges.completed(books, records, identity, places, "document_id", "place").collect()}
    assert (got[1].structure_number, got[1].structure_number_from, got[1].name, got[1].name_from, got[1].n_merged) == ("9", "MODEL", "früh", "MODEL", 2)
    assert 50.9 < got[1].latitude < 51.1 and got[1].longitude == 7.5 and (got[1].latitude_from, got[1].longitude_from, got[1].place_page) == ("PAGE", "MODEL", 2)
    assert (got[2].structure_number, got[2].name, got[2].name_from, got[2].latitude, got[2].latitude_from, got[2].longitude_from) == ("", "Steg", "FILENAME", 0.0, "MODEL", None)
    assert (got[3].structure_number, got[3].structure_number_from, got[3].name, got[3].name_from, got[3].n_merged) == ("DOC-0faabbbbbbbb", "DOCUMENT", None, None, 0)
    assert got[None].structure_number == "DOC-unknown"
    assert not bridges.completed(books.limit(0), records, identity, places, "document_id", "place").collect()


OTHER = pages.GIVES_WAY
ALL = "[1] S = 2 Dringlichkeit hoch Hauptprüfung 1.2.2003"


@pytest.mark.parametrize(
    ("given", "text", "want"),
    [
        (["A"], "", ["A"]),
        (None, ALL, ["FINDINGS_DAMAGE", "RECOMMENDATIONS", "INSPECTIONS"]),
        (["INSPECTIONS", OTHER], ALL, ["INSPECTIONS", OTHER, "FINDINGS_DAMAGE", "RECOMMENDATIONS"]),
        (["A", OTHER, "B"], ALL, ["A", "B", "FINDINGS_DAMAGE", "RECOMMENDATIONS"]),
        (["A", "B", "C", "D"], ALL, ["A", "B", "C", "D"]),
        (["A", "B", OTHER, "C", "D"], ALL, ["A", "B", "C", "D"]),
        ([OTHER, "A", OTHER, "B"], ALL, ["A", "B", "FINDINGS_DAMAGE", "RECOMMENDATIONS"]),
        ([OTHER, "A", "B", "C"], None, [OTHER, "A", "B", "C"]),
    ],
)
def test_told_categories(spark, given, text, want):
    rows = [(None if given is None else [(g, 0.5) for g in given], text)]
    df = spark.createDataFrame(rows, "given array<struct<category:string,confidence:double>>, text string")
    got = df.select(pages.with_told_categories(F.col("given"), F.col("text")).alias("x")).first().x
    assert [c.category for c in got] == want
    assert all(c.confidence == (0.5 if given and c.category in given else 0.95) for c in got)
