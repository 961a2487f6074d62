"""Text to values: German and English number, date, unit, urgency and status words as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of units, by their lower-case form without spaces.
UNIT_ALIASES = {
    "laufendemeter": "m", "laufendermeter": "m", "lfdm": "m", "lfdm-d-": "m", "lfdm-a-": "m", "lfm": "m", "m": "m", "meter": "m",
    "cm": "cm", "mm": "mm", "m2": "m2", "m²": "m2", "qm": "m2", "dm2": "dm2", "stk": "Stk", "stueck": "Stk", "stück": "Stk",
}
#: What in a text shows its unit, the first that matches.
UNIT_SIGNS = [
    (r"m\s*[²2]|qm|instandsetzungsfl[äa]che", "m2"),
    (r"m\s*[³3]", "m3"),
    (r"lfd\s*m|laufende[mn]?\s*meter|\blfdm\b|\blfm\b", "m"),
    (r"st[üu]ck|\bstk\b|\bstck\b|\bst\.\b", "Stk"),
    (r"psch|pauschal", "pauschal"),
    (r"\bcm\b", "cm"),
    (r"\bmm\b", "mm"),
    (r"\bm\b", "m"),
]
#: Words that show a state, the first that matches.
INSPECTION_TYPES = [("haupt", "MAIN"), ("einfach", "SIMPLE"), ("sonder", "SPECIAL")]
FINDING_STATES = [("offen|open", "OPEN"), ("monitor|beobacht|überwach|ueberwach", "MONITORING"), ("behoben|erledigt|resolved|geschlossen", "RESOLVED"), ("verworfen|dismissed|gegenstandslos", "DISMISSED")]
RECOMMENDATION_STATES = [("offen|open", "OPEN"), ("genehmigt|approved", "APPROVED"), ("geplant|scheduled", "SCHEDULED"), (r"in\s*arbeit|in_progress|laufend", "IN_PROGRESS"), ("abgeschlossen|completed|erledigt", "COMPLETED"), ("storniert|cancelled|abgebrochen", "CANCELLED")]
#: Fixed value: units that may stand behind a number.
_TRAILING_UNIT = r"(?iu)(?:m²|m2|qm|stk|stueck|stück|euro|eur|€|m|%)$"


def first_of(*cases: tuple[Column, Column | str | int]) -> Column:
    """The value of the first condition that holds, else null."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def collapsed(text: Column) -> Column:
    """runs of white space as one space, trimmed, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


#: Combining marks that are taken off letters: U+0300 to U+036F.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _bare_letters() -> tuple[str, str]:
    """Letters with such marks, and what is left of each without them, by Unicode's canonical decompositions."""
    bare = {c: "".join(x for x in unicodedata.normalize("NFD", c) if x not in MARKS) for c in map(chr, range(0x80, 0x10000))}
    pairs = [(c, b) for c, b in bare.items() if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _bare_letters()


def without_marks(text: Column) -> Column:
    """Letters without their marks, whether these stand in the letter or behind it."""
    return F.translate(text, _MARKED + MARKS, _BARE)


def folded(text: Column) -> Column:
    """lower case without marks."""
    return F.lower(without_marks(text))


#: White space, as Unicode has it.
_BLANKS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def compatible(text: Column) -> Column:
    """Unicode's form NFKC, by the library that Spark brings with it; plain text stays as it is."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.rlike(text, F.lit(r"^[\x00-\x7F]*$")), text).when(text.isNotNull(), made)


def canonical(text: Column) -> Column:
    """form NFKC, runs of white space as one space, trimmed, lower case. Not for use within an aggregate or a join's condition."""
    return F.lower(F.trim(F.regexp_replace(compatible(text), _BLANKS, " ")))


def any_of(words: list[str]) -> Column:
    """A pattern that finds any of the words as they are."""
    return F.lit("|".join(re.escape(w) for w in words))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the folded text has any of the words; a null text has none."""
    return F.rlike(folded(F.coalesce(text, F.lit(""))), any_of(words))


def decimal_text(text: Column, negative: bool = False) -> Column:
    """F8: a decimal as plain text, or null: of comma and point the last is the decimal mark, groups of three are thousands."""
    x = F.regexp_replace(F.regexp_replace(text, r"[\s']", ""), _TRAILING_UNIT, "")
    comma, point = F.locate(",", F.reverse(x)), F.locate(".", F.reverse(x))
    no_points, no_commas = F.replace(x, F.lit("."), F.lit("")), F.replace(x, F.lit(","), F.lit(""))
    one_mark = lambda c: F.regexp_replace(c, r"^([^,]*),", "$1.")  # noqa: E731  the first comma only
    plain = first_of((comma.isNull() | point.isNull(), None), ((comma > 0) & (point > 0) & (comma < point), one_mark(no_points)), ((comma > 0) & (point > 0), no_commas), (F.rlike(x, F.lit(r"^\d{1,3}(?:\.\d{3})+$")), no_points), (comma > 0, one_mark(x))).otherwise(x)
    return F.when(F.rlike(plain, F.lit(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?$" if negative else r"^(?:0|[1-9]\d*)(?:\.\d+)?$")), plain)


def integer(text: Column) -> Column:
    """a whole number, with either mark between thousands, or null."""
    x = F.regexp_replace(F.regexp_replace(text, r"[\s']", ""), _TRAILING_UNIT, "")
    x = F.when(F.rlike(x, F.lit(r"^\d{1,3}(?:[.,]\d{3})+$")), F.regexp_replace(x, "[.,]", "")).otherwise(x)
    return F.when(F.rlike(x, F.lit(r"^-?(?:0|[1-9]\d*)$")), x).try_cast("long")


def date(text: Column) -> Column:
    """day.month.year or an ISO date that the calendar has, else null."""
    x = collapsed(text)
    german = F.when(F.rlike(x, F.lit(r"^\d{1,2}\.\d{1,2}\.\d{4}$")), F.try_to_date(x, "d.M.yyyy"))
    return F.coalesce(german, F.when(F.rlike(x, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(x, "yyyy-MM-dd")))


def currency(text: Column) -> Column:
    """EUR for its names, any other three letters as they are, else null."""
    x = F.upper(F.regexp_replace(collapsed(text), r"[.\s]", ""))
    return first_of((x.isin("€", "EUR", "EURO", "EUROS"), "EUR"), (F.rlike(x, F.lit("^[A-Z]{3}$")), x))


def unit(text: Column) -> Column:
    """the short form of a known unit, any other text trimmed."""
    x = collapsed(text)
    known = F.create_map(*[F.lit(v) for pair in UNIT_ALIASES.items() for v in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(x), r"\s+", "")), x)


def unit_in(text: Column) -> Column:
    """the unit that a text speaks of."""
    x = F.lower(collapsed(text))
    return first_of(*[(F.rlike(x, F.lit(f"(?u){sign}")), name) for sign, name in UNIT_SIGNS])


def urgency(text: Column) -> Column:
    """the urgency class whose word stands in the text, any other text trimmed."""
    x = collapsed(text)
    compact = F.regexp_replace(F.lower(x), r"[\s_\-./]+", "")
    classes = [("sofort", "SOFORT"), ("kurzfrist", "KURZFRISTIG"), ("mittelfrist", "MITTELFRISTIG"), ("langfrist", "LANGFRISTIG")]
    return F.coalesce(first_of(*[(F.contains(compact, F.lit(w)), name) for w, name in classes]), x)


def rating(text: Column) -> Column:
    """a whole rating of 0 to 4; a blank one is 0 (trap T15), anything else null."""
    x = F.replace(F.trim(text), F.lit(","), F.lit("."))
    value = F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double"))
    return F.when((value == F.floor(value)) & value.between(0, 4), value.cast("long"))


def state(text: Column, signs: list[tuple[str, str]], *more: str) -> Column:
    """F16: a state's own name, or the state that the first matching words show."""
    low = F.lower(text)
    return first_of((text.isin(*[name for _, name in signs], *more), text), *[(F.rlike(low, F.lit(f"(?u){words}")), name) for words, name in signs])
