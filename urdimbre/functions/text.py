"""Text functions as columns: normal forms, words, terms, sentences, questions, quotes, tolerant JSON."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of Latin-1 and Latin Extended-A whose decomposition is an ASCII letter and marks, and those letters.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c))[0].isascii() and len(unicodedata.normalize("NFD", chr(c))) > 1)
BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)

#: Function words of Spanish and English, words of both left out.
SPANISH = tuple(
    "el la los las un una unos unas de del al y o pero porque cuando donde que quien cual cuyo como si sin sobre entre hasta desde para "
    "por segun tras durante mediante ante bajo contra hacia ademas tambien aunque mientras entonces asi pues esta estas este estos esa "
    "esas ese esos aquel su sus mi mis tu tus nuestro nuestra se le les lo nos os ser estar tiene tienen puede pueden debe deben hay "
    "haber sido mas menos muy poco mucho todo toda todos todas otro otra cada".split()
)
ENGLISH = tuple(
    "the of and or but because when where which who whose whom what that this these those there their them they his her its our your "
    "with without within from into onto upon about above below between among during through after before while although though however "
    "therefore thus such been being have has had was were will would should could can may might must shall not only also both each any "
    "some any most more less than then per via".split()
)
#: How a question without marks begins.
QUESTION_OPENERS = (
    "que|qué|cual|cuál|cuando|cuándo|como|cómo|cuanto|cuánto|cuanta|cuánta|donde|dónde|por que|por qué|puedo|podria|podría|debo|"
    "deberia|debería|tengo que|hay que|es normal|esta bien|está bien|me puedo|se puede"
)
#: Length of a term's stem, and of the shortest word that is a term.
STEM, TERM = 6, 4


def plain(c: Column) -> Column:
    """Lower case without accents (letters of Latin-1 and Latin Extended-A, combining marks dropped); null stays null."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, BARE), r"\p{Mn}", "")


def normalized(c: Column) -> Column:
    """Normal form of a document, by five fixed rules: line ends unified, control characters blanked, words divided by a hyphen at a line end joined,
    runs of blanks and of empty lines shortened; then ends trimmed. Null stays null, blank becomes empty."""
    text = F.regexp_replace(c, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.regexp_replace(text, r"([\p{L}\p{N}_])[-­]\n([\p{L}\p{N}_])", "$1$2")
    text = F.regexp_replace(text, r"[ \t   ]+", " ")
    return F.btrim(F.regexp_replace(text, r"\n{2,}", "\n\n"), F.lit(" \n\t"))


def plain_id(c: Column) -> Column:
    """An identifier whatever its spelling: its runs of letters and of digits parted by ``_``, lower case, without zero padding; null without any."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    return F.nullif(F.array_join(F.transform(runs, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), "_"), F.lit(""))


def canonical_words(c: Column) -> Column:
    """Words of a-z and 0-9, lower case without accents; empty for null."""
    return F.filter(F.split(F.regexp_replace(plain(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bare_text(c: Column) -> Column:
    """A text as it is compared with quotes: its words parted by one blank."""
    return F.btrim(F.regexp_replace(plain(c), "[^0-9a-z]+", " "))


def query_terms(c: Column) -> Column:
    """Distinct stems of the content words of a text, in order: words of four characters or more, no function words."""
    words = F.filter(canonical_words(c), lambda w: (F.length(w) >= TERM) & ~w.isin(*SPANISH, *ENGLISH))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def function_words(c: Column) -> tuple[Column, Column]:
    """How many Spanish and English function words a text has."""
    words = F.regexp_extract_all(plain(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.size(_among(words, SPANISH)), F.size(_among(words, ENGLISH))


def _among(words: Column, own: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: w.isin(*own))


def guessed_language(c: Column) -> Column:
    """es or en by the more function words; a tie, or none, is indeterminado."""
    spanish, english = function_words(c)
    return F.when(spanish > english, "es").when(english > spanish, "en").otherwise("indeterminado")


def sentence_pieces(c: Column) -> Column:
    """Pieces after ``. ! ? ;`` and white space, or parted by empty lines; blank pieces dropped."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?;])\s+|\n{2,}"), lambda s: s.rlike(r"[^\s\x{a0}]"))


def asks(c: Column) -> Column:
    """Whether a text has a question mark or begins like a question; null and blank texts don't."""
    own = F.btrim(F.coalesce(c, F.lit("")))
    return (own != "") & (own.rlike("[¿?]") | own.rlike(rf"(?iU)^\W*({QUESTION_OPENERS})\b"))


def quoted(quote: Column, text: Column) -> Column:
    """Whether a quote occurs in a text by its words; a null or empty quote doesn't."""
    own = bare_text(quote)
    return F.coalesce((own != "") & F.contains(bare_text(text), own), F.lit(False))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer, as text: fences and what stands before the first brace dropped; null if there is none."""
    own = F.regexp_replace(F.regexp_replace(F.btrim(c, F.lit(" \n\t")), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    start = F.instr(own, "{")
    return F.when(start > 0, F.substring(own, start, F.length(own)))


def snippet(c: Column, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis as the last."""
    own = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(own) > most, F.concat(F.rtrim(F.substring(own, 1, most - 1)), F.lit("…"))).otherwise(own)


def value_and_quote(answer: Column, field: str) -> tuple[Column, Column]:
    """Value and quote that a model's answer (JSON, as ``json_object`` gives) holds for a field.

    Only an object with a ``valor`` that isn't null and a ``cita`` that is text carries evidence; of anything else both are null.
    """
    at = lambda key: F.get_json_object(answer, f"$.{field}.{key}")
    quote = F.get_json_object(answer, f"$.{field}")
    is_text = quote.rlike(r'"cita"\s*:\s*"')
    told = at("valor").isNotNull() & at("cita").isNotNull() & is_text
    return F.when(told, at("valor")), F.when(told, at("cita"))


def windows(c: Column, width: int = 1200, least: int = 600, most: int | None = None) -> Column:
    """Consecutive pieces of ``width`` characters; a last one under ``least`` is dropped. ``most``: characters looked at (all)."""
    text = c if most is None else F.substring(c, 1, most)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(width)))
    return F.filter(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(width))), lambda x: F.length(x) >= least)


def to_integer(c: Column) -> Column:
    """Whole number of a text: digits, or a decimal without fraction; anything else is null."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def to_float(c: Column) -> Column:
    """Number of a text, with decimal point or comma; anything else is null."""
    return F.replace(F.btrim(c), F.lit(","), F.lit(".")).try_cast("double")
