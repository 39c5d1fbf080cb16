"""Column functions on text, dates, times and amounts: built-in expressions only."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = r"^(\d{1,2})\s*[:hH.]\s*(\d{2})$"
ISO_DATE, BR_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$"
ISO_MONTH, BR_MONTH = r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})/(\d{4})$"
#: Weekdays as printed, digits that optical recognition confuses, spellings it makes of weekdays.
WEEKDAYS = ("SEG", "TER", "QUA", "QUI", "SEX", "SAB", "DOM")
CONFUSED, DIGITS = "OCDQB€$", "0000885"
MISREAD = {"SES": "SEG", "SE3": "SEG", "SEK": "SEX", "QUT": "QUI", "QÜI": "QUI"}


#: Hangul syllables decompose by a rule: 19 first, 21 middle and 27 last letters.
SYLLABLES, HANGUL = range(0xAC00, 0xD7A4), ((0x1100, 19), (0x1161, 21), (0x11A8, 27))


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without combining marks is one character, and those characters (at the end those that leave nothing); and a map of those that leave several."""
    single, gone, several = [], [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if code in SYLLABLES or not (unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            gone.append(c)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != c:
            single.append((c, plain))
    return "".join(a for a, _ in single) + "".join(gone), "".join(b for _, b in single), several


def _character_class(characters) -> str:
    """A pattern's class of characters, as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _replaced(text: Column, some: str, by) -> Column:
    """``text`` with ``by(c)`` for each character c of the class ``some``, null for others; cut before these characters, so that the rest stays in long pieces."""
    first = lambda piece: F.substring(piece, 1, 1)
    pieces = F.transform(F.split(text, f"(?={some})"), lambda p: F.concat(F.coalesce(by(first(p)), first(p)), F.substr(p, F.lit(2))))
    return F.when(text.rlike(some), F.array_join(pieces, "")).otherwise(text)


def _letters(syllable: Column) -> Column:
    place = F.ascii(syllable) - SYLLABLES[0]
    of = lambda k: F.array(*(F.lit(chr(HANGUL[k][0] + n)) for n in range(HANGUL[k][1])))
    last = F.pmod(place, F.lit(28))
    return F.concat(F.get(of(0), F.floor(place / 588).cast("int")), F.get(of(1), F.floor(F.pmod(place, F.lit(588)) / 28).cast("int")), F.when(last == 0, "").otherwise(F.get(of(2), last - 1)))


def folded(text: Column) -> Column:
    """Lower case, compatibility decomposition, no combining marks: ligatures, full-width letters, fractions and ordinals become plain letters and digits.

    Most texts have ASCII letters only, which stay, or Latin ones, which a cheap class sends straight to the one-to-one table."""
    from_, to, several = _decompositions()
    lower, latin = F.lower(text), [c for c in several if c < "\u0250"]
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    hangul = _character_class(map(chr, SYLLABLES))
    longer = _replaced(lower, _character_class(several), lambda c: F.try_element_at(table, c))
    longer = _replaced(longer, hangul, lambda c: F.when(c.rlike(hangul), _letters(c)))
    other = "[" + _character_class(latin)[1:-1] + r"\x{250}-\x{10FFFF}]"
    plain = F.octet_length(lower) == F.length(lower)
    return F.when(plain, lower).otherwise(F.translate(F.when(lower.rlike(other), longer).otherwise(lower), from_, to))


def fold(word: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(x))


def label_key(label: Column) -> Column:
    return F.regexp_replace(folded(F.trim(label)), r"\s+", " ")


def slug(label: Column) -> Column:
    words = F.trim(F.translate(F.regexp_replace(folded(label), "[^a-z0-9]+", "_"), "_", " "))
    return F.coalesce(F.nullif(F.substring(F.translate(words, " ", "_"), 1, 40), F.lit("")), F.lit("verba"))


def _clock(text: Column, pattern: str) -> Column:
    hour, minute = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2))
    return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))


def normalized_time(raw: Column) -> Column:
    """``HH:mm`` or null."""
    return _clock(F.trim(raw), TIME)


def normalized_date(raw: Column) -> Column:
    """``yyyy-MM-dd`` of a valid date, or null."""
    text = F.trim(raw)
    date = F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-M-d")).when(text.rlike(BR_DATE), F.try_to_date(text, "d/M/yyyy"))
    return F.date_format(date, "yyyy-MM-dd")


def normalized_month(raw: Column) -> Column:
    """``yyyy-MM`` or null."""
    text = F.trim(raw)
    year = F.when(text.rlike(ISO_MONTH), F.regexp_extract(text, ISO_MONTH, 1)).when(text.rlike(BR_MONTH), F.regexp_extract(text, BR_MONTH, 2)).cast("int")
    month = F.when(text.rlike(ISO_MONTH), F.regexp_extract(text, ISO_MONTH, 2)).when(text.rlike(BR_MONTH), F.regexp_extract(text, BR_MONTH, 1)).cast("int")
    return F.when(month.between(1, 12), F.format_string("%04d-%02d", year, month))


def month_br(month: Column) -> Column:
    return F.concat(F.substring(month, 6, 2), F.lit("/"), F.substring(month, 1, 4))


def minutes(clock: Column) -> Column:
    return F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")


def clock(of: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(of / 60).cast("int"), (of % 60).cast("int"))


def cents(amount: Column) -> Column:
    return amount.cast("decimal(18,2)")


def amount_br(amount: Column) -> Column:
    """Two decimals, comma, no thousands separator."""
    return F.replace(cents(amount).cast("string"), F.lit("."), F.lit(","))


def grouped_br(amount: Column) -> Column:
    return F.translate(F.format_number(cents(amount), 2), ",.", ".,")


def parsed_br(text: Column) -> Column:
    """The amount of a text like 1.234,56; null for other shapes."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^-?(\d{1,3}(\.\d{3})+|\d+)(,\d{1,2})?$"), F.translate(F.replace(plain, F.lit("."), F.lit("")), ",", ".").try_cast("decimal(18,2)"))


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def read_time(token: Column) -> Column:
    """A time as optical recognition reads it: separator lost or read as a digit."""
    plain = F.translate(F.upper(F.regexp_replace(token, r"""^[.,;|'"*()]+|[.,;|'"*()]+$""", "")), CONFUSED, DIGITS)
    shapes = (r"^(\d{1,2})[:;.](\d{2})$", r"^(\d{2})(\d{2})$", r"^(\d{2})[\d+](\d{2})$")

    def read(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for shape in reversed(shapes):
            found = F.when(text.rlike(shape), _clock(text, shape)).otherwise(found)
        return found

    return bound(plain, read)


def read_weekday(token: Column) -> Column:
    """A printed weekday; one wrong letter, or a lost first letter, is forgiven if one weekday alone fits."""
    days = F.array(*map(F.lit, WEEKDAYS))
    right = F.create_map(*(F.lit(x) for pair in MISREAD.items() for x in pair))

    def read(letters: Column) -> Column:
        same = lambda d, k: (F.substring(d, k, 1) == F.substring(letters, k, 1)).cast("int")
        close = F.filter(days, lambda d: F.when(F.length(letters) == 2, F.substring(d, 2, 2) == letters).otherwise(same(d, 1) + same(d, 2) + same(d, 3) == 2))
        alone = bound(close, lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))))
        return F.when(letters.isin(*WEEKDAYS), letters).when(F.length(letters).isin(2, 3), alone)

    letters = F.substring(F.regexp_replace(F.upper(token), "[^A-ZÜ]", ""), 1, 3)
    return bound(bound(letters, lambda x: F.coalesce(F.element_at(right, x), x)), read)


def chronological(times: list[Column]) -> Column:
    """Whether the times given go forward, over midnight once at most, in less than a day."""
    given = F.filter(F.array(*(minutes(t) for t in times)), lambda m: m.isNotNull())
    state = F.aggregate(
        given,
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("wraps"), F.lit(0).alias("at")),
        lambda s, m: F.struct(m.alias("last"), (s["wraps"] + (m < s["last"]).cast("int")).alias("wraps"), (m + 1440 * (s["wraps"] + (m < s["last"]).cast("int"))).alias("at")),
    )
    return F.when(F.size(given) < 2, F.lit(True)).otherwise((state["wraps"] <= 1) & (state["at"] - F.get(given, F.lit(0)) < 1440))
