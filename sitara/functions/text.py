"""Unicode folding, scripts, and code-point spans as column expressions."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points dropped by every profile (zero-width and bidirectional controls).
INVISIBLE = (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x061C, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
# The tatweel, and the ranges of Arabic diacritics.
TATWEEL = 0x0640
DIACRITICS = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E8), (0x06EA, 0x06ED))
# Letters folded for gazetteer matching, from and to.
LETTERS_FROM, LETTERS_TO = "آأإٱةىیک", "ااااهييك"
# Arabic blocks.
ARABIC_BLOCKS = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
#: Share of Arabic letters from which a text counts as Arabic.
ARABIC_SHARE = 0.2

DIGITS_FROM = "".join(chr(base + d) for base in (0x0660, 0x06F0) for d in range(10))
DIGITS_TO = "0123456789" * 2
ARABIC_DIGITS = DIGITS_FROM[:10]


@dataclass(frozen=True)
class Profile:
    """Which folds a normalization applies beyond invisible characters, compatibility forms and digits."""

    name: str
    strip_marks: bool = False
    fold_letters: bool = False


DIGITS = Profile("digits")
NAMES = Profile("names", strip_marks=True)
GAZETTEER = Profile("gazetteer", strip_marks=True, fold_letters=True)


def _class(points: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in points)


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


_INVISIBLE_CLASS = _class([(p, p) for p in INVISIBLE])
_MARKS_CLASS = _class([(TATWEEL, TATWEEL), *DIACRITICS])
ARABIC_CLASS = _class(list(ARABIC_BLOCKS))
_NOT_ASCII = r"(?=[^\x00-\x7F])"
#: Blocks whose characters mostly fold to themselves.
_COMMON = ((0x00, 0x24F), (0x370, 0x4FF), (0x5D0, 0x5EA), (0x600, 0x6FF), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _steady(strip_marks: bool) -> str:
    """Class of the characters of common blocks that no fold drops or expands, by Python's Unicode tables."""
    gone = _dropped(Profile("", strip_marks))
    return _class(_ranges([p for a, b in _COMMON for p in range(a, b + 1) if p not in gone and unicodedata.normalize("NFKC", chr(p)) == chr(p)]))


def fold_text(text: str, profile: Profile = DIGITS) -> tuple[str, list[int]]:
    """One text folded, and for each character of the result the place of its source."""
    dropped = _dropped(profile)
    table = dict(zip(map(ord, DIGITS_FROM), DIGITS_TO, strict=True))
    if profile.fold_letters:
        table |= dict(zip(map(ord, LETTERS_FROM), LETTERS_TO, strict=True))
    pairs = [(y, i) for i, x in enumerate(text) if ord(x) not in dropped for y in unicodedata.normalize("NFKC", x) if ord(y) not in dropped]
    return "".join(y for y, _ in pairs).translate(table), [i for _, i in pairs]


def _dropped(profile: Profile) -> set[int]:
    return set(INVISIBLE) | ({TATWEEL, *(p for a, b in DIACRITICS for p in range(a, b + 1))} if profile.strip_marks else set())


@lru_cache(maxsize=8)
def _changes(profile: Profile) -> dict[str, str]:
    """What each character that a fold drops, changes or expands becomes, before digits and letters are folded; by Python's Unicode tables."""
    gone = _dropped(profile)
    out = {}
    for x in (chr(p) for p in range(0x80, 0x110000) if not 0xD800 <= p <= 0xDFFF):
        to = "" if ord(x) in gone else "".join(y for y in unicodedata.normalize("NFKC", x) if ord(y) not in gone)
        if to != x:
            out[x] = to
    return out


#: Marks where a text is cut: a character that every fold drops, so a folded text has none.
CUT = chr(INVISIBLE[0])
#: Parts the list of what characters become; no fold gives it.
_PART = "\x01"


def normalize(text: Column, profile: Profile = DIGITS) -> Column:
    """struct(text, offset_map); a null map stands for "every character keeps its place".

    Texts without a character that is dropped or expanded go through
    ``translate`` alone. The others are cut at these characters; the pieces and
    what the characters become, by their place in a list, are joined again, and
    places are running sums of the pieces' lengths. All patterns are literals
    that are compiled once; ``split`` compiles its own for each row, so it gets
    one character. Put the result in a column of its own before using it twice.
    """
    changes = _changes(profile)
    class_ = f"[{_class(_ranges([ord(x) for x in changes]))}]"
    # All of ASCII is steady, then most of common blocks; a look at these first spares most characters the long class.
    changed = f"{_NOT_ASCII}(?=[^{_steady(profile.strip_marks)}]){class_}"
    needs = text.rlike(changed)
    source, target = DIGITS_FROM, DIGITS_TO
    if profile.fold_letters:
        source, target = source + LETTERS_FROM, target + LETTERS_TO
    gone = "".join(x for x, to in changes.items() if not to)
    keys, becomes = F.lit("".join(changes)), F.split(F.lit(_PART.join(changes.values())), _PART, -1)
    none = F.array().cast("array<int>")

    def joined(pieces: Column, made: Column) -> Column:
        return F.array_join(F.zip_with(pieces, made, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")

    def places(pieces: Column, made: Column) -> Column:
        ends = running(F.transform(pieces, lambda g: F.char_length(g) + 1))
        own = lambda g, end: F.when(g != "", F.sequence(end - F.char_length(g) - 1, end - 2)).otherwise(none)
        begun = F.zip_with(pieces, ends, lambda g, end: F.struct(own(g, end).alias("own"), (end - 1).alias("at")))
        return F.flatten(F.zip_with(begun, made, lambda x, e: F.concat(x["own"], F.when(e != "", F.array_repeat(x["at"], F.char_length(e))).otherwise(none))))

    def slow(x: Column) -> Column:
        return F.struct(F.translate(joined(x["pieces"], x["made"]), source, target).alias("text"), places(x["pieces"], x["made"]).alias("offset_map"))

    becoming = lambda h: F.when(F.contains(F.lit(gone), h), "").otherwise(F.element_at(becomes, F.position(h, keys)))
    made = F.transform(F.regexp_extract_all(text, F.lit(changed), F.lit(0)), becoming)
    cut = F.struct(F.split(F.regexp_replace(text, changed, CUT), CUT, -1).alias("pieces"), made.alias("made"))
    fast = F.struct(F.translate(text, source, target).alias("text"), F.lit(None).cast("array<int>").alias("offset_map"))
    return F.when(needs, let(cut, slow)).when(text.isNotNull(), fast)


def fold(text: Column) -> Column:
    """Gazetteer fold and lower case of text that went through DIGITS already."""
    bare = F.regexp_replace(text, f"[{_INVISIBLE_CLASS}{_MARKS_CLASS}]", "")
    return F.lower(F.translate(bare, DIGITS_FROM + LETTERS_FROM, DIGITS_TO + LETTERS_TO))


def to_original(offset_map: Column, start: Column, end: Column, length: Column) -> Column:
    """struct(start, end) in the source text of a span [start, end) of the folded text."""
    first = F.coalesce(F.get(offset_map, start), start)
    last = F.least(F.coalesce(F.get(offset_map, end - 1), end - 1) + 1, length)
    return F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"))


def _not(letters: str) -> str:
    return f"[^{letters}]"


def has_arabic(text: Column) -> Column:
    """Whether a text holds any Arabic letter, mark or digit."""
    return F.coalesce(text.rlike(f"{_NOT_ASCII}[{ARABIC_CLASS}]"), F.lit(False))


def dominant_script(text: Column) -> Column:
    """'arabic' if at least a fifth of the letters are, else 'latin'; texts without letters are latin."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    arabic = F.char_length(F.regexp_replace(text, rf"[^{ARABIC_CLASS}]|[^\p{{L}}]", ""))
    return F.when(has_arabic(text) & (letters > 0) & (arabic >= letters * ARABIC_SHARE), "arabic").otherwise("latin")


def script_runs(text: Column) -> Column:
    """Texts of the runs of one script, from the first letter on: array of strings.

    Characters that are no letters belong to the run before them. A run goes
    on until the other script's next letter; one class and a star, so long
    texts need no deep matching.
    """
    arabic, latin = rf"[{ARABIC_CLASS}&&\p{{L}}]", rf"[\p{{L}}&&[^{ARABIC_CLASS}]]"
    return F.regexp_extract_all(text, F.lit(f"{arabic}{_not(latin)}*|{latin}{_not(arabic)}*"), F.lit(0))


def is_arabic_run(run: Column) -> Column:
    return run.rlike(f"^[{ARABIC_CLASS}]")


def script_segments(text: Column) -> Column:
    """Runs of one script: array of (script, start, end).

    Characters that are no letters belong to the run before them, those at
    the beginning to the first run; a text without letters has no runs.
    """

    def placed(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda r: F.char_length(r)))
        lead = F.char_length(text) - F.aggregate(xs, F.lit(0), lambda s, r: s + F.char_length(r))
        return let(F.struct(ends.alias("ends"), lead.alias("lead")), lambda e: F.transform(xs, lambda r, i: one(e["ends"], e["lead"], r, i)))

    def one(ends: Column, lead: Column, run: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(lead + F.get(ends, i - 1))
        return F.struct(F.when(is_arabic_run(run), "arabic").otherwise("latin").alias("script"), begin.alias("start"), (lead + F.get(ends, i)).alias("end"))

    return let(script_runs(text), placed)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def spans_of(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern: array of (start, end, value), places in code points.

    Gaps and matches laid end to end are the text, so places are running
    sums of lengths; look-around costs nothing extra.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), laid_out(gaps, found)).otherwise(empty)


#: Numbers that are summed one after another; runs of so many are joined at the end.
_RUN = 128


def running(numbers: Column) -> Column:
    """Running sums of an array of whole numbers, each with its own.

    Runs of numbers are summed apart, then moved by what lies before them, so
    what is copied grows far less than the square of the array's size.
    """
    sums = "array<int>"

    def run(xs: Column, at: Column) -> Column:
        grown = F.struct(at.alias("at"), F.array().cast(sums).alias("out"))
        return F.aggregate(xs, grown, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"])

    def many(xs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(xs), F.lit(_RUN))
        runs = F.transform(firsts, lambda i: F.slice(xs, i, F.lit(_RUN)))
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, n: s + n))
        return let(run(totals, F.lit(0)), lambda ends: F.flatten(F.transform(runs, lambda r, i: run(r, F.coalesce(F.get(ends, i - 1), F.lit(0))))))

    return let(numbers, lambda xs: F.when(F.size(xs) > _RUN, many(xs)).otherwise(run(xs, F.lit(0))))


def laid_out(gaps: Column, found: Column) -> Column:
    """Places of matches from the texts before each: array of (start, end, value)."""
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("g"), m.alias("m"), F.char_length(m).alias("n")))

    def placed(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: x["g"] + x["n"]))
        return F.zip_with(xs, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["m"].alias("value")))

    return let(pairs, placed)


def snippet(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """struct(context, context_offset): the span with up to ``width`` characters on either side."""
    if not 0 <= width <= 200:
        raise ValueError("width must be within 0 and 200")
    lo = F.greatest(start - width, F.lit(0))
    return F.struct(F.substring(text, lo + 1, F.least(end + width, F.char_length(text)) - lo).alias("context"), (start - lo).alias("context_offset"))


def splice(text: Column, spans: Column) -> Column:
    """Replace spans (start, end, replacement) of a text; overlaps and bad places raise an error.

    The text is cut into pieces of _RUN spans first, then each piece at its
    spans, as every cut runs over what lies before it.
    """
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))

    def filled(run: Column, to: Column) -> Column:
        begun = run[0]["start"]
        piece = F.substring(text, begun + 1, to - begun)

        def one(base: Column) -> Column:
            until = lambda i: F.coalesce(F.get(run, i + 1)["start"], to)
            return F.array_join(F.transform(run, lambda s, i: F.concat(s["replacement"], F.substring(base, s["end"] - begun + 1, until(i) - s["end"]))), "")

        return let(piece, one)

    def cut(ordered: Column, length: Column) -> Column:
        bad = F.exists(F.transform(ordered, lambda s, i: (s["start"] < F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0))) | (s["end"] <= s["start"]) | (s["end"] > length)), lambda b: b)
        firsts = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)), F.lit(_RUN))
        runs = F.transform(firsts, lambda i: F.struct(F.slice(ordered, i, F.lit(_RUN)).alias("run"), F.coalesce(F.get(ordered, i + _RUN - 1)["start"], length).alias("to")))
        whole = F.concat(F.substring(text, F.lit(1), ordered[0]["start"]), F.array_join(F.transform(runs, lambda r: filled(r["run"], r["to"])), ""))
        return F.when(F.size(ordered) == 0, text).when(bad, F.raise_error(F.lit("spans overlap or leave the text")).cast("string")).otherwise(whole)

    # The length is counted once, not once for each span.
    return let(F.struct(F.array_sort(bare).alias("spans"), F.char_length(text).alias("length")), lambda x: cut(x["spans"], x["length"]))


def pieces(text: Column, spans: Column) -> Column:
    """A text cut into plain and span pieces: array of (kind, text)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    empty = F.array().cast("array<struct<kind:string,text:string>>")
    piece = lambda kind, lo, hi: F.array(F.struct(F.lit(kind).alias("kind"), F.substring(text, lo + 1, hi - lo).alias("text")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], piece("plain", acc["at"], s["start"])).otherwise(empty)
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, piece("span", s["start"], s["end"])).alias("out"))

    tail = lambda acc: F.when(acc["at"] < F.char_length(text), F.concat(acc["out"], piece("plain", acc["at"], F.char_length(text)))).otherwise(acc["out"])
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, tail)


def strip_spans(text: Column, spans: Column) -> Column:
    """A text without its spans, blanks collapsed."""
    bare = splice(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("replacement"))))
    return F.trim(F.regexp_replace(bare, r"(?U)\s{2,}", " "))


def to_arabic_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", ARABIC_DIGITS)
