"""Column expressions over texts. All of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pack import CHINESE, Pack

_WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "．，"
#: Figures that may be written as words.
CARDINALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: How an answer about the task begins.
LEAKS = ("here is the translation", "here's the translation", "translation:", "the translated text", "sure, here", "i cannot translate", "as an ai", "note:")
#: Characters of a text that count where a comparison is by beginnings.
COMPARED = 2000
#: White space of any script; Java's own class is ASCII only.
SPACE = r"\p{IsWhite_Space}"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
#: How a line of a list begins.
ITEMS = (r"[•·‧\-—*▪◦]", r"\p{Nd}+[.)、]", rf"[（(]{SPACE}*[0-9一二三四五六七八九十]+{SPACE}*[)）]", r"[一二三四五六七八九十百]+[、.]", r"第[0-9一二三四五六七八九十百]+[条章节款项]")


def let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of ``values``, each worked out once a row: an expression that a lambda mentions runs once an element."""
    held = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(held), lambda v: body(*[v[k] for k in values])), 1)


def trimmed(c: Column) -> Column:
    """Without white space at the ends, line ends included."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Whether a text holds nothing but white space; null is blank."""
    return ~F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))


def folded(c: Column) -> Column:
    """Full-width digits, stops and commas as ASCII."""
    return F.when(c.rlike("[，-９]"), F.translate(c, _WIDE, "0123456789.,")).otherwise(c)


def number_runs(c: Column) -> Column:
    """Figures of a text in order: commas dropped, points kept inside, full-width digits as ASCII."""
    return F.transform(F.regexp_extract_all(folded(c), F.lit("[0-9][0-9.,]*"), 0), lambda x: F.rtrim(F.replace(x, F.lit(","), F.lit("")), F.lit(".")))


def occurrences(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda y: y == x))


def multiset_minus(a: Column, b: Column) -> Column:
    """Distinct values that ``a`` holds more often than ``b``, sorted."""
    return let(lambda p, q: F.array_sort(F.filter(F.array_distinct(p), lambda x: occurrences(p, x) > occurrences(q, x))), p=a, q=b)


def spelled(numbers: Column, target: Column) -> Column:
    """The figures 1 to 12 among ``numbers`` whose cardinal or ordinal word stands in ``target``."""
    words = F.create_map(*[x for i in range(12) for x in (F.lit(str(i + 1)), F.array(F.lit(CARDINALS[i]), F.lit(ORDINALS[i])))])
    said = lambda low: F.filter(numbers, lambda n: F.coalesce(F.exists(F.try_element_at(words, n), lambda w: F.contains(low, w)), F.lit(False)))
    return F.when(F.size(numbers) > 0, let(said, low=F.lower(target))).otherwise(F.array().cast("array<string>"))


def months_as_words(source: Column, target: Column) -> Column:
    """Month figures before 月 in the source that the target names, in full or by three letters."""
    months = F.array(*[F.lit(m[:3]) for m in MONTHS])
    digits = F.regexp_extract_all(folded(source), F.lit("([0-9]+)月"), 1)
    named = lambda low, all_: F.filter(all_, lambda d: (F.length(d) <= 3) & d.cast("int").between(1, 12) & F.contains(low, F.try_element_at(months, F.when(F.length(d) <= 3, d.cast("int")).otherwise(1))))
    return let(named, low=F.lower(target), all_=digits)


def written_forms(number: Column, pack: Pack = CHINESE) -> Column:
    """A figure in the pack's numerals: digit by digit, and positionally for 1 to 99; empty if it is no integer."""
    if not pack.numerals:
        return F.array().cast("array<string>")
    each = F.translate(number, "0123456789", pack.numerals)
    v = F.when(number.rlike("^[0-9]{1,2}$"), number.cast("int"))
    digit = F.array(*[F.lit(x) for x in pack.numerals])
    tens, units = F.floor(v / 10).cast("int"), (v % 10).cast("int")
    positional = F.when(v < 10, F.element_at(digit, v + 1)).otherwise(F.concat(F.when(tens > 1, F.element_at(digit, tens + 1)).otherwise(""), F.lit("十"), F.when(units > 0, F.element_at(digit, units + 1)).otherwise("")))
    return F.when(number.rlike("^[0-9]+$"), F.array_compact(F.array(each, F.when(v > 0, positional)))).otherwise(F.array().cast("array<string>"))


def script_share(c: Column, pack: Pack) -> Column:
    """Share of the pack's script among the characters that are neither space nor punctuation; 0 for none."""
    share = lambda counted: F.coalesce(F.try_divide(F.regexp_count(counted, F.lit(f"[{pack.script}]")), F.char_length(counted)), F.lit(0.0))
    # listed characters are told by a table, properties by a search
    return share(F.when(latin(c), F.regexp_replace(c, f"[{_LATIN_MARKS}]", "")).otherwise(F.regexp_replace(c, rf"[{SPACE}\p{{P}}]", "")))


def holds_script(c: Column, pack: Pack) -> Column:
    """Whether :func:`script_share` is over 0; looks no further than the first such character."""
    return c.rlike(rf"[{pack.script}&&[^{SPACE}\p{{P}}]]")


def letters(c: Column) -> Column:
    """How many characters are no white space."""
    return F.char_length(F.regexp_replace(c, SPACE, ""))


def latin(c: Column) -> Column:
    """Whether all characters are Latin letters, signs and blanks: no other white space, no full-width figures."""
    return ~c.rlike("[^ -~\\xa1-\\x{24f}]")


#: The blank and the punctuation among the characters that :func:`latin` takes, escaped for a class of a pattern.
_LATIN_MARKS = "".join(rf"\x{{{n:x}}}" for n in (*range(0x20, 0x7F), *range(0xA1, 0x250)) if n == 0x20 or unicodedata.category(chr(n))[0] == "P")


def letters_of(c: Column) -> Column:
    """:func:`letters` of a held value: without a pattern where blanks are its only white space."""
    return F.when(latin(c), F.char_length(F.replace(c, F.lit(" "), F.lit("")))).otherwise(letters(c))


def _beginning(c: Column, compared: int | None) -> Column:
    return c if compared is None else F.substring(c, 1, compared)


def similarity(a: Column, b: Column, compared: int | None = None) -> Column:
    """1 - edit distance over the longer length, by characters, of whole texts or their first ``compared``; two empty texts 1, one empty 0.

    Where the one stands in the other as it is, the distance is what is left over, and no table is filled.
    """

    def told(x: Column, y: Column, n: Column, m: Column) -> Column:
        distance = F.when(F.contains(x, y) | F.contains(y, x), F.abs(n - m)).otherwise(F.levenshtein(x, y))
        return F.when(F.greatest(n, m) == 0, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(1 - distance / F.greatest(n, m))

    x, y = _beginning(a, compared), _beginning(b, compared)
    return let(told, x=x, y=y, n=F.char_length(x), m=F.char_length(y))


def echoes(a: Column, b: Column, compared: int | None = None) -> Column:
    """Whether two texts, or their first ``compared`` characters, are over 0.9 similar.

    Texts that are have fewer edits than a tenth of the longer one's length; cut into one part more than that, the one
    holds a part that stands in the other as it is. Only then, and if counts leave it open, is the distance worked out, up
    to the most edits allowed.
    """

    def told(x: Column, y: Column, n: Column, m: Column) -> Column:
        most = F.floor(F.greatest(n, m) / 10).cast("int")
        part = F.floor(n / (most + 1)).cast("int")
        # an edit changes the count of these letters by one at most
        bare = lambda c: F.replace(F.replace(F.replace(c, F.lit("e"), F.lit("")), F.lit("a"), F.lit("")), F.lit("i"), F.lit(""))
        apart = F.abs((n - F.char_length(bare(x))) - (m - F.char_length(bare(y))))
        whole = F.exists(F.sequence(F.lit(0), most), lambda i: F.contains(y, F.substring(x, i * part + 1, part)))
        near = lambda d: d * 10 < F.greatest(n, m)
        # nor by more than one of the characters that are no capitals, figures or marks; and place by place no fewer differ
        signs = F.abs(F.regexp_count(x, F.lit("[^ -`]")) - F.regexp_count(y, F.lit("[^ -`]")))
        places = F.size(F.filter(F.arrays_zip(F.split(x, "").alias("x"), F.split(y, "").alias("y")), lambda c: ~c["x"].eqNullSafe(c["y"])))
        distance = F.call_function("levenshtein", x, y, most)  # -1 beyond
        told_soon = F.when(x == y, True).when(F.abs(n - m) > most, False).when(apart > most, False).when(~whole, False).when(F.contains(x, y) | F.contains(y, x), near(F.abs(n - m)))
        return told_soon.when(signs > most, False).when(near(places), True).otherwise((distance >= 0) & near(distance))

    x, y = _beginning(a, compared), _beginning(b, compared)
    return let(told, x=x, y=y, n=F.char_length(x), m=F.char_length(y))


def normalized(c: Column, pack: Pack) -> Column:
    """A reading without the blanks that its reader put in; trimmed.

    Runs of blanks (U+0020, U+3000) vanish between two characters of an unspaced script and are one blank elsewhere;
    other white space stays. In spaced scripts every run of white space is one blank.
    """
    if pack.spaced:
        return trimmed(F.regexp_replace(c, f"{SPACE}+", " "))
    script = f"[{pack.script}&&[^ \u3000]]"
    closed = F.regexp_replace(c, rf"(?<={script})[ \u3000]+(?={script})", "")
    return trimmed(F.regexp_replace(closed, r"[ \u3000]+", " "))


def repeated_run(c: Column) -> Column:
    """The first phrase of one word, else two, three or four, said four times in a row in a text of eight words; null if none.

    One pass looks for any such phrase; only texts that hold one are looked through size by size.
    """
    return repeated_in(single_spaced(c))


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def repeated_in(plain: Column) -> Column:
    """:func:`repeated_run` of a text with single blanks."""
    of = lambda k: F.nullif(F.regexp_extract(plain, rf"(?:^| )(\S++(?: \S++){{{k - 1}}})(?: \1){{3}}(?= |$)", 1), F.lit(""))
    any_ = plain.rlike(r"(?:^| )(\S++(?: \S++){0,3}?)(?: \1){3}(?= |$)")
    # what is said four times leaves at least three words fewer that differ; that is sooner told than the pattern
    again = let(lambda w: (F.size(w) >= 8) & (F.size(w) - F.size(F.array_distinct(w)) >= 3), w=F.split(plain, " "))
    return F.when(again & any_, F.coalesce(*[of(k) for k in range(1, 5)]))


def instruction_leak(c: Column) -> Column:
    """How the answer gives away its instructions; null if it does not."""
    # one letter alone becomes ASCII in lower case and stays apart from what follows: the dotted capital at an end
    leaks = "|".join(re.escape(x[:-1]) + ("[i\u0130]" if x[-1] == "i" else re.escape(x[-1])) for x in LEAKS)
    opening = F.regexp_extract(F.left(c, F.lit(max(map(len, LEAKS)))), f"(?i)^(?:{leaks})", 0)
    return F.when(opening != "", opening).when(c.rlike("(?i)translates to") & F.contains(F.substring_index(F.lower(c), "\n", 1), F.lit("translates to")), "translates to")


def ends_at_stop(c: Column, pack: Pack) -> Column:
    """Whether a text ends with a stop, or with one closer after one; null and blank texts do."""
    stops, closers = re.escape(pack.stops), re.escape(pack.closers)
    return F.coalesce(trimmed(c) == "", F.lit(True)) | trimmed(c).rlike(f"[{stops}][{closers}]?$")


def list_item(c: Column) -> Column:
    """Whether a line begins like an item of a list."""
    return c.rlike(f"^(?:{'|'.join(ITEMS)})")


def upper_median(values: Column) -> Column:
    """The middle value of an array, the upper one of two."""
    return F.try_element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def _common(a: Column, b: Column, n: Column) -> Column:
    """Characters of the longest beginning that two texts share, ``n`` at most: by halves, each comparing two beginnings."""
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda at, step: F.when(step > n - at, at).when(F.left(a, at + step) == F.left(b, at + step), at + step).otherwise(at))


def differing(a: Column, b: Column) -> Column:
    """What is left of two texts without their common beginning and end."""

    def of(n: Column, head: Column, tail: Column) -> Column:
        end = F.least(tail, n - head)
        return F.struct(F.substring(a, head + 1, F.char_length(a) - head - end).alias("left"), F.substring(b, head + 1, F.char_length(b) - head - end).alias("right"))

    n = F.least(F.char_length(a), F.char_length(b))
    return let(of, n=n, head=_common(a, b, n), tail=_common(F.reverse(a), F.reverse(b), n))


def quoted_difference(a: Column, b: Column) -> Column:
    """What tells two readings apart, in words: the differing part of each, 24 characters at most."""

    def said(d: Column) -> Column:
        quote = lambda x: F.when(x == "", "nothing").otherwise(F.concat(F.lit("“"), F.substring(x, 1, 24), F.lit("”")))
        left, right = trimmed(d["left"]), trimmed(d["right"])
        return F.when((d["left"] == "") | (d["right"] == "") | (left == "") & (right == ""), "they differed").otherwise(F.concat(quote(left), F.lit(" against "), quote(right)))

    return let(said, d=differing(a, b))

