"""Text measures as Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and quality thresholds that results depend on.
BLANK = r"\x{1c}-\x{1f}\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + BLANK + "]"
LINE_END = r"\r\n|[\n\r\x{0b}\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
URL = r"(?i)https?://|www\."


def normalized(text: Column) -> Column:
    """Compatibility composition, control characters out, one kind of line end, single blanks, no blank around lines, one empty line at most.

    Runs of blanks are matched from their beginning only and given back nowhere, so the time is linear in the text's length. What is
    before a blank is looked at after the blank is found, not at each character.
    """
    t = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    for pattern, to in (
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"\r\n?", "\n"), (r"[ \t]+", " "), (rf"(?:(?<=\n)|^)[{BLANK}&&[^\n]]+", ""), (rf"[{BLANK}&&[^\n]](?<![{BLANK}&&[^\n]]{{2}})[{BLANK}&&[^\n]]*+(?=\n|\z)", ""), (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(t, F.lit(BLANKS))


def repeated_chars(text: Column) -> Column:
    """Share of characters that are the third or later of a run."""
    short = F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1")
    return F.when(F.length(text) == 0, 1.0).otherwise((F.length(text) - F.length(short)) / F.greatest(F.length(text), F.lit(1)))


def repeated_ngrams(text: Column, n: int = 5) -> Column:
    """Share of word n-grams that occurred before, 0 below 2n words. They are compared by 64-bit hashes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    # one array element in, so that the words are found once
    def share(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.transform(F.array(grams), lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g))[0]

    return F.transform(F.array(words), lambda w: F.when(F.size(w) < 2 * n, 0.0).otherwise(share(w)))[0]


def alpha_share(text: Column) -> Column:
    # by what is left: regexp_count makes a string of each match
    solid, rest = F.length(F.regexp_replace(text, f"[{BLANK}]+", "")), F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return F.when(solid == 0, 0.0).otherwise((F.length(text) - rest) / F.greatest(solid, F.lit(1)))


def url_rate(text: Column) -> Column:
    """Markers of addresses for each hundred characters."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(URL)) / F.greatest(F.lit(1.0), F.length(text) / 100))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, LINE_END, -1), F.length))


def text_hash(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def number_of(text: Column) -> Column:
    """The first 32 bits of the text's SHA-1 as a number."""
    return F.conv(F.substring(text_hash(text), 1, 8), 16, 10).cast("bigint")


def ids_hash(ids: Column) -> Column:
    return F.sha1(F.array_join(ids.cast("array<string>"), ",").cast("binary"))


def hash_tokens(text: Column, vocabulary: int = 32_000) -> Column:
    """FNV-1a over the code points of each word, folded into the ids from 4 on. Vocabularies of 16 ids or fewer are refused."""
    if vocabulary <= 16:
        raise ValueError("the vocabulary needs more than 16 ids")
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619).cast("bigint")
    fnv = lambda w: F.aggregate(F.split(w, ""), F.lit(2166136261).cast("bigint"), lambda h, c: step(h, c).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.lit(4) + fnv(w) % F.lit(vocabulary - 4)).cast("int"))
