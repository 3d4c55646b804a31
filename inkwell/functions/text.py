"""Text as column expressions.

Nothing here leaves the JVM except dictionary segmentation of Han runs, which is
only planned in when the caller brings a lexicon (see ``functions.han``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python calls whitespace, the Han range of the token test,
# the sentence delimiters and the accepted part-of-speech tags.
SPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
SPACE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
HAN = r"\x{4E00}-\x{9FA5}"
SENTENCE_DELIMITERS = ("?", "!", ";", "？", "！", "。", "；", "……", "…", "\n")
ALLOWED_TAGS = (
    "an", "i", "j", "l", "n", "nr", "nrfg", "ns", "nt", "nz", "t", "v", "vd", "vn", "eng",
)

# Fixed patterns: how text outside Han runs falls into words, and which words count.
# "reference" knows ASCII letters only; "letters" takes any script, for accented languages.
DOCUMENT_RUNS = {
    "reference": r"[A-Za-z0-9]+(?:\.[0-9]+)?%?",
    "letters": rf"[\p{{L}}\p{{N}}_&&[^{HAN}]]+",
}
SENTENCE_RUNS = {
    "reference": r"[.0-9]+|[A-Za-z][A-Za-z0-9]*",
    "letters": rf"[.0-9]+|[\p{{L}}_&&[^{HAN}]][\p{{L}}\p{{N}}_&&[^{HAN}]]*",
}
TOKEN_TEST = {
    "reference": rf"^[{HAN}_a-zA-Z]+$",
    "letters": r"^[\p{L}_]+$",
}
# The same runs in text without Han characters: a run that passes the token test is group 1, any other matches without it.
PLAIN_TOKENS = {
    "reference": r"([A-Za-z]{2,}+)(?![0-9%]|\.[0-9])|[A-Za-z0-9]+(?:\.[0-9]+)?%?",
    "letters": r"([\p{L}_]{2,}+)(?!\p{N})|[\p{L}\p{N}_]+",
}
NUMBERS = r"[.0-9]+|"  # the first kind of run in a sentence; no other run begins with one of its characters
NUMBER_START = r"^[.0-9]"
HAN_START = rf"^[{HAN}]"


def trim_space(text: Column) -> Column:
    """Strip Unicode whitespace at both ends (``trim`` by itself would only strip spaces)."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def strip_space(text: Column, mode: str = "cjk") -> Column:
    """Remove whitespace: ``"all"`` of it, only between Han characters (``"cjk"``), or ``"none"``."""
    if mode == "all":
        return F.regexp_replace(text, rf"{SPACE}+", "")
    if mode == "cjk":
        return F.regexp_replace(text, rf"(?<=[{HAN}]){SPACE}+(?=[{HAN}])", "")
    if mode == "none":
        return text
    raise ValueError(f"unknown mode {mode!r}")


def title_names(text: Column) -> Column:
    """Distinct names quoted as ``《…》``, in order of appearance, marks removed."""
    names = F.regexp_extract_all(text, F.lit("《(.*?)》"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda name: F.regexp_replace(name, "《", "")))


def drop_titles(text: Column) -> Column:
    return F.regexp_replace(text, "《.*?》", "")


def drop_document_numbers(text: Column, greedy: bool = False) -> Column:
    """Remove ``（…号）``; ``greedy`` runs from the first bracket to the last number on the line."""
    return F.regexp_replace(text, "（.*号）" if greedy else "（[^（）]*号）", "")


def keep_token(token: Column, stop_words: Iterable[str] = (), token_class: str = "reference") -> Column:
    """The token test: two or more characters, only word characters, not a stop word."""
    stop_words = list(stop_words)
    kept = (F.length(token) >= 2) & token.rlike(TOKEN_TEST[token_class])
    return kept & ~token.isin(stop_words) if stop_words else kept


def han_bigrams(run: Column) -> Column:
    """A Han run as overlapping two-character tokens (a lone character stays whole)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1)))
    return F.transform(starts, lambda start: F.substring(run, start, F.lit(2)))


def _runs(text: Column, latin: str) -> Column:
    """Word runs in order: Latin-like runs whole, Han runs as bigrams."""

    def with_han(value: Column) -> Column:
        runs = F.regexp_extract_all(value, F.lit(rf"[{HAN}]+|{latin}"), F.lit(0))
        return F.flatten(
            F.transform(
                runs,
                lambda run: F.when(run.rlike(HAN_START), han_bigrams(run)).otherwise(F.array(run)),
            )
        )

    return F.when(text.rlike(f"[{HAN}]"), with_han(text)).otherwise(
        F.regexp_extract_all(text, F.lit(latin), F.lit(0))
    )


def raw_runs(text: Column, token_class: str = "reference", sentence: bool = False) -> Column:
    """Word runs with Han runs left whole: the input of dictionary segmentation."""
    latin = (SENTENCE_RUNS if sentence else DOCUMENT_RUNS)[token_class]
    return F.regexp_extract_all(text, F.lit(rf"[{HAN}]+|{latin}"), F.lit(0))


def clean_document(
    text: Column,
    space: str = "cjk",
    titles: bool = False,
    document_numbers: str | None = None,
    lower: bool = False,
) -> Column:
    """The text that gets segmented: whitespace, titles and document numbers taken out."""
    text = strip_space(text, space)
    if titles:
        text = drop_titles(text)
    if document_numbers:
        text = drop_document_numbers(text, greedy=document_numbers == "greedy")
    return F.lower(text) if lower else text


def document_tokens(
    text: Column,
    stop_words: Iterable[str] = (),
    token_class: str = "reference",
    space: str = "cjk",
    titles: bool = False,
    document_numbers: str | None = None,
    lower: bool = False,
    segment=None,
) -> Column:
    """A document as its array of tokens.

    ``titles`` puts names quoted as 《…》 first, as whole tokens outside the token test.
    ``document_numbers`` drops （…号）: ``"bracket"`` or ``"greedy"``.
    ``segment`` is a column function from ``functions.han.segmenter``; without one,
    Han runs become character bigrams.
    """
    stop_words = list(stop_words)
    cleaned = clean_document(text, space, titles, document_numbers, lower)
    if segment is None:
        pieces = _runs(cleaned, DOCUMENT_RUNS[token_class])
    else:
        pieces = F.transform(segment(raw_runs(cleaned, token_class)), lambda piece: piece["word"])
    tokens = F.filter(pieces, lambda token: keep_token(token, stop_words, token_class))
    if segment is None:  # without Han characters no space lies between two, and the expression itself tests its runs
        plain = clean_document(text, "none" if space == "cjk" else space, titles, document_numbers, lower)
        runs = F.regexp_extract_all(plain, F.lit(PLAIN_TOKENS[token_class]), F.lit(1))
        passed = F.filter(runs, lambda token: ~token.isin(["", *stop_words]))
        tokens = F.when(text.rlike(f"[{HAN}]"), tokens).otherwise(passed)
    if not titles:
        return tokens
    names = title_names(strip_space(text, space))
    return F.concat(F.transform(names, F.lower) if lower else names, tokens)


def delimiter_pattern(delimiters: Iterable[str] = SENTENCE_DELIMITERS) -> str:
    """One character class where possible; a longer mark made of single marks adds nothing."""
    singles = {mark for mark in delimiters if len(mark) == 1}
    longer = sorted({mark for mark in delimiters if not set(mark) <= singles}, key=len, reverse=True)
    parts = [re.escape(mark) for mark in longer]
    if singles:
        parts.append("[" + "".join(re.escape(mark) for mark in sorted(singles)) + "]")
    return "|".join(parts)


def sentences(text: Column, delimiters: Iterable[str] = SENTENCE_DELIMITERS) -> Column:
    """The text's sentences: split at the delimiters, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, delimiter_pattern(delimiters)), trim_space)
    return F.filter(parts, lambda part: part != "")


def word_tag(word: Column) -> Column:
    """Part-of-speech tag of a word outside Han text: number ``m`` or Latin word ``eng``."""
    return F.when(word.rlike(NUMBER_START), "m").otherwise("eng")


def tagged_words(
    sentence: Column, token_class: str = "reference", lower: bool = True, segment=None
) -> Column:
    """A sentence as ``array<struct<word, tag>>``; unlisted Han bigrams are tagged ``n``."""
    if segment is None:
        pieces = F.transform(
            _runs(sentence, SENTENCE_RUNS[token_class]),
            lambda word: F.struct(
                word.alias("word"),
                F.when(word.rlike(HAN_START), "n").otherwise(word_tag(word)).alias("tag"),
            ),
        )
    else:
        pieces = segment(raw_runs(sentence, token_class, sentence=True))
    return lower_words(pieces) if lower else pieces


def lower_words(pieces: Column) -> Column:
    return F.transform(
        pieces, lambda piece: F.struct(F.lower(piece["word"]).alias("word"), piece["tag"].alias("tag"))
    )


def sentence_runs(sentence: Column, token_class: str = "reference", lower: bool = True) -> Column:
    """A sentence's words as ``tagged_words`` finds them without a segmenter, untagged."""
    runs = _runs(sentence, SENTENCE_RUNS[token_class])
    return F.transform(runs, F.lower) if lower else runs


def without_words(words: Column, stop_words: Iterable[str] = ()) -> Column:
    stop_words = list(stop_words)
    return F.filter(words, lambda word: ~word.isin(stop_words)) if stop_words else words


def with_tags(words: Column, allowed_tags: Iterable[str] = ALLOWED_TAGS) -> Column:
    """Words of ``sentence_runs`` whose tag is allowed: ``m`` for numbers, ``n`` for Han bigrams, otherwise ``eng``."""
    blocked = [tag for tag in ("m", "n", "eng") if tag not in set(allowed_tags)]
    if not blocked:
        return words
    number = lambda word: F.substring(word, 1, 1).isin(list(".0123456789"))
    tests = {"m": number, "n": lambda word: word.rlike(HAN_START), "eng": lambda word: ~number(word) & ~word.rlike(HAN_START)}

    def passes(word: Column) -> Column:
        return ~reduce(lambda a, b: a | b, (tests[tag](word) for tag in blocked))

    return F.filter(words, passes)


def select_words(
    tagged: Column,
    source: str = "all_filters",
    stop_words: Iterable[str] = (),
    allowed_tags: Iterable[str] = ALLOWED_TAGS,
) -> Column:
    """One of the three word lists of a sentence; an unknown ``source`` means ``no_stop_words``."""
    stop_words, allowed_tags = list(stop_words), list(allowed_tags)
    kept = tagged
    if source != "no_filter":
        if stop_words:
            kept = F.filter(kept, lambda piece: ~piece["word"].isin(stop_words))
        if source == "all_filters":
            kept = F.filter(kept, lambda piece: piece["tag"].isin(allowed_tags))
    return F.transform(kept, lambda piece: piece["word"])


def sentence_words(
    text: Column,
    source: str = "all_filters",
    stop_words: Iterable[str] = (),
    token_class: str = "reference",
    lower: bool = True,
    delimiters: Iterable[str] = SENTENCE_DELIMITERS,
    allowed_tags: Iterable[str] = ALLOWED_TAGS,
) -> Column:
    """All sentences of a document as word lists, ``array<array<string>>``.

    Plain text needs one regular expression per list; the tag of each word follows
    from its first character, so no tagged structure is built.
    """
    stop_words, allowed_tags = list(stop_words), list(allowed_tags)
    tagged = source == "all_filters"
    latin = SENTENCE_RUNS[token_class]
    if tagged and "m" not in allowed_tags:
        latin = latin.removeprefix(NUMBERS)
    blocked = [rf"[{HAN}]" if "n" not in allowed_tags else None, rf"[^.0-9{HAN}]" if "eng" not in allowed_tags else None]
    starts = "|".join(start for start in blocked if start) if tagged else ""

    def passes(word: Column) -> Column:
        kept = ~word.isin(stop_words) if stop_words and source != "no_filter" else F.lit(True)
        return kept & ~word.rlike(f"^(?:{starts})") if starts else kept

    def filtered(runs: Column) -> Column:
        return F.filter(runs, passes) if starts or (stop_words and source != "no_filter") else runs

    parts = sentences(text, delimiters)
    parts = F.transform(parts, F.lower) if lower else parts
    plain = F.transform(parts, lambda part: filtered(F.regexp_extract_all(part, F.lit(latin), F.lit(0))))
    mixed = F.transform(parts, lambda part: filtered(_runs(part, latin)))
    return F.when(text.rlike(f"[{HAN}]"), mixed).otherwise(plain)


def whole_sentence_token(sentence: Column) -> Column:
    """The sentence without whitespace as a one-element token array."""
    return F.array(strip_space(sentence, "all"))


def keyword_line(line: Column) -> Column:
    """``[a,b,c]`` as an array; blanks after commas stay part of the element."""
    return F.split(F.regexp_replace(line, r"\A[\[\]]+|[\[\]]+\z", ""), ",")


def decode_text(value: Column) -> Column:
    """UTF-8 bytes as text, with undecodable bytes left out.

    The three bytes of a genuine replacement character never occur inside another character, so the
    bytes are cut at them; the pieces are repaired by themselves and put together again.
    """
    raw = value.cast("binary")
    genuine = "\u00ef\u00bf\u00bd"  # its bytes, read as Latin-1
    pieces = F.split(F.decode(raw, "ISO-8859-1"), genuine, -1)
    repaired = F.transform(
        pieces, lambda piece: F.replace(F.make_valid_utf8(F.encode(piece, "ISO-8859-1").cast("string")), F.lit("\ufffd"), F.lit(""))
    )
    as_string = raw.cast("string")
    return F.when(F.is_valid_utf8(as_string), as_string).otherwise(F.array_join(repaired, "\ufffd"))
