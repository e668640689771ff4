"""Sentences of a text and their features, for the subject model."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import regex

_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<\|[^<>|]+\|>")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
#: A lead byte of UTF-8 read as a Latin letter, then a continuation byte read as Latin-1 or Windows-1252.
_MOJIBAKE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
#: What may stand before a sentence on its line: time stamps, table frames, list marks, speakers, headings.
_LEAD = re.compile(r"^(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d)?\s+(?:[A-Z]{3,8}|note)\b|\|(?:\s*\d+\s*\|)?|\d+(?:\.\d+)+\.?(?=\s)|\d+[.)](?=\s)|[-*•>]+(?=\s)|#+(?=\s)|[A-Z]\w{1,20}>(?=\s)|\s+)+")
_FRAME = re.compile(r"^[\s|:*=_~#-]*$|^\|?\s*no\s*\|\s*text\s*\|?$")
#: An answer on the line of its question belongs to it.
_END = re.compile(r"(?<=[.?!])\s+(?!A:)|(?<=[。！？])\s*")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_SYMBOL = regex.compile(r"[\p{So}\p{Cs}\uFE0F]")
_HYPHEN = re.compile(r"(?<=[^\s-])-\n(?=\S)")
_FOOTER = re.compile(r"^--\s*$.*?(?=\n\s*\n|\Z)", re.S | re.M)


def repaired(text: str) -> str:
    """Text without markup, code blocks, page footers and invisible signs, in one normal form, mis-decoded UTF-8 decoded again."""
    if _MOJIBAKE.search(text):
        fixed = []
        for line in text.split("\n"):
            for codec in ("cp1252", "latin-1"):
                try:
                    line = line.encode(codec).decode("utf-8")
                    break
                except UnicodeError:
                    continue
            fixed.append(line)
        text = "\n".join(fixed)
    text = html.unescape(_TAG.sub("\n", text)) if "<" in text or "&" in text else text
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _SYMBOL.sub("", _INVISIBLE.sub("", text)))
    text = _CODE.sub("\n", text) if "```" in text else text
    text = _FOOTER.sub("\n", text) if "--" in text else text
    return _HYPHEN.sub("", text) if "-\n" in text else text


def pieces(clean: str) -> Iterator[str]:
    """What may be a sentence: repaired lines without what stands before them, cut at the marks that end sentences."""
    for line in clean.split("\n"):
        line = _LEAD.sub("", line.strip())
        if _FRAME.match(line):
            continue
        for s in _END.split(line.rstrip("| ")):
            yield s.strip()


def is_sentence(piece: str) -> bool:
    return len(_WORD.findall(piece)) >= 2 or sum(map(len, _HAN.findall(piece))) >= 2


def _of(clean: str) -> list[str]:
    return [s for s in pieces(clean) if is_sentence(s)]


def parts(text: str) -> list[str]:
    """The repaired paragraphs (between blank lines) of a text."""
    return re.split(r"\n\s*\n", repaired(text))


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, in order; lines, and . ? ! or their full-width forms, end one. None for a null text."""
    return _of(repaired(text)) if text else []


def paragraphs(text: str | None) -> list[list[str]]:
    """The sentences of each paragraph (between blank lines) that has any."""
    return [p for part in parts(text) if (p := _of(part))] if text else []


#: Function words by which the language of a text is told; Chinese is told by its signs.
FUNCTION_WORDS = {
    "en": frozenset("the of is to and was in on for with this that not are by it an no".split()),
    "de": frozenset("der die das und ist für mit im nicht den von zu wurde wurden es um am auf ein bei aus".split()),
    "fr": frozenset("le la les de des et est un une il ne en dans pour à sur du ont été".split()),
}

#: Turns of phrase by which a sentence names a subject only in passing, or to deny it.
ASIDES = (
    "nothing to do with", "unrelated", "by the way", "aside", "not about", "no bearing on",
    "nichts zu tun", "nebenbei", "übrigens", "am rande", "ohne bezug",
    "rien à voir", "au passage", "sans rapport", "en aparté",
    "无关", "顺便", "题外",
)
_ASIDE = re.compile("|".join(p if _HAN.match(p) else rf"\b{p}\b" for p in ASIDES))


_ASIDE_START = re.compile("|".join(sorted({re.escape(p[:4]) for p in ASIDES})))


def is_aside(sentence: str) -> bool:
    low = sentence.lower()
    return _ASIDE_START.search(low) is not None and _ASIDE.search(low) is not None


LANGUAGES = (*FUNCTION_WORDS, "zh")
_LANGUAGES_OF = {w: tuple(i for i, lang in enumerate(FUNCTION_WORDS) if w in FUNCTION_WORDS[lang]) for known in FUNCTION_WORDS.values() for w in known}


def _marks(words: list[str], signs: int) -> tuple[int, ...]:
    n = [0] * len(LANGUAGES)
    for w in words:
        for i in _LANGUAGES_OF.get(w, ()):
            n[i] += 2
    n[-1] = signs
    return tuple(n)


def language_marks(sentence: str) -> tuple[int, ...]:
    """How much speaks for each of LANGUAGES: two for each of its function words, one for each Chinese sign."""
    low = sentence.lower()
    return _marks(_WORD.findall(low), 0 if low.isascii() else sum(map(len, _HAN.findall(low))))


def language_of(marks: list[int]) -> str:
    """The language for which most speaks; the first of LANGUAGES if nothing does."""
    return LANGUAGES[max(range(len(LANGUAGES)), key=lambda i: marks[i])]


def language(sents: list[str]) -> str:
    """The language of a text of these sentences."""
    marks = [0] * len(LANGUAGES)
    for s in sents:
        marks = [a + b for a, b in zip(marks, language_marks(s))]
    return language_of(marks)


def features(sentence: str) -> list[str]:
    """Words and pairs of neighbouring words, and two to four neighbouring Chinese signs, each once."""
    low = sentence.lower()
    runs = [] if low.isascii() else _HAN.findall(low)
    return _features(_WORD.findall(_HAN.sub(" ", low) if runs else low), runs)


def _features(words: list[str], runs: list[str]) -> list[str]:
    grams = [run[i : i + n] for run in runs for n in (2, 3, 4) for i in range(len(run) - n + 1)]
    words = [w[:-1] if len(w) > 3 and w[-1] == "s" else w for w in words]
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:])), *grams]))


def analysed(piece: str) -> tuple[list[str], tuple[int, ...]] | None:
    """Features and language marks of a piece of text, None if it is no sentence: the same as the functions above, in one go."""
    low = piece.lower()
    if low.isascii():
        words = _WORD.findall(low)
        return (_features(words, []), _marks(words, 0)) if len(words) >= 2 else None
    return (features(piece), language_marks(piece)) if is_sentence(piece) else None
