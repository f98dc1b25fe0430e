"""Scalar functions over text, each as a Column and, for the document kernels, as plain Python.

The tokenizer follows Unicode's rules for words and sentences as far as regular expressions that Java, RE2
and Python agree on can: sentences end behind . ! ? and their CJK forms and at line ends, not before a
lower-case letter; words keep marks between letters (a full stop, an apostrophe, a colon) and between digits (a
full stop, a comma), so ``1,000`` is one word; Han and Hiragana stand alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"
#: pattern, replacement up to the mark, replacement behind it
SENTENCE_ENDS = (
    (r"""([!?。！？]+["')\]”’»]*[ \t]*)""", 1, 0),
    (r"""([.…]+["')\]”’»]*[ \t]+)([^\p{Ll} \t])""", 1, 2),
    (r"""([\r\n]+)""", 1, 0),
)
IDEOGRAPH = r"[\p{IsHan}\p{IsHiragana}]"
_RUN = r"[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]++"
#: what may be within a word, between letters and between digits
BETWEEN_LETTERS, BETWEEN_DIGITS = ":.'’·", ",.;'’"
#: possessive, so that Java goes through a long row of numbers without a recursion for each
WORD = rf"{_RUN}(?:(?:(?<=[\p{{L}}\p{{M}}])[{BETWEEN_LETTERS}](?=\p{{L}})|(?<=\p{{N}})[{BETWEEN_DIGITS}](?=\p{{N}})){_RUN})*+"
GAP = r"[^\p{L}\p{M}\p{N}_\x01]+"
HAS_LETTER = r"[\p{L}\p{N}]"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"

FUNCTION_WORDS = {
    "DET": "a an the this that these those my your his her its our their some any each every no",
    "CCONJ": "and or but nor so yet if because while though although when unless until since",
    "ADP": "of to in for on with at from by about as into like through after over between out against during without before under around among",
    "PRON": "i you he she it we they me him us them myself yourself ourselves themselves",
    "PART": "not n't",
}
TAG_OF = {w: tag for tag, words in FUNCTION_WORDS.items() for w in words.split()}
TITLE = r"^\p{Lu}\p{Ll}*$"
SUFFIXES = (
    ("ADJ", "ful less ous ive able ible al ic"),
    ("VERB", "ing ed ize"),
    ("ADV", "ly"),
    ("NOUN", "tion ness ment ity er or"),
)
NUMBER = r"^[0-9.,]+$"
TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "INTJ", "NUM", "PART", "PUNCT", "SYM", "PROPN", "X")
TAG_ALIASES = {
    "NOUN": "NOUN", "VERB": "VERB", "ADJ": "ADJ", "ADJECTIVE": "ADJ", "ADV": "ADV", "ADVERB": "ADV", "PRON": "PRON", "PRONOUN": "PRON", "DET": "DET", "DETERMINER": "DET",
    "ADP": "ADP", "PREPOSITION": "ADP", "CCONJ": "CCONJ", "SCONJ": "CCONJ", "CONJ": "CCONJ", "CONJUNCTION": "CCONJ", "INTJ": "INTJ", "NUM": "NUM", "PART": "PART", "PUNCT": "PUNCT",
    "SYM": "SYM", "PROPN": "PROPN", "PROPERNOUN": "PROPN",
}
CONTENT_TAGS = ("NOUN", "VERB", "ADJ", "PROPN")


def marked(text: Column) -> Column:
    """The text with MARK behind each sentence but the last."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, " ")
    for pattern, a, b in SENTENCE_ENDS:
        t = F.regexp_replace(t, pattern, f"${a}{MARK}" + (f"${b}" if b else ""))
    return t


def sentences_of(text: Column) -> Column:
    """The text cut into sentences, white space and all: joined again, it is the text."""
    return F.split(marked(text), MARK)


def items_of(text: Column) -> Column:
    """Words, the gaps between them and marks, in order and complete."""
    return F.regexp_extract_all(text, F.lit(f"{MARK}|{IDEOGRAPH}|{WORD}|{GAP}"), F.lit(0))


def is_word(item: Column) -> Column:
    return item.rlike(HAS_LETTER)


def tag_of(word: Column) -> Column:
    """The part of speech that a word looks like (UPOS)."""
    low = F.lower(word)
    out = F.when(F.lit(False), F.lit(""))
    for tag, words in FUNCTION_WORDS.items():
        out = out.when(low.isin(words.split()), F.lit(tag))
    out = out.when(word.rlike(TITLE), F.lit("PROPN"))
    for tag, ends in SUFFIXES:
        out = out.when(low.rlike(f"(?:{'|'.join(ends.split())})$"), F.lit(tag))
    return out.when(word.rlike(NUMBER), F.lit("NUM")).otherwise(F.lit("NOUN"))


def lemma_of(word: Column) -> Column:
    """An English word's base form by its ending; lengths count bytes."""
    low = F.lower(word)
    size, cut = F.octet_length(low), lambda n: F.left(low, F.length(low) - n)
    doubled = lambda s: (F.length(s) >= 2) & (F.right(s, F.lit(1)) == F.substring(F.right(s, F.lit(2)), 1, 1))
    once = lambda s: F.left(s, F.length(s) - 1)
    ing, ed = cut(F.lit(3)), cut(F.lit(2))
    return (
        F.when(low.endswith("ies") & (size > 4), F.concat(cut(F.lit(3)), F.lit("y")))
        .when(low.endswith("es") & (size > 3) & ed.rlike("(?:ss|sh|ch|x|o)$"), ed)
        .when(low.endswith("s") & (size > 2) & ~low.endswith("ss"), cut(F.lit(1)))
        .when(low.endswith("ing") & (size > 5), F.when(doubled(ing), once(ing)).otherwise(ing))
        .when(low.endswith("ed") & (size > 4), F.when(doubled(ed), once(ed)).when(low.endswith("ied"), F.concat(cut(F.lit(3)), F.lit("y"))).otherwise(ed))
        .otherwise(low)
    )


def scrub(text: Column) -> Column:
    """Letters and digits in lower case, one space for whatever else is between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def is_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def graph_key(lemma: Column, tag: Column, use_pos: bool = True) -> Column:
    return F.concat_ws("|", lemma, tag) if use_pos else lemma


def tag_name(tag: Column) -> Column:
    """A part of speech by any of its names; X for one that is unknown."""
    names = F.create_map(*(F.lit(x) for k, v in TAG_ALIASES.items() for x in (k, v)))
    return F.coalesce(F.element_at(names, F.upper(tag)), F.lit("X"))


# ---- the same for one word or document, in Python

_ENDS = tuple((tag, tuple(ends.split())) for tag, ends in SUFFIXES)
_ALNUM = re.compile(r"[^\W_]+")


def py_tag_name(tag: str | None) -> str:
    return TAG_ALIASES.get((tag or "").upper(), "X")


def py_tag(word: str) -> str:
    low = word.lower()
    if low in TAG_OF:
        return TAG_OF[low]
    if word[:1].isupper() and all(map(str.islower, word[1:])):
        return "PROPN"
    for tag, ends in _ENDS:
        if low.endswith(ends):
            return tag
    return "NUM" if not word.strip("0123456789.,") else "NOUN"


def py_lemma(word: str) -> str:
    low = word.lower()
    size = len(low.encode())
    once = lambda s: s[:-1] if len(s) >= 2 and s[-1] == s[-2] else None
    if low.endswith("ies") and size > 4:
        return low[:-3] + "y"
    if low.endswith("es") and size > 3 and low[:-2].endswith(("ss", "sh", "ch", "x", "o")):
        return low[:-2]
    if low.endswith("s") and size > 2 and not low.endswith("ss"):
        return low[:-1]
    if low.endswith("ing") and size > 5:
        return once(low[:-3]) or low[:-3]
    if low.endswith("ed") and size > 4:
        return once(low[:-2]) or (low[:-3] + "y" if low.endswith("ied") else low[:-2])
    return low


def py_scrub(text: str) -> str:
    return " ".join(_ALNUM.findall(text.lower()))


def py_patterns():
    """Compiled sentence ends and items; made where they are used, as compiled patterns don't travel."""
    import regex

    to_py = lambda p: regex.compile(p.replace("Is", ""), regex.V1)
    run = r"[[\p{L}\p{M}\p{N}_]--[\p{Han}\p{Hiragana}]]++"
    word = rf"{run}(?:(?:(?<=[\p{{L}}\p{{M}}])[{BETWEEN_LETTERS}](?=\p{{L}})|(?<=\p{{N}})[{BETWEEN_DIGITS}](?=\p{{N}})){run})*+"
    ends = [(to_py(p), f"\\{a}{MARK}" + (f"\\{b}" if b else "")) for p, a, b in SENTENCE_ENDS]
    return ends, regex.compile(rf"[\p{{Han}}\p{{Hiragana}}]|{word}", regex.V1)
