"""Secret scans by lexing assignments.

``lex`` cuts a text into comments, strings (escaped, triple, back-quoted), operators, brackets and line starts,
so what stands in a string isn't taken for code.  ``scan`` reads name-literal pairs off it: ``name = literal``,
``name: literal``, ``name := literal``, ``name => literal``, ``"name": literal``, ``table["name"] = literal``, with a
type between or without; configuration lines with bare values; indented blocks (``name: |``); elements
``<name>literal</name>`` and ``<x name="name" value="literal"/>``; calls ``setName("literal")`` and
``define("name", "literal")``.  Literals are strings, adjacent ones or joined by ``+`` or ``.``, and names of constants:
a name that was given a constant carries it on, so in ``x = "..."; password = x`` the literal of x is password's.
Scopes are braces and Python's functions and classes: what is assigned in a function is forgotten behind it,
what is assigned in a block is one more value that the name may have.  A comment is lexed by itself.

A literal is scored by how sensitive its target's name is and how much it has to hide.  Credentials that name
themselves by their format (issuers' prefixes) need no assignment.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, table

THRESHOLD = 0.5
MASK = "[SECRET]"
#: of a literal that is joined from parts, so many characters are scored: far more than the score can tell apart
MOST_JOINED = 4096

SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "pass": 0.8, "passwort": 1.0, "contraseña": 1.0, "secret": 0.95, "token": 0.9,
    "apikey": 0.95, "accesskey": 0.95, "secretkey": 1.0, "privatekey": 1.0, "authkey": 0.95, "credential": 0.9, "credentials": 0.9, "bearer": 0.9,
    "authorization": 0.85, "auth": 0.7, "key": 0.6, "salt": 0.55, "signature": 0.55, "dsn": 0.6, "connectionstring": 0.8, "mnemonic": 0.9, "seedphrase": 1.0,
}
#: a name with one of these isn't the secret itself
HARMLESS = {"public", "type", "length", "len", "count", "max", "min", "num", "hint", "name", "url", "uri", "path", "file", "field", "label", "policy", "expiry", "ttl", "id", "prefix", "regex", "pattern", "format"}
#: names whose literals are made of words
OF_WORDS = {"passphrase", "mnemonic", "seedphrase"}
PLACEHOLDER = re.compile(
    r"^(?:(.)\1*|<.*>|\$\w+|\$\{[^{}]*\}|\$\([^()]*\)|\{\{.*\}\}|%\w+%|%\(.*|(?:change|replace).?me.*|your[-_ ].*|your(?:password|secret|token|key|api).*|my.?(?:password|secret|token).*"
    r"|.*(?:example|placeholder|dummy|redacted).*|none|null|nil|true|false|undefined|password|secret|token|x+|\*+|test\d*)$",
    re.I | re.S,
)
FORMATS = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bsk_live_[A-Za-z0-9]{16,}|\bAIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----")
#: texts without a match have no assignment, call, element or such a format; Java reads it, too
CANDIDATE = r"""[=:]|\(\s*["'`]|</|AKIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|-----BEGIN"""
#: the same in parts, since a search for a string costs far less than one for CANDIDATE: strings, and patterns with a string that each match holds
CANDIDATE_STRINGS = ("=", ":", "</", "AKIA", "AIza", "-----BEGIN")
CANDIDATE_PATTERNS = (("(", r"""\(\s*["'`]"""), ("_", r"gh[pousr]_|sk_live_"), ("xox", r"xox[abprs]-"))
#: an authorization header's value is behind the scheme
SCHEME = re.compile(r"(?:bearer|basic|token|digest)[ \t]+(?=\S)", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
TYPES = {"str", "string", "text", "char", "bytes", "byte", "const", "auto", "any", "unicode"}
#: words of calls that give their first argument, a name, the second as its value
GIVES = {"define", "set", "put", "add", "property", "setenv", "putenv", "option", "header", "env", "environment", "config", "register", "insert", "append"}

NEXT = re.compile(r"""\"{3}|'{3}|["'`#{}()]|//|/\*|<!--|:=|=>|[=:]|\n[ \t]*(?=\S)""")
QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*){q}") for q in "\"'"}
NOT_ASSIGNED = re.compile(r"[=!<>:+*/%&|^~-]")
BARE = re.compile(r"[^\s\"'`,;#(){}\[\]<>]+")
NAME = re.compile(r"[^\W\d][\w.]*")
SPACE, BLANK = re.compile(r"[ \t]*"), re.compile(r"\s*")
JOIN = re.compile(r"[ \t]*(?:\+\s*|\.(?=[ \t]*[\"'$])[ \t]*|\\\r?\n\s*)")
DEFINES = re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]+\w")
DECLARES = re.compile(r"(?:^|[\s;{(])(?:let|const|var|local|my|final|val)[ \t]+(?:[\w<>\[\]]+[ \t]+)?$")
BLOCK = re.compile(r"[ \t]*[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\n")
TAG = re.compile(r"<([A-Za-z_][\w.:-]*)([^<>]*)>")
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


class Finding(NamedTuple):
    start: int
    end: int
    name: str | None
    via: str | None
    kind: str
    score: float
    literal: str


class Token(NamedTuple):
    kind: str  # string, comment, operator, line, or the bracket itself
    start: int
    end: int
    inner: tuple[int, int] = (0, 0)  # of a string or comment, what is within its marks


class _Value:
    """A constant: a piece of the text, or the join of others.  best is the highest score that its pieces were given."""

    __slots__ = ("text", "span", "parts", "via", "kind", "best")

    def __init__(self, text: str, span: tuple[int, int] | None, parts: tuple[_Value, ...] = (), via: str | None = None, kind: str = "string"):
        self.text, self.span, self.parts, self.via, self.kind, self.best = text, span, parts, via, kind, 0.0


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or HARMLESS & set(words):
        return 0.0
    pairs = [a + b for a, b in zip(words, words[1:])]
    plural = [w[:-1] for w in words if w.endswith("s")]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs, *plural]), default=0.0)


def strength(literal: str, of_words: bool = False) -> float:
    """From 0 to 1 by the literal's length times the entropy of its characters; 0 for a placeholder."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or not of_words and any(c.isspace() for c in literal.strip()):
        return 0.0
    n = len(literal)
    bits = -sum(c * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / 36)


def score(name: str, literal: str) -> float:
    least = sensitivity(name)
    if not least:
        return 0.0
    words = [w.lower() for w in WORDS.findall(name)]
    s = strength(literal, bool(OF_WORDS & {*words, *(a + b for a, b in zip(words, words[1:]))}))
    return round(least * (0.3 + 0.7 * s), 4) if s else 0.0


def lex(text: str, at: int = 0, end: int | None = None) -> list[Token]:
    """The tokens of text[at:end], in order.  A quote opens a string if it closes on its line and no word runs into it."""
    end = len(text) if end is None else end
    out: list[Token] = []
    never: set[str] = set()  # ends that don't come any more

    def closed(mark: str, begin: int) -> int:
        if mark in never:
            return -1
        if (found := text.find(mark, begin, end)) < 0:
            never.add(mark)
        return found

    while m := NEXT.search(text, at, end):
        what, start, at = m[0], m.start(), m.end()
        before = text[start - 1] if start else "\n"
        if what[0] in "\"'`":
            prefix = start
            while prefix and start - prefix < 3 and text[prefix - 1] in "rbufRBUF":
                prefix -= 1
            if (before.isalnum() or before == "_") and (prefix == start or prefix and (text[prefix - 1].isalnum() or text[prefix - 1] == "_")):
                at = start + 1
                continue
            if len(what) == 3 or what == "`":
                if (stop := closed(what, at)) >= 0:
                    out.append(Token("string", start, stop + len(what), (at, stop)))
                    at = stop + len(what)
                    continue
                what, at = what[0], start + 1
            if what in QUOTED and (q := QUOTED[what].match(text, start, end)):
                out.append(Token("string", start, q.end(), q.span(1)))
                at = q.end()
        elif what in ("#", "//"):
            if before.isspace() or what == "//" and before in ";{})":
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop
                out.append(Token("comment", start, stop, (at, stop)))
                at = stop
        elif what in ("/*", "<!--"):
            close = "*/" if what == "/*" else "-->"
            if (stop := closed(close, at)) >= 0:
                out.append(Token("comment", start, stop + len(close), (at, stop)))
                at = stop + len(close)
        elif what[0] == "\n":
            out.append(Token("line", start, at))
        elif what in "{}()":
            out.append(Token(what, start, at))
        elif not NOT_ASSIGNED.match(before) and not (what == "=" and text[at : at + 1] in ("=", "~")) and not (what == ":" and text[at : at + 1] in (":", "/", "=")):
            out.append(Token("operator", start, at))
    return out


class _Scan:
    """One pass over the tokens of text[begin:end], a scope of its own."""

    def __init__(self, text: str, begin: int, end: int, add):
        self.text, self.begin, self.end, self.add = text, begin, end, add
        self.tokens = lex(text, begin, end)
        self.strings = {t.start: t for t in self.tokens if t.kind == "string"}
        self.ending = {t.end: t for t in self.tokens if t.kind == "string"}
        self.scopes: list[tuple[object, dict[str, tuple[_Value, ...]], set[str]]] = [(None, {}, set())]  # how it ends, names, those declared in it

    def known(self, name: str) -> tuple[_Value, ...]:
        return next((own[name] for _, own, _ in reversed(self.scopes) if name in own), ())

    def leave(self) -> None:
        how, own, declared = self.scopes.pop()
        if how == "}":  # a block, not a function: the names outside may have the values
            outer = self.scopes[-1][1]
            for name, values in own.items():
                if name not in declared:
                    was = outer.get(name) or self.known(name)
                    outer[name] = (*was, *(v for v in values if not any(v is x for x in was)))

    def string_at(self, at: int) -> Token | None:
        """A string that begins here, whatever prefix it has."""
        for k in range(at, min(at + 3, self.end)):
            if found := self.strings.get(k):
                return found
            if self.text[k] not in "rbufRBUF@$":
                return None
        return None

    def name_before(self, at: int, low: int) -> tuple[str, int] | None:
        """The name that ends here, not before low, and where it begins: a word, a string, or a string in brackets."""
        text = self.text
        while at > low and text[at - 1] in " \t":
            at -= 1
        if (t := self.ending.get(at)) and t.start >= low:
            return text[slice(*t.inner)], t.start
        if at > low and text[at - 1] == "]":
            inside = at - 1
            while inside > low and text[inside - 1] in " \t":
                inside -= 1
            if t := self.ending.get(inside):
                return text[slice(*t.inner)], t.start
            return None
        start = at
        while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.-$"):
            start -= 1
        word = text[start:at].strip(".-$")
        if not word or not (word[0].isalpha() or word[0] == "_"):
            return None
        if word.lower() in TYPES and start > low and text[start - 1] in " \t":  # name type = ...
            return self.name_before(start, low) or (word, start)
        return word, start

    def value(self, at: int, op: str, config: bool) -> tuple[_Value, ...]:
        """The constants that may be assigned at a place; none if what stands there isn't one."""
        text, end = self.text, self.end
        block = BLOCK.match(text, at, end)
        if op == ":" and block:
            return self.block(block.end())
        at = SPACE.match(text, at, end).end()
        first = BLANK.match(text, at, end).end()
        if first > at and "\n" in text[at:first] or text[at : at + 2] == "\\\n":
            first = BLANK.match(text, at + 1, end).end() if text[at : at + 1] == "\\" else first
            if not self.string_at(first):
                return ()
            at = first
        brackets = 0
        while text[at : at + 1] == "(":
            at, brackets = BLANK.match(text, at + 1, end).end(), brackets + 1
        parts: list[_Value] = []
        via = None
        while True:
            if t := self.string_at(at):
                parts.append(self.piece(*t.inner))
                at = t.end
            else:
                m = BARE.match(text, at, end)
                if not m:
                    return ()
                word = m[0].rstrip(".")
                values = self.known(word.lstrip("$"))
                joined = JOIN.match(text, m.end(), end)
                if values:
                    if not parts and not joined:
                        return tuple(_Value(v.text, None, (v,), word, "propagated") for v in values)
                    parts.append(values[-1])  # of a joined name its last value
                    via = via or word
                elif parts or joined or text[m.end() : m.end() + 1] == "(":
                    return ()  # an unknown name or a call: not a constant
                else:
                    return self.bare(m.start(), word, op, config)
                at = m.end()
            following = JOIN.match(text, at, end)
            if following:
                at = following.end()
            elif (near := BLANK.match(text, at, end).end() if brackets else SPACE.match(text, at, end).end()) < end and self.string_at(near) and (near > at or brackets):
                at = near  # strings side by side
            else:
                break
        if len(parts) == 1 and not via:
            return (parts[0],)
        return (_Value("".join(p.text for p in parts)[:MOST_JOINED], None, tuple(parts), via, "propagated" if via else "string"),)

    def piece(self, start: int, end: int, kind: str = "string") -> _Value:
        if m := SCHEME.match(self.text, start, end):
            start = m.end()
        return _Value(self.text[start:end], (start, end), (), None, kind)

    def bare(self, start: int, word: str, op: str, config: bool) -> tuple[_Value, ...]:
        """A value without quotes: in a configuration line what stands to its end, else one word that isn't a name's."""
        text = self.text
        if m := SCHEME.match(text, start, self.end):
            start = m.end()
            if not (m := BARE.match(text, start, self.end)):
                return ()
            return (_Value(m[0], (start, m.end()), (), None, "bare"),)
        if config:
            stop = text.find("\n", start, self.end)
            line = text[start : self.end if stop < 0 else stop]
            line = re.split(r"[ \t]+[#;]", line, maxsplit=1)[0].rstrip()
            if any(c in " \t" for c in line):
                return (_Value(line, (start, start + len(line)), (), None, "words"),)
        if config and op == "=" and text[start - 1] == "=" or not word.replace("_", "").replace(".", "").isalpha():
            return (_Value(word, (start, start + len(word)), (), None, "bare"),)
        return ()

    def block(self, at: int) -> tuple[_Value, ...]:
        """The lines behind name: | as long as they are indented further than the line of the name."""
        text, parts = self.text, []
        own = text.rfind("\n", 0, at - 1) + 1
        margin = SPACE.match(text, own).end() - own
        while at < self.end:
            stop = text.find("\n", at, self.end)
            stop = self.end if stop < 0 else stop
            start = SPACE.match(text, at, stop).end()
            if start < stop:
                if start - at <= margin:
                    break
                parts.append(self.piece(start, start + len(text[start:stop].rstrip()), "block"))
            at = stop + 1
        if not parts:
            return ()
        return (parts[0],) if len(parts) == 1 else (_Value("\n".join(p.text for p in parts)[:MOST_JOINED], None, tuple(parts), None, "block"),)

    def give(self, name: str, values: tuple[_Value, ...], kind: str | None = None) -> None:
        """Scores what a name is given."""
        for v in values:
            if v.kind == "words" and not OF_WORDS & {w.lower() for w in WORDS.findall(name)}:
                continue
            if s := score(name, v.text):
                self.add(name, v, s, kind or ("bare" if v.kind == "words" else v.kind))

    def run(self) -> None:
        text, tokens = self.text, self.tokens
        margin = SPACE.match(text, self.begin, self.end).end()
        if DEFINES.match(text, margin, self.end):
            self.scopes.append((margin - self.begin, {}, set()))
        low, typed = self.begin, None  # where the name before an operator can begin; the name of the last colon
        for i, t in enumerate(tokens):
            if t.kind == "comment":
                _Scan(text, *t.inner, self.add).run()
                low = t.end
            elif t.kind == "line":
                low, typed = t.end, None
                indent = t.end - t.start - 1
                while isinstance(self.scopes[-1][0], int) and indent <= self.scopes[-1][0]:
                    self.leave()
                if DEFINES.match(text, t.end, self.end):
                    self.scopes.append((indent, {}, set()))
            elif t.kind == "{":
                self.scopes.append(("}", {}, set()))
                low = t.end
            elif t.kind == "}":
                if any(how == "}" for how, *_ in self.scopes):
                    while self.scopes[-1][0] != "}":
                        self.leave()
                    self.leave()
                low = t.end
            elif t.kind == "(":
                self.call(i)
                low = t.end
            elif t.kind == ")":
                low = t.end
            elif t.kind == "operator":
                op = text[t.start : t.end]
                found = self.name_before(t.start, low)
                if op == "=" and typed and typed[1] <= low and re.fullmatch(r"[\w\[\], .|<>?&*]*", text[typed[1] : t.start]):
                    found = (typed[0], typed[2])  # name: type = ...
                typed = (found[0], t.end, found[1]) if found and op == ":" else None
                if not found:
                    low = t.end
                    continue
                name, start = found
                line = text.rfind("\n", self.begin, start) + 1
                lead = text[max(line, self.begin) : start].strip(" \t\"'")
                values = self.value(t.end, op, lead in ("", "-", "export", "set") and not (op == "=" and text[t.start - 1] == " "))
                if text[start : start + 1] not in ("\"", "'"):
                    if DECLARES.search(text[max(line, start - 40) : start]):
                        self.scopes[-1][2].add(name)
                    self.scopes[-1][1][name.lstrip("$")] = values
                self.give(name, values)
                low = t.end

    def call(self, i: int) -> None:
        """setName("literal"), name("literal") and define("name", "literal")."""
        text, t = self.text, self.tokens[i]
        strings = []
        for x in self.tokens[i + 1 : i + 3]:
            if x.kind != "string":
                break
            strings.append(x)
        if not strings or text[t.end : strings[0].start].strip():
            return
        start = t.start
        while start > self.begin and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        name = text[start : t.start]
        words = [w.lower() for w in WORDS.findall(name)]
        behind = lambda x: text[BLANK.match(text, x.end, self.end).end() :][:1]
        if len(strings) == 1 or behind(strings[0]) == ")":
            if behind(strings[0]) == ")" and (words[:1] and words[0] in {"set", "with", "put", "add", "use"} or len(words) == 1):
                self.give(name, (self.piece(*strings[0].inner),), "call")
        elif text[strings[0].end : strings[1].start].strip() == "," and behind(strings[1]) in (")", ",") and GIVES & set(words):
            self.give(text[slice(*strings[0].inner)], (self.piece(*strings[1].inner),), "call")


def _elements(text: str, add, names: set[tuple[int, int]]) -> None:
    """<name>literal</name> and <x name="name" value="literal"/>; names gets where the latter's names are."""
    for m in TAG.finditer(text):
        found = {a[1].lower(): a for a in ATTRIBUTE.finditer(m[2])}
        value = found.get("value")
        named = found.get("name") or found.get("key")
        if value and named:
            name, group = named[2] if named[2] is not None else named[3], 2 if value[2] is not None else 3
            start, end = named.span(2 if named[2] is not None else 3)
            names.add((m.start(2) + start, m.start(2) + end))
            if s := score(name, value[group]):
                start, end = (m.start(2) + x for x in value.span(group))
                add(name, _Value(value[group], (start, end)), s, "element")
        close = f"</{m[1]}"
        stop = text.find("<", m.end())
        if stop > m.end() and text.startswith(close, stop):
            inner = text[m.end() : stop]
            start = m.end() + len(inner) - len(inner.lstrip())
            if s := score(m[1], inner.strip()):
                add(m[1], _Value(inner.strip(), (start, start + len(inner.strip()))), s, "element")


def scan(text: str | None, threshold: float = THRESHOLD) -> list[Finding]:
    """Findings in the order of the text.  Offsets are characters; a joined literal has a finding for each part."""
    if not text:
        return []
    found: dict[tuple[int, int], Finding] = {}
    names: set[tuple[int, int]] = set()

    def add(name: str, value: _Value, s: float, kind: str) -> None:
        if s < threshold:
            return
        left = [value]
        while left:  # no piece is met again for a score that it has already
            v = left.pop()
            if v.best >= s:
                continue
            v.best = s
            if v.span and v.span[0] < v.span[1] and v.span not in names and (v.span not in found or found[v.span].score < s):
                found[v.span] = Finding(*v.span, name, value.via, kind, s, value.text)
            left += v.parts

    if "</" in text or "/>" in text:
        _elements(text, add, names)
    _Scan(text, 0, len(text), add).run()
    for m in FORMATS.finditer(text):
        if found.get(m.span()) is None or found[m.span()].score < 0.95:
            found[m.span()] = Finding(m.start(), m.end(), None, None, "format", 0.95, m[0])
    return sorted(found.values(), key=lambda f: (f.start, f.end))


def redacted(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each found literal replaced by MASK; overlapping ones by one."""
    found = scan(text, threshold)
    if not found:
        return text
    out, at = [], 0
    for f in found:
        if f.start >= at:
            out += [text[at : f.start], MASK]
        at = max(at, f.end)
    return "".join(out) + text[at:]


def _candidates(text: Column) -> Column:
    """The text where it can have a finding, else null: the rest isn't sent to Python."""
    text = text.cast("string")
    found = [text.contains(x) for x in CANDIDATE_STRINGS] + [text.contains(x) & text.rlike(p) for x, p in CANDIDATE_PATTERNS]
    return F.when(reduce(or_, found), text)


def findings(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, name, via, kind, score, preview, sha256: the literals that score threshold or more.

    kind is string, bare, block, call, element, propagated (then ``via`` is the constant it came by) or format.
    The literal is given by its first three characters and its hash; a joined one is judged by its first
    MOST_JOINED characters.  Of several names for one literal the first with the highest score is given.  Texts
    that are null or empty have no finding; repeated rows have theirs each; a null doc_id stays null; very
    long texts are read whole; an empty table has an empty result; columns beside doc_id and text have no part.
    """
    names = ["doc_id", "start", "end", "name", "via", "kind", "score", "preview", "sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, f.start, f.end, f.name, f.via, f.kind, f.score, f.literal[:3] + "...", hashlib.sha256(f.literal.encode()).hexdigest())
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                for f in scan(text.as_py(), threshold)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), _candidates(docs["text"]).alias("text"))
        .where("text is not null")
        .mapInArrow(run, "doc_id long, start long, end long, name string, via string, kind string, score double, preview string, sha256 string")
    )


def without_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with its columns and all its rows; found literals are replaced by MASK, and n_chars follows a changed text.

    Texts that are null, empty or without a finding stay as they are, and so do all other columns, whatever
    their names; repeated rows are alike still; very long texts are read whole; an empty table stays empty.
    """

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            new = redacted(text, threshold)
            out.append(None if new == text else new)  # null: as it was
        return pa.array(out, pa.string())

    names = docs.columns
    rows = docs.select(row_of(docs).alias("row"), F.arrow_udf(run, "string")(_candidates(docs["text"])).alias("new"))
    own = {"text": F.coalesce("new", "row.text")}
    if "n_chars" in names:
        own["n_chars"] = F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast("long"))
    return rows.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in names))


def op4_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
