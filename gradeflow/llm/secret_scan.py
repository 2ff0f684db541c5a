"""Secret scan: base patterns, and literals that source or configuration text assigns to names that sound secret.

The lexer reads assignments (``name = value``, ``name: value``, ``name => value``, with a type between: ``name: Type = value``,
``var name Type = value``), named arguments of calls (``define('NAME', 'value')``), elements (``<name>value</name>``) and
attributes (``name="NAME" value="..."``). Values are quoted (with prefixes, in one or three quotes), bare, sums of both, or the
sole literal argument of a call that looks nothing up. Types, calls, member expressions and names that sound secret themselves
are no literals. Constants seen are kept and put in for names and ``${name}`` in later values. Each literal is scored by the
target's name and by how much it looks like a credential; those that score 0.5 or more are added, but for those wholly inside a
base value; one that a base value covers in part is kept beside it.

Time and memory are linear in the text: values are offsets, a bare value of a secret name is read once to its end and the next
target is looked for behind it, and one of another name ends where the next target starts. A value put together from others is a
node with links to them; it holds how often each character comes, not the characters, so constants that double from line to line
take no more room than others. A score goes down the links to the literals at the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("assign", "access", "hex", "lexed")
LEAST_SCORE = 0.5
MASK = "[SECRET]"
#: No placeholder of words is longer, be it put together from others or not; one of a repeated character may be.
PLACEHOLDER_LONGEST = 4096

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters

_TARGET = re.compile(r"""(?<![A-Za-z0-9_.\-])(?:[0-9][A-Za-z0-9_]*+|[.\-])*+([A-Za-z_][A-Za-z0-9_.\-]*+)["']?(?:\[[0-9]*\]|\])?[ \t]*(?:=>|:=|(?<![=!<>])=(?!=)|:(?![/:]))[ \t]*""")
_ARGUMENT = re.compile(r"""\(\s*+["']([A-Za-z_][A-Za-z0-9_.\-]*+)["']\s*+,\s*+(?=[A-Za-z@$]{0,3}["'`])""")
_ELEMENT = re.compile(r"""<([A-Za-z_][A-Za-z0-9_.\-:]*+)(?:\s[^<>]*+)?>\s*+([^<>\s]++)\s*+</\1>""")
_ATTRIBUTE = re.compile(r"""(?<![\w\-])(?:name|key|id)[ \t]*=[ \t]*["']([A-Za-z_][A-Za-z0-9_.\-]*+)["']\s++value[ \t]*=[ \t]*(?=["'])""")
_DECLARED = re.compile(r"""(?<![\w$])(?:var|const|let)[ \t]++([A-Za-z_]\w*+)[ \t]++([*\[\]A-Za-z_][\w.*\[\]]*+)[ \t]*=(?!=)[ \t]*""")
_TYPE = re.compile(
    r"""(&(?:'[a-z_]++[ \t]++)?(?:mut[ \t]++)?)?([A-Za-z_]\w*+(?:(?:\.|::)\w++)*+)"""
    r"""(?:<[^<>=\n]*+(?:<[^<>=\n]*+>[^<>=\n]*+)*+>|\[[^\[\]=\n]*+(?:\[[^\[\]=\n]*+\][^\[\]=\n]*+)*+\])?[?!]?(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+([ \t]*+)=(?![=>])[ \t]*+"""
)
_OPEN = re.compile(r"""(?:r\#{1,3}(?=")|[bBrRuUfFLN@$]{1,3}(?=["'`]))?("{3}|'{3}|["'`])""")
_BODY = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+'), "'": re.compile(r"(?:[^'\\\n]|\\.)*+"), "`": re.compile(r"[^`\n]*+")}
_BARE = re.compile(r"""[^\s,;"'`|&<>(){}\[\]]++""")
_JOIN = re.compile(r"""\s*+\+\s*+(?=["'`A-Za-z_$])|\s*+\.{1,2}\s*+(?=["'`$])|\s*+\.\.\s*+(?=[A-Za-z_])|[ \t]++&[ \t]++(?=["'`A-Za-z_$])""")
_PAREN = re.compile(r"\(\s*+(?=[A-Za-z@$]{0,3}[\"'`])")
_SOLE = re.compile(r"\s*+\)")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|digest)[ \t]++(?=\S)")
_REFERENCE = re.compile(r"[A-Za-z_$]++[0-9]{0,2}(?:(?:\??\.|::)[A-Za-z_$]++[0-9]{0,2})*+")
_INSERT = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|%\(([A-Za-z_][A-Za-z0-9_.]*)\)s")
_SPACE = re.compile(r"\s")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|todo|changeme|change_me|(?:example|sample|dummy|your|my|insert)(?:[-_ ]?(?:your|my|the|a|here|api|access|secret|private|auth|key|token|pass|password|passwd|credentials?|value|string))*|test|<[^<>]*>|redacted|\[secret\])$")

#: Names of types, in lower case.
TYPES = frozenset("any bool boolean byte bytes char charsequence cstr double float int integer long never null number object securestring secretstr short str string text unknown varchar void wstring".split())
#: Words in the name of a call that looks a value up, so its argument is a name and no value.
LOOKUPS = frozenset("ask config env environ fetch find get getenv getpass getproperty input key load lookup open path prompt property read require resolve setting settings vault".split())

#: What a part of a name says about its literal.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8,
    "auth": 0.6, "authorization": 0.8, "private": 0.5, "key": 0.5, "access": 0.3, "api": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.5, "signature": 0.5, "session": 0.3, "cookie": 0.5,
    "public": -0.6, "id": -0.4, "name": -0.5, "url": -0.5, "uri": -0.5, "path": -0.5, "file": -0.5, "length": -0.8, "count": -0.8, "size": -0.8, "type": -0.6, "expiry": -0.6, "expires": -0.6, "hint": -0.4, "field": -0.4, "word": -0.5,
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    name: str
    score: float


def name_score(name: str) -> float:
    """How likely a target of this name holds a secret, 0 to 1."""
    return max(0.0, min(1.0, sum(NAME_WEIGHTS.get(p.lower(), 0.0) for p in _PARTS.findall(name))))


def literal_score(value: str) -> float:
    """How much a literal looks like a credential, 0 to 1."""
    if _SPACE.search(value) or (len(value) <= PLACEHOLDER_LONGEST and _PLACEHOLDER.match(value)):
        return 0.0
    return _by_counts(Counter(value))


def _by_counts(counts: dict[str, float]) -> float:
    """The score of a value that is no placeholder of words, by how often each character comes."""
    if any(c.isspace() for c in counts) or len(counts) == 1 and next(iter(counts)) in "xX*." or counts.keys() == {"x", "X"}:
        return 0.0
    return _mixed(counts)


def _mixed(counts: dict[str, float]) -> float:
    """The score of a value by its length and the entropy of its characters."""
    n = sum(counts.values())
    if n < 6:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c)
    return 0.5 * min(1.0, n / 12) + 0.5 * min(1.0, entropy / 3.0)


class Value:
    """A literal at its place, or what others give together; best is the highest score of a target that holds it."""

    __slots__ = ("span", "parts", "best", "name", "_source", "_counts", "_score", "_joined")

    def __init__(self, source: str, span: tuple[int, int] | None, parts: list[Value] | None = None):
        self._source, self.span, self.parts, self.best, self.name = source, span, parts, 0.0, ""
        self._counts: dict[str, float] | None = None
        self._score: float | None = None
        self._joined: str | None = None
        if parts is not None:
            self._counts = {}
            for part in parts:
                # short literals are counted again rather than kept counted
                for c, n in (part.counts if part.parts is not None or part.span[1] - part.span[0] > 64 else Counter(part.text)).items():
                    self._counts[c] = self._counts.get(c, 0) + n
            total = sum(self._counts.values())
            # a value that doubles line by line soon outgrows any number; its shares stay
            if total > 1e15:
                self._counts = {c: n * 1e-9 for c, n in self._counts.items()}
            if total <= PLACEHOLDER_LONGEST:
                self._joined = "".join(p.text or "" for p in parts)

    @property
    def text(self) -> str | None:
        """The characters; None if put together to more than a placeholder may have."""
        return self._joined if self.parts is not None else self._source[self.span[0] : self.span[1]]

    @property
    def counts(self) -> dict[str, float]:
        if self._counts is None:
            self._counts = dict(Counter(self.text))
        return self._counts

    def score(self) -> float:
        if self._score is None:
            self._score = _by_counts(self.counts) if (text := self.text) is None else literal_score(text)
        return self._score


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping in each kind, by start and then by kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [Span("assign", m.start(), m.end(), m.start(2), m.end(2), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), m.start(), m.end(), "", 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span("hex", m.start(), m.end(), m.start(), m.end(), "", 1.0) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


class Lexer:
    """Reads the name-value pairs of a text; ``expressions`` are the places of types, calls and member expressions met."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, Value] = {}
        self.expressions: list[tuple[int, int]] = []
        self._run = (0, 0)
        self._no_triple: dict[str, int] = {}

    def pairs(self) -> Iterator[tuple[str, Value]]:
        """(name, value) of each target whose value is known, constants put in for names."""
        others = self._others()
        i = at = 0
        target: re.Match | None = None
        searched = False
        bare: Value | None = None
        while True:
            if not searched or target and target.start(1) < at:
                target, searched = _TARGET.search(self.text, at), True
            while i < len(others) and others[i][0] < at:
                i += 1
            if i < len(others) and (not target or others[i][0] <= target.start(1)):
                start, name, begin, end = others[i]
                i += 1
            elif target:
                start, name, begin, end = target.start(1), target[1], target.end(), None
                if self.text[target.end(1) : begin].rstrip().endswith(":"):
                    begin = self._behind_type(begin)
            else:
                return
            # a bare value that isn't a secret's ends at the target within it
            if bare and start < bare.span[1]:
                bare.span = (bare.span[0], start)
            bare = None
            secret = name_score(name) >= LEAST_SCORE
            if end is not None:
                value, whole, behind = Value(self.text, (begin, end)), True, end
            else:
                value, whole, behind = self._value(begin, secret)
            if value is not None:
                if whole:
                    self.known[name] = value
                if value.parts is None and not secret:
                    bare = value
                if whole or secret and value.parts:
                    yield name, value
            at = max(begin, behind if secret else begin, start + 1)

    def _others(self) -> list[tuple[int, str, int, int | None]]:
        """(start, name, start of the value, its end if it's known) of targets without an operator of their own."""
        text = self.text
        out: list[tuple[int, str, int, int | None]] = []
        if "(" in text:
            out += [(m.start(1), m[1], m.end(), None) for m in _ARGUMENT.finditer(text)]
        if "</" in text:
            out += [(m.start(1), m[1].rpartition(":")[2], *m.span(2)) for m in _ELEMENT.finditer(text)]
        if "value" in text:
            out += [(m.start(), m[1], m.end(), None) for m in _ATTRIBUTE.finditer(text)]
        if "=" in text and ("var" in text or "const" in text or "let" in text):
            out += [(m.start(1), m[1], m.end(), None) for m in _DECLARED.finditer(text) if m[2].strip("*[]").lower() in TYPES and m[1].lower() not in TYPES]
        return sorted(out, key=lambda x: x[0])

    def _behind_type(self, at: int) -> int:
        """Where the value starts if a type and an equals sign stand before it."""
        m = _TYPE.match(self.text, at)
        if m and (m[1] or m[3] or m[2].lower() in TYPES or _OPEN.match(self.text, m.end())):
            self.expressions.append((m.start(), m.start(3)))
            return m.end()
        return at

    def _literal(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of the quoted literal that opens here, and where it is over."""
        if not (m := _OPEN.match(self.text, at)):
            return None
        quote, begin = m[1], m.end()
        if len(quote) == 3:
            end = -1 if self._no_triple.get(quote, len(self.text) + 1) <= begin else self.text.find(quote, begin)
            if end >= 0:
                return begin, end, end + 3
            self._no_triple[quote] = min(begin, self._no_triple.get(quote, begin))
            return begin - 2, begin - 2, begin - 1
        end = _BODY[quote].match(self.text, begin).end()
        return (begin, end, end + 1) if self.text[end : end + 1] == quote else None

    def _bare(self, at: int) -> int:
        """The end of the bare run that goes on here; a run is read once."""
        if not self._run[0] <= at < self._run[1]:
            m = _BARE.match(self.text, at)
            self._run = (at, m.end() if m else at)
        return self._run[1]

    def _value(self, at: int, secret: bool) -> tuple[Value | None, bool, int]:
        """The value that starts here, whether all of it is known, and where it is over."""
        text = self.text
        if m := _PAREN.match(text, at):
            at = m.end()
        if m := _SCHEME.match(text, at):
            at = m.end()
        parts: list[Value] = []
        whole, quoted = True, False
        while True:
            if literal := self._literal(at):
                value, known = self._quoted(literal[0], literal[1])
                parts.append(value)
                whole, quoted, at = whole and known, True, literal[2]
            else:
                end = self._bare(at)
                if end == at:
                    break
                value, behind = self._named(at, end, bool(parts))
                if value:
                    parts.append(value)
                elif not parts and not secret:
                    return None, False, behind
                else:
                    whole = False
                at = behind
            if not (more := _JOIN.match(text, at)):
                break
            at = more.end()
        if not parts or not whole and not quoted:
            return None, False, at
        if len(parts) == 1:
            # what is known of a sum with names that aren't is still a literal
            return (parts[0] if whole else Value(text, None, parts)), whole, at
        return Value(text, None, parts), whole, at

    def _named(self, at: int, end: int, in_sum: bool) -> tuple[Value | None, int]:
        """What a bare term stands for, None if that isn't known, and where it is over."""
        text = self.text
        after = text[end : end + 1]
        # constants and expressions are short beside a run of many targets, which stays offsets
        if end - at <= PLACEHOLDER_LONGEST:
            term = text[at:end]
            if own := self.known.get(term.lstrip("$")):
                return own, end
            if term.lower() in TYPES and after != "(":
                self.expressions.append((at, end))
                return None, end
            if _REFERENCE.fullmatch(term):
                if after in ("(", "["):
                    self.expressions.append((at, end))
                    return self._argument(term, end)
                if "." in term or "::" in term:
                    self.expressions.append((at, end))
                    return None, end
                if in_sum or _JOIN.match(text, end) or len(_PARTS.findall(term)) > 1 and name_score(term) >= LEAST_SCORE:
                    return None, end
        return Value(text, (at, end)), end

    def _argument(self, callee: str, at: int) -> tuple[Value | None, int]:
        """The sole literal argument of a call that looks nothing up."""
        if self.text[at] == "(" and not LOOKUPS & {p.lower() for p in _PARTS.findall(callee)} and (m := _PAREN.match(self.text, at)):
            if (literal := self._literal(m.end())) and (over := _SOLE.match(self.text, literal[2])):
                value, known = self._quoted(literal[0], literal[1])
                if known:
                    return value, over.end()
        return None, at

    def _quoted(self, begin: int, end: int) -> tuple[Value, bool]:
        """A quoted literal with the constants that it names put in, and whether all of them are known."""
        text = self.text
        if m := _SCHEME.match(text, begin, end):
            begin = m.end()
        parts: list[Value] = []
        at, whole = begin, True
        for x in _INSERT.finditer(text, begin, end):
            if x.start() > at:
                parts.append(Value(text, (at, x.start())))
            at = x.end()
            if own := self.known.get(x[1] or x[2]):
                parts.append(own)
            else:
                whole = False
        if at == begin:
            return Value(text, (begin, end)), True
        if at < end:
            parts.append(Value(text, (at, end)))
        return Value(text, (begin, end), parts), whole


def _lexed(text: str, base: list[Span]) -> tuple[list[Span], list[tuple[int, int]]]:
    """Literals of secret-sounding names, but for those inside a base value; and the places of types and expressions."""
    if not ("=" in text or ":" in text or "</" in text or "(" in text):
        return [], []
    lexer = Lexer(text)
    held: list[Value] = []
    last = (0, 0)
    for name, value in lexer.pairs():
        if (by_name := name_score(name)) < LEAST_SCORE:
            continue
        single = value.span if value.span and value.parts is None else None
        # the rest of a run that is a finding already, as in token=token=..., adds nothing
        if single and last[0] < single[0] and single[1] == last[1]:
            continue
        if (score := by_name * value.score()) >= LEAST_SCORE:
            last = single or last
            if not value.best:
                held.append(value)
            if score > value.best:
                value.best, value.name = score, name
    # the highest score first, so each value gets its own once
    best: dict[tuple[int, int], Value] = {}
    for value in sorted(held, key=lambda v: -v.best):
        stack = [value]
        while stack:
            v = stack.pop()
            if v.span and v.span[0] < v.span[1] and (v.span not in best or best[v.span].best < v.best):
                best[v.span] = v
            for part in v.parts or ():
                if part.best < v.best:
                    part.best, part.name = v.best, v.name
                    stack.append(part)
    out: list[Span] = []
    values = [(s.value_start, s.value_end) for s in base]
    values.sort()
    at = reach = 0
    for (a, b), v in sorted(best.items(), key=lambda x: (x[0][0], -x[0][1])):
        while at < len(values) and values[at][0] <= a:
            reach = max(reach, values[at][1])
            at += 1
        if reach < b and (not out or a >= out[-1].end):
            out.append(Span("lexed", a, b, a, b, v.name, v.best))
    return out, sorted(lexer.expressions)


def spans_of(text: str) -> list[Span]:
    base = base_spans(text)
    return sorted([*base, *_lexed(text, base)[0]], key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str) -> str:
    """The text with the value of each span replaced by MASK; overlapping values are masked as one.

    What a base pattern takes for a value stays if it is a type, a call or a member expression, as in ``secret: string``.
    """
    base = base_spans(text)
    lexed, expressions = _lexed(text, base)
    values = []
    i = 0
    for a, b in sorted((s.value_start, s.value_end) for s in [*base, *lexed]):
        while i < len(expressions) and expressions[i][1] < b:
            i += 1
        if i == len(expressions) or a < expressions[i][0]:
            values.append((a, b))
    out, at = [], 0
    for a, b in values:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]]) if out else text


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[s._asdict() for s in spans_of(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row; spans are structs of kind, start, end, value_start, value_end, name and score.

    Offsets count code points, ends are exclusive; order is by start, then by kind as in KINDS. A null or empty text has an
    empty list. Rows are handled each for itself, so repeated ids and rows give repeated results. Other columns are ignored.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        _scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,name:string,score:double>>"
    )


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets in its texts masked; null texts stay, and n_chars follows the text where there is such a column."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[where] = pa.array([None if t is None else masked(t) for t in (x.as_py() for x in columns[where])], columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
