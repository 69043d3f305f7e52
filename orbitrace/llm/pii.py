"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. A second view of a text undoes disguises by a cascade of compiled
deterministic transducers: the first folds homoglyphs and invisible characters, a lexer reads tokens, and the others
rewrite bracketed signs, a spelled plus, spelled "at" and "dot" signs of addresses, spelled dots between numbers, spelled
digits, and gaps after a plus. Every token that they emit keeps the source span it came from. Identifiers found in that
view are mapped back to source characters, and are added where they touch no plain span of their kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orbitrace.llm.batches import bound_batches

KINDS = ("email", "ip", "card", "phone")
# The patterns of the plain identifiers, anchored so that a scan is linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses. Each sign is looked at once, with the run of local characters before it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            # nothing between here and the sign can begin a later match, as no match crosses a sign
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[Span]:
    if text.count(".") < 3:
        return []
    return [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain_spans(text: str) -> dict[str, list[Span]]:
    return {kind: FINDERS[kind](text) for kind in KINDS}


# Look-alikes of ASCII characters that compatibility folding leaves alone.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "ɡ": "g", "ɩ": "i", "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "‐": "-", "‑": "-",
    "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}
#: Characters without width, dropped between the characters of an identifier.
INVISIBLE = frozenset("­​‌‍⁠﻿")
#: Spelled digits and signs.
SPELLED_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
#: After a spelled "at", the endings that a host may have; other words after a dot are prose or file names.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev co me tv eu uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg hr si rs ua ru tr "
    "se no dk fi is ee lv lt jp cn kr tw hk sg my th vn id ph in pk ae sa il za ng ke eg ma mx br ar cl pe uy ve example test invalid local".split()
)
@lru_cache(maxsize=1)
def look_alikes() -> dict[int, str]:
    """Code point -> one ASCII character, for the listed look-alikes and all whose compatibility form is one."""
    out = {ord(k): v for k, v in HOMOGLYPHS.items()}
    for cp in range(0x80, 0x20000):
        folded = unicodedata.normalize("NFKC", chr(cp))
        if cp not in out and len(folded) == 1 and "!" <= folded <= "~":
            out[cp] = folded
        elif cp not in out and unicodedata.category(chr(cp)) == "Nd":
            out[cp] = str(unicodedata.digit(chr(cp)))
    return out


def fold_characters(text: str) -> tuple[str, list[int] | None]:
    """The one-state transducer: look-alikes to ASCII, invisible characters away; and, where any went, the place of each
    character that is left."""
    if text.isascii():
        return text, None
    table = look_alikes()
    found = {ord(c): "" if c in INVISIBLE else table[ord(c)] for c in set(text) if c in INVISIBLE or ord(c) in table}
    if not found:
        return text, None
    gone = any(new == "" for new in found.values())
    return text.translate(found), [i for i, c in enumerate(text) if c not in INVISIBLE] if gone else None


# Token classes: a, d, p are the words at, dot and plus; z a spelled digit; w another run of letters; n, N a number of up
# to three digits or more, m, M one that touches a letter; 1, 2, 3, 8, 9 blanks (one, two, three, up to eight, more);
# o, c brackets; the signs - . @ + , _ % themselves; x any other run, which no transducer crosses.
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\x20+|[-.@+,_%\[({<\])}>]")
_STRETCH = re.compile(r"[A-Za-z0-9\x20.@+,_%\[({<\])}>-]+")
_WORDS = {"at": "a", "dot": "d", "plus": "p"} | dict.fromkeys(SPELLED_DIGITS, "z")
_BRACKETS = dict.fromkeys("[({<", "o") | dict.fromkeys("])}>", "c")
_DIGIT_WORD = "|".join(sorted(SPELLED_DIGITS, key=len, reverse=True))
#: A lower-cased text in which a transducer rewrites anything holds one of these, or a spelled digit before another or a number.
_HINTS = (" at ", " dot ", "plus", "+", "[", "(", "{", "<")
_DIGITS_HINT = re.compile(rf"(?:{_DIGIT_WORD})[\x20,-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])")
_NUMBERS, _LABEL, _BLANKS = "nNmM", "wadpznNmM-", "12389"
_LOCAL_PART = _LABEL + "._%+"
#: Words that spelled dots may join in front of an address's sign.
JOINED_WORDS = 8
#: Spelled digits that make a run of digits a number; after a plus one is enough, as a lone "one" is prose.
LEAST_SPELLED = 4


def classes(tokens: list[str]) -> list[str]:
    """The class of each token of a stretch."""
    out = []
    for i, t in enumerate(tokens):
        first = t[0]
        if first == " ":
            out.append(str(len(t)) if len(t) <= 3 else "8" if len(t) <= 8 else "9")
        elif "0" <= first <= "9":
            short = len(t) <= 3
            touches = i > 0 and tokens[i - 1][0].isalpha() or i + 1 < len(tokens) and tokens[i + 1][0].isalpha()
            out.append(("m" if short else "M") if touches else ("n" if short else "N"))
        elif first.isalpha():
            out.append(_WORDS.get(t.lower(), "w") if len(t) <= 5 else "w")
        else:
            out.append(_BRACKETS.get(first, first))
    return out


#: What an arc emits: the token as it is, or the digit it spells; else the text given (none drops the token).
COPY, DIGIT = None, "digit"
Arcs = Iterable[tuple[str, str, str, str | None]]


@dataclass
class Tape:
    """Tokens of a stretch in parallel lists: class, text, and the span of the folded text that a token stands for."""

    kind: list[str]
    text: list[str]
    start: list[int]
    end: list[int]


@dataclass
class Transducer:
    """A deterministic transducer over token classes, compiled to one table of arcs per state.

    It starts in state 0 at every token that follows none of ``not_after``, and takes the longest accepted path. What the
    arcs of the path emit is written if ``holds(tape, first, end, path)`` is true, with the states of the path; reading goes on behind it.
    """

    arcs: Arcs
    accepting: set[str]
    needs: str
    not_after: str = ""
    holds: Callable[[Tape, int, int, list[int]], bool] | None = None
    #: What is emitted stands for the whole path, not for the token that it replaces.
    whole: bool = False
    table: list[dict[str, tuple[int, str | None]]] = field(init=False)
    names: list[str] = field(init=False)

    def __post_init__(self):
        arcs = list(self.arcs)
        self.names = list(dict.fromkeys(["0", *(a[0] for a in arcs), *(a[2] for a in arcs)]))
        number = {name: k for k, name in enumerate(self.names)}
        self.table = [{} for _ in self.names]
        for state, read, then, emit in arcs:
            for c in read:
                if c in self.table[number[state]]:
                    raise ValueError(f"two arcs on {c} leave state {state}")
                self.table[number[state]][c] = (number[then], emit)
        self.final = [name in self.accepting for name in self.names]

    def run(self, tape: Tape) -> bool:
        """Rewrites ``tape`` in one pass; whether anything changed."""
        kind = tape.kind
        if not any(c in kind for c in self.needs):
            return False
        table, final, begin, n = self.table, self.final, self.table[0], len(kind)
        emitted: dict[int, str] = {}
        i = 0
        while i < n:
            if kind[i] not in begin or i and kind[i - 1] in self.not_after:
                i += 1
                continue
            state, j, end, path = 0, i, i, []
            while j < n and (arc := table[state].get(kind[j])) is not None:
                state = arc[0]
                path.append(arc)
                j += 1
                if final[state]:
                    end = j
            if end == i:
                i += 1
                continue
            if self.holds is None or self.holds(tape, i, end, [to for to, _ in path]):
                for k in range(i, end):
                    emit = path[k - i][1]
                    if emit is not COPY:
                        emitted[k] = SPELLED_DIGITS[tape.text[k].lower()] if emit is DIGIT else emit
                        if self.whole and emit:
                            tape.start[k], tape.end[k] = tape.start[i], tape.end[end - 1]
            i = end
        if not emitted:
            return False
        for k, new in emitted.items():
            tape.text[k] = new
            tape.kind[k] = "n" if "0" <= new <= "9" else new
        left = [k for k in range(n) if tape.text[k]]
        for column in (tape.kind, tape.text, tape.start, tape.end):
            column[:] = [column[k] for k in left]
        return True


def _bracketed() -> Arcs:
    """An "at" or "dot", word or sign, in brackets; the blanks around go with it."""
    yield from [("0", _BLANKS, "before", ""), ("0", "o", "open", ""), ("before", "o", "open", ""), ("open", "123", "gap", "")]
    for state in ("open", "gap"):
        yield from [(state, "a@", "sign", "@"), (state, "d.", "sign", ".")]
    yield from [("sign", "123", "behind", ""), ("sign", "c", "closed", ""), ("behind", "c", "closed", ""), ("closed", _BLANKS, "after", "")]


def _plus_word() -> Arcs:
    """The word plus, up to three blanks or hyphens, and a number or a spelled digit."""
    yield ("0", "p", "gap 3", "+")
    for left in range(3, -1, -1):
        for c, size in (("1", 1), ("2", 2), ("3", 3), ("-", 1)):
            if size <= left:
                yield (f"gap {left}", c, f"gap {left - size}", COPY)
        if left < 3:
            yield (f"gap {left}", _NUMBERS + "z", "number", COPY)


def _address() -> Arcs:
    """An address whose sign, or some of whose dots, are words."""
    yield ("0", _LOCAL_PART, "local 0", COPY)
    for k in range(JOINED_WORDS + 1):
        yield from [(f"local {k}", _LOCAL_PART, f"local {k}", COPY), (f"local {k}", "@", "host", COPY), (f"local {k}", _BLANKS, f"gap {k}", "")]
        yield (f"gap {k}", "a", "at", "@")
        if k < JOINED_WORDS:
            yield from [(f"gap {k}", "d", f"dot {k}", "."), (f"dot {k}", _BLANKS, f"word {k}", "")]
            yield (f"word {k}", _LOCAL_PART.replace(".", ""), f"local {k + 1}", COPY)
    yield from [("at", _BLANKS, "spelled host", ""), ("host", _LABEL, "first", COPY), ("spelled host", _LABEL, "first", COPY)]
    for state in ("first", "label"):
        yield from [(state, _LABEL, state, COPY), (state, ".", "next", COPY), (state, _BLANKS, "host gap", "")]
    yield from [("host gap", "d", "host dot", "."), ("host dot", _BLANKS, "next", ""), ("next", _LABEL, "label", COPY)]


def _four_numbers() -> Arcs:
    """Four short numbers with dots between, spelled or not."""
    short = "nm"
    yield ("0", short, "number 1", COPY)
    for k in range(1, 4):
        yield from [(f"number {k}", ".", f"then {k}", COPY), (f"number {k}", "1238", f"gap {k}", ""), (f"gap {k}", "d", f"dot {k}", ".")]
        yield from [(f"dot {k}", "1238", f"then {k}", ""), (f"then {k}", short, f"number {k + 1}", COPY)]


def _digit_run() -> Arcs:
    """Spelled digits and numbers with up to two blanks, commas or hyphens between."""
    for state in ("0", "one", "two"):
        yield from [(state, "z", "item", DIGIT), (state, "nN", "item", COPY)]
    yield from [("item", "1,-", "one", ""), ("item", "2", "two", ""), ("one", "1,-", "two", "")]


def _plus_gap() -> Arcs:
    """A plus, blanks and hyphens, and a number."""
    yield from [("0", "+", "plus", COPY), ("plus", _BLANKS + "-", "gap", ""), ("gap", _BLANKS + "-", "gap", ""), ("gap", _NUMBERS, "number", COPY)]


def _known_ending(tape: Tape, first: int, end: int, path: list[int]) -> bool:
    """Whether the sign is a plain one, or the host's last label is an ending that hosts have."""
    if SPELLED_HOST not in path[: end - first]:
        return True
    k = end
    while k > first and tape.kind[k - 1] in _LABEL:
        k -= 1
    return "".join(tape.text[k:end]).lower() in ENDINGS


def _is_number(tape: Tape, first: int, end: int, path: list[int]) -> bool:
    spelled = tape.kind[first:end].count("z")
    return spelled >= LEAST_SPELLED or spelled > 0 and after_plus(tape, first)


def after_plus(tape: Tape, at: int) -> bool:
    """Whether a plus sign stands before token ``at``, with up to three blanks or hyphens between."""
    left = 3
    while at > 0 and tape.kind[at - 1] in "123-" and len(tape.text[at - 1]) <= left:
        at -= 1
        left -= len(tape.text[at])
    return at > 0 and tape.kind[at - 1] == "+"


ADDRESS = Transducer(_address(), {"label"}, needs="ad", not_after=_LOCAL_PART, holds=_known_ending)
SPELLED_HOST = ADDRESS.names.index("spelled host")
#: In the order in which they run.
CASCADE = (
    Transducer(_bracketed(), {"closed", "after"}, needs="o", whole=True),
    Transducer(_plus_word(), {"number"}, needs="p", not_after=_NUMBERS + "_"),
    ADDRESS,
    Transducer(_four_numbers(), {"number 4"}, needs="d", not_after="."),
    Transducer(_digit_run(), {"item"}, needs="z", holds=_is_number),
    Transducer(_plus_gap(), {"number"}, needs="+"),
)


def hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS) or _DIGITS_HINT.search(low) is not None


def normalised(text: str) -> Tape | None:
    """The pieces of a folded text after the cascade, or None where it changes nothing. What lies between rewritten
    stretches is one piece."""
    out = Tape([], [], [], [])
    if not hinted(text):
        return None
    at = 0
    for m in _STRETCH.finditer(text):
        a, b = m.span()
        if not hinted(m.group()):
            continue
        tokens = [(t.group(), *t.span()) for t in _TOKEN.finditer(text, a, b)]
        tape = Tape([], *(list(column) for column in zip(*tokens, strict=True)))
        tape.kind = classes(tape.text)
        # no shortcut: each one reads what the one before wrote
        if any([machine.run(tape) for machine in CASCADE]):
            if a > at:
                tape = Tape(["x", *tape.kind], [text[at:a], *tape.text], [at, *tape.start], [a, *tape.end])
            for column, more in zip((out.kind, out.text, out.start, out.end), (tape.kind, tape.text, tape.start, tape.end), strict=True):
                column += more
            at = b
    if not at:
        return None
    if at < len(text):
        for column, last in zip((out.kind, out.text, out.start, out.end), ("x", text[at:], at, len(text)), strict=True):
            column.append(last)
    return out


def disguised_spans(text: str) -> dict[str, list[Span]]:
    """Source spans of identifiers that only the rewritten text shows."""
    folded, places = fold_characters(text)
    tape = normalised(folded)
    if tape is None:
        if folded == text:
            return {}
        tape = Tape(["x"], [folded], [0], [len(folded)])
    ends, total = [], 0
    for t in tape.text:
        total += len(t)
        ends.append(total)

    def source(position: int) -> Span:
        """The span of the source that a character of the rewritten text stands for."""
        k = bisect_right(ends, position)
        a, b = tape.start[k], tape.end[k]
        if b - a == len(tape.text[k]):
            a += position - (ends[k] - len(tape.text[k]))
            b = a + 1
        return (a, b) if places is None else (places[a], places[b - 1] + 1)

    return {kind: [(source(a)[0], source(b - 1)[1]) for a, b in spans] for kind, spans in plain_spans("".join(tape.text)).items()}


def find_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and all spans, by kind and in order of start; an added span overlaps none of its kind or holds a plain one and more."""
    plain = plain_spans(text)
    every = {kind: list(spans) for kind, spans in plain.items()}
    for kind, spans in disguised_spans(text).items():
        every[kind] = merge_spans(plain[kind], spans)
    return plain, every


def merge_spans(plain: list[Span], found: list[Span]) -> list[Span]:
    """``plain`` and those of ``found`` that overlap none of the spans before, or hold a plain one and more. Both come in order,
    and one pass over them is enough."""
    added: list[Span] = []
    i, reach = 0, -1
    for a, b in found:
        while i < len(plain) and plain[i][1] <= a:
            i += 1
        k, fits = i, a >= reach
        while fits and k < len(plain) and plain[k][0] < b:
            x, y = plain[k]
            fits = a <= x and y <= b and (a, b) != (x, y)
            k += 1
        if fits:
            added.append((a, b))
            reach = b
    return sorted([*plain, *added])


def listing(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added`` and ``all_<kind>`` for every row.

    The ``n_<kind>`` counts and the digest are of the plain spans; ``spans`` lists all, ``all_<kind>`` and ``n_spans``
    count all, and ``n_added`` counts what the rewriting added. Null text counts as empty. Rows that repeat give rows that repeat, extra columns are ignored, an empty table
    gives an empty result. Offsets are code points, ends exclusive.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            plain, total, digest, listed, added = {k: [] for k in KINDS}, {k: [] for k in KINDS}, [], [], []
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                base, every = find_spans(text)
                for k in KINDS:
                    plain[k].append(len(base[k]))
                    total[k].append(len(every[k]))
                digest.append(hashlib.sha256(listing(base).encode()).hexdigest())
                listed.append(listing(every))
                added.append(sum(map(len, every.values())) - sum(map(len, base.values())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(plain[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(listed, pa.string()),
                    pa.array([sum(n) for n in zip(*total.values(), strict=True)], pa.int64()), pa.array(added, pa.int64()), *(pa.array(total[k], pa.int64()) for k in KINDS),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added", *(f"all_{k}" for k in KINDS)],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long, "
        + ", ".join(f"all_{k} long" for k in KINDS),
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind and ``n_chars`` brought up to date where it exists.

    Null text stays null, empty text empty. Rows that repeat give rows that repeat; an empty table gives an empty result.
    All columns are kept in order, whatever their names.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redact(t, find_spans(t)[1]) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                old, field = batch.column("n_chars").to_pylist(), batch.schema.field("n_chars")
                new["n_chars"] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], field.type)
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema)
