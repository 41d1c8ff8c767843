"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field reads the shapes of a line's tokens (runs of letters and digits, with their neighbours' shapes),
is trained by gradient ascent from the small labelled table below, and decodes all lines of a batch at
once by Viterbi in numpy. A field span that overlaps a pattern's span, or hasn't the digits or signs of its
kind, is left out; pattern spans all stay.

All work on a text is linear in its length: patterns look at each character a bounded number of times, so
long runs of digits, letters or signs cost no more than prose.

Defined results: null, empty and blank texts have no spans; texts of any length are read whole. A null id
stays null, repeated rows and ids each give a row, and an empty table gives an empty result. Offsets are code
points. Columns other than doc_id and text are not read by personal_data() and pass through redacted().
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, per_batch, texts, tune

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "B-card", "I-card", "B-phone", "I-phone")
#: Fixed patterns, stated so that no position starts a second search through the same run: an e-mail is found from
#: its @, an ip within a whole chain of numbers and dots.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Tokens that a worker remembers the class of; at the bound it starts anew.
REMEMBERED = 300_000

#: Labelled lines: spans stand in braces with their kind. All values are invented.
LABELLED = """
call {phone (212) 555-0147} before noon
her number is {phone 415-555-0132} or so
reach the office at {phone (030) 555-0199} today
fax {phone 020 5550 1234} and mail us
tel {phone 555-0171} for help
ring {phone (617) 555-0123} then wait
you may dial {phone 1-800-555-0104} at night
phone: {phone 303.555.0188} ext
the desk {phone (808) 555-0110} is open
write to {email kim.lee@mail.example.com} soon
mail {email sales@example.org} for a price
send it to {email a.b+c@sub.example.net} please
contact {email info@example.de} or call {phone +44 20 5550 0142}
his address {email jo_99@host.example.com} bounced
from {ip 10.1.2.3} to the server
the host {ip 192.168.100.20} was down
blocked {ip 172.16.0.9} twice
pay with {card 4000 0000 0000 0002} now
card {card 5100-0000-0000-0008} was used
the card {card 4111.1111.1111.1111} expired
call {phone +1 (212) 555-0147} again
at {phone +49 30 5550123} every day
the year 1998 was dry
in 2004 and 2011 it rained
chapter 12 has 340 pages
version 2.1.3 came out
add 3.5 and 12.75 to it
the order 100200300400 was late
on 2019-04-12 at 10:30 they met
see page 12-14 and 20-25
from 9 to 5 on days 1, 2 and 3
it cost $1,200.50 or 1.200,50
the ratio 3:4 of (12) items
a list of 10 20 30 40 numbers
room 101 (floor 3) is free
token = "9f3ab2c4d5e6f7081920" in the file
id=5f2b9c77e1 and key 00ffab12
section 3.2.1.1.9 of the text
license version 2.0. applies
it was 50% of 1/2 in 1990-1995
serial 7536784127813051 and 9807915762804491 are kept
call the office at noon or write to them
the phone is on the desk by the card
see (appendix) for the mail and the host
a plain line of words without any of it
One more line. It has stops, and commas; no data!
| cell | other | third |
one*** two### three$$$ four%%%
WHO SAYS!! THAT!! NOW!!
""".strip().split("\n")
_BRACED = re.compile(r"\{(\w+) ([^}]*)\}")


def labelled(lines: list[str]) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels of lines with braced spans."""
    out = []
    for line in lines:
        tokens, labels, at = [], [], 0
        for m in [*_BRACED.finditer(line), None]:
            plain = line[at : m.start() if m else len(line)].split()
            tokens += plain
            labels += [0] * len(plain)
            if m:
                inner = m[2].split()
                tokens += inner
                labels += [LABELS.index(m[1] if m[1] in LABELS else ("I-" if k else "B-") + m[1]) for k in range(len(inner))]
                at = m.end()
        out.append((tokens, labels))
    return out


_ALPHA, _NUM = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def features(token: str) -> tuple[str, ...]:
    """Of a token's shape: letter runs as x or X, digit runs as 9 with their length, other characters as they are."""
    bare = token.rstrip(".,;:!?\"'*#$%&|") or token
    shape = _ALPHA.sub(lambda m: "X" if m[0].isupper() else "x", bare)
    if len(shape) == 1 and shape in "xX":
        return ("word",)
    digits = sum(map(len, _NUM.findall(bare)))
    runs = _NUM.sub(lambda m: "9" * min(len(m[0]), 5), shape)[:24]
    kinds = "".join(sorted(set(_NUM.sub("9", shape))))[:8]
    return ("shape " + runs, "kinds " + kinds, f"digits {min(digits, 20)}", "first " + shape[0], *(["at"] if "@" in bare and "." in bare else ()), f"dots {min(bare.count('.'), 4)}" if digits else "no digits")


class Field:
    """A linear-chain conditional random field over token classes."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.3, decay: float = 0.002):
        names: dict[str, int] = {}
        coded = []
        for tokens, labels in rows:
            own = [[f for f in features(t)] for t in tokens]
            cells = [[names.setdefault(f"{at}{f}", len(names)) for at, k in (("=", i), ("<", i - 1), (">", i + 1)) if 0 <= k < len(own) for f in own[k]] for i in range(len(own))]
            if cells:
                coded.append((cells, np.array(labels)))
        n = len(LABELS)
        weights, steps, start, grown = np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n), [1e-8, 1e-8, 1e-8]
        grown = [np.full(w.shape, 1e-8) for w in (weights, steps, start)]
        for _ in range(rounds):
            slopes = [-decay * len(coded) * w for w in (weights, steps, start)]
            for cells, gold in coded:
                emit = np.stack([weights[c].sum(axis=0) for c in cells])
                size = len(cells)
                ahead, back = np.zeros((size, n)), np.zeros((size, n))
                ahead[0] = start + emit[0]
                for i in range(1, size):
                    ahead[i] = emit[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + steps, axis=0)
                for i in range(size - 2, -1, -1):
                    back[i] = np.logaddexp.reduce(steps + emit[i + 1] + back[i + 1], axis=1)
                total = np.logaddexp.reduce(ahead[-1])
                share = -np.exp(ahead + back - total)
                share[np.arange(size), gold] += 1
                for c, s in zip(cells, share, strict=True):
                    slopes[0][c] += s
                slopes[2] += share[0]
                for i in range(1, size):
                    slopes[1] -= np.exp(ahead[i - 1][:, None] + steps + emit[i] + back[i] - total)
                    slopes[1][gold[i - 1], gold[i]] += 1
            for w, g, s in zip((weights, steps, start), grown, slopes, strict=True):
                g += s * s
                w += rate * s / np.sqrt(g)
        # what may follow what is no matter of learning: a span goes on in its own kind only
        for k in ("card", "phone"):
            inside = LABELS.index(f"I-{k}")
            start[inside] = -1e6
            for i, x in enumerate(LABELS):
                if x not in (f"B-{k}", f"I-{k}"):
                    steps[i, inside] = -1e6
        self.names, self.weights = names, weights
        self.steps, self.start = steps.astype(np.float32), start.astype(np.float32)


class Decoder:
    """Viterbi over batches of lines; token classes and their emissions are made once for each shape."""

    def __init__(self, field: Field):
        self.field = field
        self.classes: dict[tuple[str, ...], int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, 3, len(LABELS)), np.float32)
        outer = self

        class Tokens(dict):
            def __missing__(self, token: str) -> int:
                if len(self) > REMEMBERED:
                    self.clear()
                c = self[token] = outer.class_of(features(token))
                return c

        self.tokens = Tokens()

    def class_of(self, found: tuple[str, ...]) -> int:
        if (c := self.classes.get(found)) is None:
            c = self.classes[found] = len(self.rows)
            names, w = self.field.names, self.field.weights
            self.rows.append(np.stack([sum((w[i] for f in found if (i := names.get(at + f)) is not None), np.zeros(len(LABELS))) for at in "=<>"]).astype(np.float32))
        return c

    def decode(self, lines: list[list[str]]) -> np.ndarray:
        """Labels of all tokens of the lines, one line after the other. No line is empty."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        c = np.fromiter((x for line in lines for x in map(self.tokens.__getitem__, line)), np.int64, int(sizes.sum()))
        if len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        emit = self.table[c, 0]
        starts, ends = np.zeros(len(c), bool), np.zeros(len(c), bool)
        starts[first] = ends[first + sizes - 1] = True
        emit[1:] += np.where(starts[1:, None], 0, self.table[c[:-1], 1])
        emit[:-1] += np.where(ends[:-1, None], 0, self.table[c[1:], 2])
        score = self.field.start + emit[first]
        came = np.zeros((len(c), len(LABELS)), np.int8)
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # lines longer than t
        steps = self.field.steps
        for t in range(1, int(sizes[0])):
            n = active[t]
            at = first[:n] + t
            ways = score[:n, :, None] + steps
            prior = ways.argmax(axis=1)
            came[at] = prior
            score[:n] = np.take_along_axis(ways, prior[:, None, :], axis=1)[:, 0] + emit[at]
        labels = np.zeros(len(c), np.int8)
        now = score.argmax(axis=1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            labels[at] = now[:n]
            if t:
                now[:n] = came[at, now[:n]]
        return labels


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of local@label.label..., leftmost and non-overlapping."""
    out, free = [], 0  # free: the first character that no earlier @ or span has taken
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans of four numbers of at most 255 with dots between; a longer chain is taken in fours."""
    out = []
    for m in _CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                    out.append((at, at + size))
                at += size + 1
    return out


def numbers(text: str, pattern: re.Pattern, least: int, most: int, valid=lambda digits: True) -> list[tuple[int, int]]:
    """Spans of a pattern with the given number of digits, which are valid."""
    return [m.span() for m in pattern.finditer(text) if least <= len(d := "".join(_DIGIT.findall(m[0]))) <= most and valid(d)]


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The patterns' spans (kind, start, end), by kind and start."""
    found = {"email": emails(text) if "@" in text else []}
    if _DIGIT.search(text):
        found |= {"ip": addresses(text) if "." in text else [], "card": numbers(text, _CARD, 13, 19, luhn), "phone": numbers(text, _PHONE, 9, 15) if "+" in text else []}
    return [(k, a, b) for k in KINDS for a, b in found.get(k, ())]


_STARTS = re.compile(r"[\w(+]")


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without leading signs but ( and +, and without trailing signs."""
    m = _STARTS.search(text, a, b)
    a = m.start() if m else b
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == "_"):
        b -= 1
    return a, b


def field_spans(text: str, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """The spans of a text's token labels that no base span overlaps."""
    places = [m.span() for m in re.finditer(r"\S+", text)]
    out: list[Span] = []
    at = np.flatnonzero(labels).tolist()
    for i in at:
        name = LABELS[labels[i]]
        kind = name.split("-")[-1]
        if name[:2] == "I-" and out and out[-1][2] == places[i - 1][1]:
            out[-1] = (kind, out[-1][1], places[i][1])
        else:
            out.append((kind, *places[i]))
    ordered = sorted((x, y) for _, x, y in base)
    starts, reach = [x for x, _ in ordered], list(accumulate((y for _, y in ordered), max))
    added = []
    for kind, a, b in out:
        a, b = trimmed(text, a, b)
        digits = "".join(_DIGIT.findall(text[a:b]))
        enough = {"email": "." in text[a:b].partition("@")[2], "ip": 4 <= len(digits) <= 12, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 7 <= len(digits) <= 15}[kind]
        before = bisect_left(starts, b)  # base spans that start before the end
        if enough and not (before and reach[before - 1] > a):
            added.append((kind, a, b))
    return added


def all_spans(bodies: list[str | None], decoder: Decoder) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    out = []
    for at in range(0, len(bodies), 500):
        part = [t or "" for t in bodies[at : at + 500]]
        lines, counts = [], []
        for text in part:
            own = [w for line in text.split("\n") if (w := line.split())]
            lines += own
            counts.append(sum(map(len, own)))
        labels = decoder.decode(lines) if lines else np.zeros(0, np.int8)
        ends = np.cumsum(counts)
        for text, n, end in zip(part, counts, ends.tolist(), strict=True):
            base, own = base_spans(text), labels[end - n : end]
            out.append((base, field_spans(text, own, base) if own.any() else []))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _decoder(field: Field):
    key = hashlib.sha256(repr(sorted(field.names)).encode() + field.weights.tobytes() + field.steps.tobytes()).hexdigest()
    return lambda: (once(("pii", key), lambda: Decoder(field)),)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, table: list[str] | None = None) -> DataFrame:
    """Counts and spans of every row of docs (doc_id, text). table: lines with braced spans, as LABELLED."""
    tune(docs.sparkSession)
    field = Field(labelled(table or LABELLED))

    def work(batch: pa.RecordBatch, decoder: Decoder):
        out = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]}
        for base, added in all_spans(batch.column(1).to_pylist(), decoder):
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + added))
        return {"doc_id": batch.column(0)} | out

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return per_batch(texts(docs, "doc_id", "text"), SCHEMA, work, _decoder(field))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, table: list[str] | None = None) -> DataFrame:
    """docs with personal data in text replaced and n_chars, if there, counted anew; null texts stay null."""
    tune(docs.sparkSession)
    field, at = Field(labelled(table or LABELLED)), docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batch: pa.RecordBatch, decoder: Decoder):
        bodies = batch.column(at).to_pylist()
        clean = [None if t is None else redact(t, base + added) if base or added else t for t, (base, added) in zip(bodies, all_spans(bodies, decoder), strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(clean, batch.schema[at].type)
        if n_chars is not None:
            columns[n_chars] = pa.array([None if t is None else len(t) for t in clean], batch.schema[n_chars].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return per_batch(docs, docs.schema, work, _decoder(field))
