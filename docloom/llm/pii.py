"""Personal data: listed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (digit counts, group lengths, shape, checksum, the word before) of up to
`LONGEST` tokens, and one dynamic program over a region's tokens picks boundaries and types together. It is trained on
the driver, once a process, by the likelihood of sentences that a fixed seed generates; no corpus row is used. Every type
has a digit or an at sign in all of its spans, so a segment without either can only be outside; the field is therefore
run over the neighbourhoods of tokens that have one, wherever in a text they are and however long, in linear work.

Defined results: a null or empty text has no spans; repeated rows are scanned each; an empty table gives no rows; long
texts are scanned whole; ties of equal path scores go to the lower type and the shorter segment; other input columns
are ignored but those in `keep`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest entity.
LONGEST = 6
SENTENCES, PASSES, SEED = 360, 6, 5

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_BLANKS = frozenset("\t\n\x0b\x0c\r ")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the listed patterns: leftmost, non-overlapping per kind, failing ones dropped."""
    found = []
    at = text.find("@")
    while at >= 0:  # a match lies within the run of mail characters around its at sign
        lo, hi = at, at + 1
        while lo and text[lo - 1] in _MAIL_CHARS:
            lo -= 1
        while hi < len(text) and text[hi] in _MAIL_CHARS:
            hi += 1
        found += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text, lo, hi)]
        at = text.find("@", hi)
    if not _DIGITS.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found)


# --- the field -------------------------------------------------------------------------------------------------------

_CUES = {w: k for k, ws in {"phone": ("tel", "phone", "call", "mobile", "fax", "cell"), "card": ("card", "visa", "mastercard", "amex", "credit"), "ip": ("ip", "host", "server", "address"), "email": ("email", "mail", "contact", "write")}.items() for w in ws}
_CORE = re.compile(r"[+(A-Za-z0-9].*[A-Za-z0-9)]|[A-Za-z0-9]", re.S)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A segment without the punctuation around it."""
    m = _CORE.search(text, start, end)
    return (m.start(), m.end()) if m else (start, start)


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the whole segment of tokens i to j (exclusive)."""
    lo, hi = trimmed(text, tokens[i][0], tokens[j - 1][1])
    span = text[lo:hi]
    digits = re.sub(r"[^0-9]", "", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", span))
    before = re.sub(r"\W", "", text[tokens[i - 1][0] : tokens[i - 1][1]]).lower() if i else ""
    n = len(digits)
    band = next((b for b in (0, 3, 6, 9, 11, 13, 16, 19) if n <= b), 20)
    out = ["one", f"tokens={j - i}", f"digits={band}", f"shape={shape}", f"groups={'-'.join(map(str, groups))}", f"cue={_CUES.get(before, '')}"]
    inner = span[1:-1]
    out.append(f"marks={'@' if '@' in inner else ''}{'+' if span[:1] == '+' else ''}{'(' if '(' in span else ''}{':' if ':' in inner else ''}{'/' if '/' in inner else ''}{',' if ',' in inner else ''}")
    out.append(f"letters={bool(re.search('[A-Za-z]', span))},{band >= 9}")
    if 14 <= n <= 19 and not re.search("[^0-9 -]", span):
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span):
        out.append(f"octets={all(g < 4 for g in groups) and all(int(x) < 256 for x in span.split('.'))}")
    if _EMAIL.fullmatch(span):
        out.append("mail")
    if j - i > 1 and (text[tokens[j - 2][1] - 1] in ",;:!?" or "\n" in text[tokens[i][0] : tokens[j - 1][1]]):
        out.append("broken")
    return out


class Field:
    """Weights of (feature, type) and of neighbouring types; type 0 is outside, of one token each."""

    def __init__(self):
        self.types = len(KINDS) + 1
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((self.types, self.types))

    def cells(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
        n = len(tokens)
        return {(i, j): features(text, tokens, i, j) for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1)}

    def scores(self, cells) -> dict[tuple[int, int], np.ndarray]:
        none = np.zeros(self.types)
        out = {}
        for (i, j), names in cells.items():
            s = np.sum([self.weights.get(f, none) for f in names], axis=0)
            if j - i > 1:
                s[0] = -np.inf
            out[i, j] = s
        return out

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Segments (first token, end token, type) of the best path, outside ones left out.

        Only the last LONGEST rows of the table and the features of the segments that end at one token are held; of the
        path, a length and a type for each token and type stay, so a region of any length takes a few bytes a token."""
        n = len(tokens)
        none = np.zeros(self.types)
        recent = [np.full(self.types, -np.inf)]
        recent[0][0] = 0.0
        lengths, came_from = np.zeros((n + 1, self.types), np.int8), np.zeros((n + 1, self.types), np.int8)
        for j in range(1, n + 1):
            top = np.full(self.types, -np.inf)
            for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
                score = np.sum([self.weights.get(f, none) for f in features(text, tokens, i, j)], axis=0)
                if j - i > 1:
                    score[0] = -np.inf
                into = recent[i - j][:, None] + self.moves
                came = into.argmax(0)
                value = into[came, range(self.types)] + score
                better = value > top
                top = np.where(better, value, top)
                lengths[j][better], came_from[j][better] = j - i, came[better]
            recent = [*recent[-LONGEST + 1 :], top]
        out, j, y = [], n, int(recent[-1].argmax())
        while j:
            length, before = int(lengths[j, y]), int(came_from[j, y])
            if y:
                out.append((j - length, j, y))
            j, y = j - length, before
        return out[::-1]

    def learn(self, text: str, tokens, gold: list[tuple[int, int, int]], squares: dict, rate: float) -> None:
        """A step up the log-likelihood of the gold segments: their features less the expected ones."""
        n = len(tokens)
        cells = self.cells(text, tokens)
        scores = self.scores(cells)
        ahead = np.full((n + 1, self.types), -np.inf)
        ahead[0, 0] = 0.0
        for j in range(1, n + 1):
            parts = [np.logaddexp.reduce(ahead[i][:, None] + self.moves, axis=0) + scores[i, j] for i in range(max(0, j - LONGEST), j)]
            ahead[j] = np.logaddexp.reduce(parts, axis=0)
        behind = np.full((n + 1, self.types), -np.inf)
        behind[n] = 0.0
        for i in range(n - 1, -1, -1):
            parts = [np.logaddexp.reduce(self.moves + (scores[i, j] + behind[j])[None, :], axis=1) for j in range(i + 1, min(n, i + LONGEST) + 1)]
            behind[i] = np.logaddexp.reduce(parts, axis=0)
        total = np.logaddexp.reduce(ahead[n])
        grad: dict[str, np.ndarray] = {}
        moves = np.zeros_like(self.moves)
        chosen = {(i, j): y for i, j, y in gold}
        for (i, j), names in cells.items():
            pair = np.exp(ahead[i][:, None] + self.moves + (scores[i, j] + behind[j])[None, :] - total)
            g = -pair.sum(0)
            moves -= pair
            if (i, j) in chosen:
                g[chosen[i, j]] += 1
            if np.abs(g).max() > 1e-4:
                for f in names:
                    grad[f] = grad.get(f, 0) + g
        before = 0
        for i, j, y in sorted(gold):
            moves[before, y] += 1
            before = y
        for f, g in grad.items():
            squares[f] = squares.get(f, 1e-2) + g * g
            self.weights[f] = self.weights.get(f, np.zeros(self.types)) * (1 - 2e-4) + rate * g / np.sqrt(squares[f])
        squares[None] = squares.get(None, 1e-2) + moves * moves
        self.moves += rate * moves / np.sqrt(squares[None])


def tokens_of(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in re.compile(r"[^\t-\r ]+").finditer(text, lo, len(text) if hi is None else hi)]


def _entity(r: random.Random, kind: int) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    if kind == 1:
        return r.choice([f"{w()}.{w()}@{w()}.com", f"{w()}{d(2)}@{w()}.{w()}.org", f"{w()}@{w()}.net", f"{w()}.{d(2)}@mail{d(1)}.example.com", f"<{w()}@{w()}.io>"])
    if kind == 2:
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == 3:
        while True:
            n = r.choice([16, 16, 16, 15])
            number = r.choice("345") + d(n - 1)
            if luhn(number):
                break
        sep = r.choice(["", "", " ", "-", " "])
        cut = [4, 10] if n == 15 else [4, 8, 12]
        return sep.join(number[a:b] for a, b in zip([0, *cut], [*cut, n]))
    return r.choice([f"+1 ({d(3)}) 555-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)}{d(10)}", f"({d(3)}) {d(3)}-{d(4)}"])


def _unchecked(r: random.Random) -> str:
    """As long as a card number, but without its checksum."""
    while luhn(number := "".join(r.choice("0123456789") for _ in range(r.choice([14, 15, 16, 16, 16, 19])))):
        pass
    sep = r.choice(["", "", "", " ", "-"])
    return sep.join(number[k : k + 4] for k in range(0, len(number), 4))


def _decoy(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{d(1)}.{d(2)}", f"#{d(6)}", d(r.randint(1, 13)), f"{d(1)},{d(3)}.{d(2)}", f"19{d(2)}", "4.0", "3.", f"{d(2)}-{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), _unchecked(r), _unchecked(r), _unchecked(r), _unchecked(r), f'"{"".join(r.choice("0123456789abcdef") for _ in range(32))}"', f"@{'abc'[: r.randint(1, 3)]}", f"{d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}", f"{d(4)} {d(4)}", f"{d(2)}/{d(2)}/20{d(2)}"])


def sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with their entity spans (start, end, type)."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            words = ["".join(r.choice("abcdefghilmnoprstué") for _ in range(r.randint(2, 9))) for _ in range(r.randint(0, 2))]
            kind = r.randint(1, len(KINDS)) if r.random() < 0.6 else 0
            if kind and r.random() < 0.3:
                words.append(r.choice([w for w, k in _CUES.items() if k == KINDS[kind - 1]]) + r.choice(["", ":"]))
            text += "".join(w + " " for w in words)
            piece = _entity(r, kind) if kind else _decoy(r)
            if kind:
                lo, hi = trimmed(piece, 0, len(piece))
                spans.append((len(text) + lo, len(text) + hi, kind))
            text += piece + r.choice(["", "", ".", ",", "***", "%%%", "!!", " |"]) + " "
        out.append((text + r.choice(["", "end."]), spans))
    return out


@cache
def trained(n: int = SENTENCES, passes: int = PASSES, seed: int = SEED) -> Field:
    field, squares, data = Field(), {}, []
    for text, spans in sentences(n, seed):
        tokens = tokens_of(text)
        gold, at = [], 0
        for start, end, kind in spans:
            i = next(k for k, t in enumerate(tokens) if t[0] <= start < t[1])
            j = next(k for k, t in enumerate(tokens) if t[0] < end <= t[1]) + 1
            gold += [(k, k + 1, 0) for k in range(at, i)] + [(i, j, kind)]
            at = j
        data.append((text, tokens, gold + [(k, k + 1, 0) for k in range(at, len(tokens))]))
    order = random.Random(seed)
    for turn in range(passes):
        order.shuffle(data)
        for text, tokens, gold in data:
            field.learn(text, tokens, gold, squares, 0.3 / (1 + turn) ** 0.5)
    return field


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens with a digit or an at sign, short tokens between them included, and a token before and after."""
    group: list[tuple[int, int]] = []
    at, n = 0, len(text)
    while m := _TRIGGER.search(text, at):
        lo, hi = m.start(), m.end()
        while lo and text[lo - 1] not in _BLANKS:
            lo -= 1
        while hi < n and text[hi] not in _BLANKS:
            hi += 1
        if group:
            between = tokens_of(text, group[-1][1], lo)
            if len(between) <= 1 and all(b - a <= 2 for a, b in between):
                group += between
            else:
                yield _with_context(text, group)
                group = []
        group.append((lo, hi))
        at = hi
    if group:
        yield _with_context(text, group)


def _with_context(text: str, group: list[tuple[int, int]]) -> list[tuple[int, int]]:
    hi = group[0][0]
    while hi and text[hi - 1] in _BLANKS:
        hi -= 1
    lo = hi
    while lo and text[lo - 1] not in _BLANKS:
        lo -= 1
    return ([(lo, hi)] if hi > lo else []) + group


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field's best paths that meet no base span."""
    out = []
    taken = sorted((a, b) for a, _, b in base)
    for tokens in regions(text):
        lo, hi = tokens[0][0], tokens[-1][1]
        near = [x for x in taken if x[0] < hi and x[1] > lo]
        if near and near[0][0] <= tokens[-1][0] and all(any(a < e and b > s for a, b in near) or not _TRIGGER.search(text, s, e) for s, e in tokens):
            continue  # base spans hold every trigger of the region
        for i, j, y in field.best(text, tokens):
            start, end = trimmed(text, tokens[i][0], tokens[j - 1][1])
            if end > start and not any(a < end and b > start for a, b in near):
                out.append((start, y - 1, end))
    return out


def _mapper(shipped, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shipped.value
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: dict[str, list] = {**{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
                for text in part.column(part.schema.get_field_index("__text")).to_pylist():
                    base = base_spans(text) if text else []
                    more = added_spans(text, field, base) if text and _TRIGGER.search(text) else []
                    for k, kind in enumerate(KINDS):
                        out[f"n_{kind}"].append(sum(x[1] == k for x in base))
                    out["base_sha256"].append(hashlib.sha256(said(base).encode()).hexdigest())
                    out["spans"].append(said(base + more))
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v, pa.int64() if c[:2] == "n_" else pa.string()) for c, v in out.items())], [*keep, *out])

    return run


def find(docs: DataFrame, keep: list[str] | None = None, field: Field | None = None) -> DataFrame:
    """The `keep` columns (default doc_id) with n_<kind>, base_sha256 and spans."""
    keep = keep or ["doc_id"]
    shipped = docs.sparkSession.sparkContext.broadcast(field or trained())  # a few thousand weights, by training set
    held = [f"__k{i}" for i in range(len(keep))]
    read = docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(keep, held)), F.col("text").alias("__text"))
    kinds = ", ".join(f"{h} {read.schema[h].dataType.simpleString()}" for h in held)
    made = "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    out = read.mapInArrow(_mapper(shipped, held), f"{kinds}, {made}")
    return out.select(*(F.col(h).alias(c) for c, h in zip(keep, held)), *(c.split()[0] for c in made.split(", ")))
