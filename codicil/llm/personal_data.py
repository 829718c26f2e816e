"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field is trained on the driver from a small labelled table (made by rule in
``labelled_table``) and decoded by Viterbi in numpy batches. Words which stay outside any
entity whatever their neighbours are (their margin exceeds what transitions can give) cut the
chains, so that only the rest is decoded; the result is the exact best path.

Rules: a null text counts as empty. Base matches are leftmost and do not overlap within a kind; matches
that fail their check are dropped without another attempt. Spans of the field are added if they pass the
check of their kind and touch no base span of it. Positions are code points, ends exclusive.
Repeated rows give repeated rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, hex_sha, pick, texts_of

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGITS = re.compile(r"[^0-9]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_PARTS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(map(small, text.split(".")))
    digits = _DIGITS.sub("", text)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def _emails(text: str):
    """The matches of the e-mail pattern, found from each @: what may stand before it reaches back over local characters,
    though not into the match before."""
    out, start, at = [], 0, text.find("@")
    tail = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    while at >= 0:
        a = at
        while a > start and _LOCAL.match(text[a - 1]):
            a -= 1
        m = tail.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            start = m.end()
        at = text.find("@", max(at + 1, start))
    return out


def _ips(text: str):
    """The matches of the ip pattern: in each run of numbers with single points between them, every four. No start is tried twice."""
    for run in _PARTS.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = ".".join(parts[i : i + 4])
            if all(map(small, parts[i : i + 4])):
                yield at, at + len(four)
            at += len(four) + 1


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if "." in text:
        out["ip"] = list(_ips(text))
    for kind in ("card", "phone"):
        if kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            if valid(kind, m.group()):
                out[kind].append(m.span())
    return out


# ---- the field -------------------------------------------------------------------------------------------------

LABELS = ("O", *KINDS)
_CLASS = {c: "9" for c in "0123456789"} | {c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        return "a" if chr(code).isalpha() else "?"


_TABLE = _Classes({i: chr(i) for i in range(128)} | {ord(c): k for c, k in _CLASS.items()})
_RUNS = re.compile(r"([^9])\1+|(9999)9+")


def shape(word: str) -> str:
    """Letters as a and A, runs of them as one; digits as 9 with runs kept to four; other ASCII as it is; runs of more as one."""
    return _RUNS.sub(r"\1\2", word.translate(_TABLE))


def features(word: str) -> tuple[str, ...]:
    """Names of the features of a word itself."""
    s = shape(word)
    digits = sum(c in "0123456789" for c in word)
    return (
        f"s:{s}",
        f"d:{min(digits, 20) if digits < 13 else 'card' if digits in (13, 14, 15, 16, 17, 18, 19) else 'more'}",
        f"@:{'@' in s}",
        f".:{min(word.count('.'), 4) * (digits > 0)}:{digits > 0}",
        f"+:{s[:1] == '+'}",
        f"(:{word[:1] == '(' and digits > 0}",
        f"h:{any(c.isalpha() for c in word) and digits > 0}",
    )


def near(word: str) -> str:
    """How a word looks to its neighbours."""
    s = shape(word)
    return "@" if "@" in s else re.sub(r"9+", "9", s) if "9" in s or "+" in s else "w" + s[-1:]


def labelled_table(rows: int = 300, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: (words, labels), made from templates."""
    r = np.random.RandomState(seed)
    pick_ = lambda xs: xs[r.randint(len(xs))]
    digits = lambda n: "".join(str(r.randint(10)) for _ in range(n))
    letters = lambda a, b: "".join(chr(97 + r.randint(26)) for _ in range(r.randint(a, b)))

    def card():
        n = digits(15)
        n = "4" + n[1:]
        return next(n + str(c) for c in range(10) if luhn(n + str(c)))

    def entity(kind):
        if kind == "email":
            host = f"{letters(3, 8)}.{pick_(['com', 'org', 'net'])}"
            return [pick_([f"{letters(2, 9)}.{digits(2)}@mail{digits(1)}.{host}", f"{letters(3, 9)}@{host}", f"{letters(2, 6)}_{letters(2, 6)}@{host}"])]
        if kind == "ip":
            return [".".join(str(r.randint(256)) for _ in range(4))]
        if kind == "card":
            c = card()
            return pick_([[c], [c[i : i + 4] for i in (0, 4, 8, 12)], ["-".join(c[i : i + 4] for i in (0, 4, 8, 12))]])
        a, b, c = digits(3), digits(3), digits(4)
        return pick_([["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{digits(2)}", digits(3), digits(4)], [f"{a}-{b}-{c}"], [f"+1-{a}-{b}-{c}"], [f"({a}){b}-{c}"]])

    def other():
        return pick_([
            [f"{r.randint(1, 30)}"], [f"{r.randint(9)}.{r.randint(9)}."], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"AKIA{letters(8, 16).upper()}{digits(2)}"],
            [f"password={letters(4, 8)}{digits(6)}{letters(3, 5)}"], ["token", "=", f'"{digits(6)}{letters(3, 9)}{digits(9)}{letters(2, 5)}{digits(8)}"'], [f"{digits(2)}:{digits(2)}"],
            [f"${digits(3)}.{digits(2)}"], [f"{digits(5)}"], [digits(20)], [f"({digits(4)})"], [f"{digits(1)},{digits(3)}"], ["|"], ["###"], [f"{letters(2, 5)}{digits(2)}"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"],
        ])

    def word():
        w = letters(1, 9)
        w = pick_([w, w, w, w.capitalize(), w.upper(), "é" + w])
        return w + pick_(["", "", "", "", ",", ".", "!!", "?", ";"])

    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(r.randint(3, 12)):
            x = r.rand()
            if x < 0.18:
                kind = pick_(KINDS)
                found = entity(kind)
                if r.rand() < 0.25:
                    found[-1] += pick_([".", ","])
                words += found
                labels += [kind] * len(found)
                words.append(word())
                labels.append("O")
            else:
                found = other() if x < 0.3 else [word()]
                words += found
                labels += ["O"] * len(found)
        out.append((words, labels))
    return out


class Field:
    """Weights of a linear-chain conditional random field: own features, shapes of both neighbours, transitions."""

    def __init__(self, names: list[str], around: list[str], w: dict[str, np.ndarray]):
        self.names = {n: i for i, n in enumerate(names)}
        self.around = {n: i + 1 for i, n in enumerate(around)}  # 0: unknown
        self.own, self.before, self.after, self.step = (w[k] for k in ("own", "before", "after", "step"))

    def word(self, word: str) -> tuple[np.ndarray, int]:
        own = [self.names[f] for f in features(word) if f in self.names]
        return self.own[own].sum(axis=0) if own else np.zeros(len(LABELS)), self.around.get(near(word), 0)


def train(table: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.2, l2: float = 0.02) -> Field:
    """Full-batch gradient ascent (Adam) on the conditional likelihood of the table."""
    names = sorted({f for ws, _ in table for w in ws for f in features(w)})
    around = sorted({near(w) for ws, _ in table for w in ws})
    blank = Field(names, around, {k: np.zeros((1, len(LABELS))) for k in ("own", "before", "after", "step")})
    n, longest, k = len(table), max(len(ws) for ws, _ in table), len(LABELS)
    width = len(features("x"))
    own = np.full((n, longest, width), len(names))
    prev, foll, gold = (np.zeros((n, longest), np.int64) for _ in range(3))
    mask = np.zeros((n, longest), bool)
    for i, (ws, ls) in enumerate(table):
        about = [blank.around[near(w)] for w in ws]
        mask[i, : len(ws)] = True
        gold[i, : len(ws)] = [LABELS.index(x) for x in ls]
        prev[i, 1 : len(ws)], foll[i, : len(ws) - 1] = about[:-1], about[1:]
        for j, w in enumerate(ws):
            own[i, j] = [blank.names[f] for f in features(w)]
    p = {"own": np.zeros((len(names) + 1, k)), "before": np.zeros((len(around) + 1, k)), "after": np.zeros((len(around) + 1, k)), "step": np.zeros((k, k))}
    m, v = ({a: np.zeros_like(b) for a, b in p.items()} for _ in range(2))
    one = np.eye(k)
    both = mask[:, 1:]
    for r in range(1, rounds + 1):
        em = p["own"][own].sum(axis=2) + p["before"][prev] + p["after"][foll]
        fw, bw = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fw[:, 0] = em[:, 0]
        for t in range(1, longest):
            new = em[:, t] + np.logaddexp.reduce(fw[:, t - 1, :, None] + p["step"], axis=1)
            fw[:, t] = np.where(mask[:, t, None], new, fw[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(p["step"] + (em[:, t + 1] + bw[:, t + 1])[:, None, :], axis=2)
            bw[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(fw[:, -1], axis=1)
        prob = np.exp(fw + bw - z[:, None, None]) * mask[..., None]
        pair = np.exp(fw[:, :-1, :, None] + p["step"] + (em + bw)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        off = (one[gold] - prob) * mask[..., None]
        g = {a: np.zeros_like(b) for a, b in p.items()}
        for c, y in np.ndindex(width, k):
            g["own"][:, y] += np.bincount(own[:, :, c].ravel(), off[:, :, y].ravel(), len(names) + 1)
        for y in range(k):
            g["before"][:, y] = np.bincount(prev.ravel(), off[:, :, y].ravel(), len(around) + 1)
            g["after"][:, y] = np.bincount(foll.ravel(), off[:, :, y].ravel(), len(around) + 1)
        np.add.at(g["step"], (gold[:, :-1][both], gold[:, 1:][both]), 1)
        g["step"] -= pair.sum(axis=(0, 1))
        for a in p:
            d = g[a] - l2 * p[a]
            m[a], v[a] = 0.9 * m[a] + 0.1 * d, 0.99 * v[a] + 0.01 * d * d
            p[a] += rate * (m[a] / (1 - 0.9**r)) / (np.sqrt(v[a] / (1 - 0.99**r)) + 1e-8)
    p["own"] = p["own"][:-1]
    return Field(names, around, p)


class Decoder:
    """What a worker keeps: for words seen the number of their kind of word (words without digits are told apart by
    shape alone), for kinds their own scores and how they look to neighbours."""

    #: Words and kinds remembered, and the characters of both.
    LIMIT, KINDS_LIMIT, HELD = 300_000, 200_000, 32 << 20

    def __init__(self, field: Field):
        self.field = field
        self.reset()
        t = field.step
        # the most that transitions around one word can gain over leaving it outside
        self.slack = float((t[:, 1:, None] + t[None, 1:, :] - t[:, :1, None] - t[None, :1, :]).max())

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.kind: dict[str, int] = {}
        self.held = 0
        self.scores, self.looks = [np.r_[60.0, np.zeros(len(KINDS))]], [0]  # 0: between texts
        self.table, self.look = np.array(self.scores), np.array(self.looks)

    def ids(self, words: list[str]) -> list[int]:
        number = self.number
        try:
            return list(map(number.__getitem__, words))
        except KeyError:
            return [number[w] if w in number else self.add(w) for w in words]

    def add(self, word: str) -> int:
        s = shape(word)
        of = word if "9" in s else s
        if (n := self.kind.get(of)) is None:
            own, look = self.field.word(word)
            n = self.kind[of] = len(self.scores)
            self.held += len(of)
            self.scores.append(own)
            self.looks.append(look)
        self.number[word] = n
        self.held += len(word)
        return n

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each text; those without any entity give an empty array."""
        if len(self.kind) > self.KINDS_LIMIT or self.held > self.HELD:
            self.reset()
        elif len(self.number) > self.LIMIT:
            self.number = {}
        ids = [0]
        for ws in texts:
            ids += self.ids(ws)
            ids.append(0)
        if len(self.scores) > len(self.table):
            self.table, self.look = np.array(self.scores), np.array(self.looks)
        ids = np.array(ids)
        look, f = self.look[ids], self.field
        em = self.table[ids]
        em[1:] += f.before[look[:-1]]
        em[:-1] += f.after[look[1:]]
        loose = em[:, 0] - em[:, 1:].max(axis=1) <= self.slack
        loose[ids == 0] = False
        best = np.zeros(len(ids), np.int64)
        edge = np.flatnonzero(np.diff(np.r_[False, loose, False].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            self._viterbi(em, starts, ends, best)
        out, at = [], 1
        for ws in texts:
            got = best[at : at + len(ws)]
            out.append(got if got.any() else got[:0])
            at += len(ws) + 1
        return out

    def _viterbi(self, em, starts, ends, best) -> None:
        """All chains at once; each lies between words that are outside."""
        step = self.field.step
        order = np.argsort(starts - ends, kind="stable")
        starts, size = starts[order], (ends - starts)[order]
        score = em[starts] + step[0]
        back = []
        active = len(starts)
        last = np.empty(len(starts), np.int64)
        for t in range(1, int(size[0]) + 1):
            now = int(np.searchsorted(-size, -t, "left"))  # chains longer than t
            ended = slice(now, active)
            last[ended] = (score[ended] + step[:, 0]).argmax(axis=1)
            if not now:
                break
            through = score[:now, :, None] + step
            back.append(through.argmax(axis=1))
            score = through.max(axis=1) + em[starts[:now] + t]
            active = now
        for t in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t, "left"))
            best[starts[:n] + t] = last[:n]
            if t:
                last[:n] = back[t - 1][np.arange(n), last[:n]]


_WORD = re.compile(r"\S+")
_STRIP_LEFT, _STRIP_RIGHT = "\"'<[{|,;:.!?", "\"'>]}|,;:.!?)"


def field_spans(text: str, words: list[str], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of a label as spans, without outer punctuation, that pass the check of their kind."""
    where = [m.span() for m in _WORD.finditer(text)]
    out, i = [], 0
    while i < len(labels):
        if not (y := labels[i]):
            i += 1
            continue
        j = i
        while j < len(labels) and labels[j] == y:
            j += 1
        a, b = where[i][0], where[j - 1][1]
        while a < b and text[a] in _STRIP_LEFT:
            a += 1
        while b > a and text[b - 1] in _STRIP_RIGHT and not (text[b - 1] == ")" and "(" in text[a:b] and LABELS[y] == "phone"):
            b -= 1
        kind, s = LABELS[y], text[a:b]
        if _plausible(kind, s):
            out.append((kind, a, b))
        i = j
    return out


def _plausible(kind: str, s: str) -> bool:
    digits = _DIGITS.sub("", s)
    if kind == "email":
        return s.count("@") == 1 and "." in s.rpartition("@")[2].strip(".") and s[0] != "@"
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 -]", s)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9 ()+.-]", s)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, the counts of base matches, base_sha256, spans (all of them, ``kind:start:end`` by kind, then start), n_added."""
    field = field or train(labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if _kept.get("of") is not shared.value:
            _kept.update(of=shared.value, by=Decoder(shared.value))
        decoder = _kept["by"]
        texts = texts_of(batch)
        words = [t.split() for t in texts]
        counts, shas, spans, added = [], [], [], []
        for text, ws, labels in zip(texts, words, decoder.labels(words)):
            found = base_spans(text)
            counts.append([len(found[k]) for k in KINDS])
            base = [f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]]
            shas.append(hex_sha(",".join(base).encode()))
            new = 0
            for kind, a, b in field_spans(text, ws, labels) if len(labels) else ():
                if not any(a < y and x < b for x, y in found[kind]):
                    found[kind].append((a, b))
                    new += 1
            spans.append(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found[k])) if new else ",".join(base))
            added.append(new)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
        )

    return arrow_map(pick(docs, doc_id="long", text="string"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


_kept: dict = {}
