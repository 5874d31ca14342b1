"""Personal data in text: exact base patterns, and a semi-Markov conditional random field that adds spans they miss.

The field scores whole candidate spans (up to MAX_TOKENS tokens and MAX_CHARS signs) for each kind, and single tokens as other text, plus a
weight for each pair of neighbouring labels; dynamic programming chooses boundaries and kinds together. Features see what
a number looks like as a whole: dates, book numbers, thousands, ranges, counts, national and international prefixes. That a
card has 13 to 19 digits and passes its check, and that a phone number has MIN_DIGITS digits besides dates, are conditions, not weights. A candidate holds
an "@" and no gap, or at least MIN_DIGITS digits and no letter, so all text farther than a span from such signs is other text at constant score, and
only windows around them are decoded: the same best path as over the whole text, but for ties of equal scores. Weights are learned by likelihood from
examples made by rule with a fixed seed (`examples`), in some seconds, on the driver.

Base spans always stay; spans of the field are added where they touch none of them.

Defined cases: a null or empty text has no span; places are code points; texts of any length are scanned whole in linear
time; rows are independent; other columns are ignored, or kept by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS, MIN_DIGITS = 16, 80, 7
#: Signs that may stand within an entity, besides letters and digits.
SIGNS_WITHIN = " \t._%+-@()/"

# Fixed patterns of the contract. Possessive and look-behind forms match the same, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNS = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|.", re.S)
_DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The local part runs back from an "@" to the first sign it cannot hold; it never crosses another "@"."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m and at > done:
            a = at
            while a > done and _LOCAL.match(text, a - 1):
                a -= 1
            if a < at:
                yield "email", a, m.end()
                done = m.end()
                at = text.find("@", done)
                continue
        done, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind as listed."""
    if not _SIGNS.search(text):
        return []
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the field ----
LABELS = ("other", *KINDS)
N_FEATURES, CARD, PHONE = 39, LABELS.index("card"), LABELS.index("phone")
_DATE = re.compile(r"(?<![0-9])(?:[12][0-9]{3}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:[12][0-9])?[0-9]{2})(?![0-9])")
#: With its year in full, and a day and month that can be.
_FULL_DATE = re.compile(r"(?<![0-9])(?:(?:1[0-9]|20)[0-9]{2}([-./])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-./])(?:0?[1-9]|1[0-2])\2(?:1[0-9]|20)[0-9]{2})(?![0-9])")
_RANGE = re.compile(r"(?<![0-9])([0-9]{1,4})[-/]([0-9]{1,4})(?![0-9])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[0-9 ]*$")


def book_number(digits: str) -> bool:
    """A 13-digit article number of a book, by its check digit."""
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(c) * (1 + 2 * (k & 1)) for k, c in enumerate(digits)) % 10 == 0


def thousands(s: str, groups: list[str]) -> bool:
    """One number with its digits in threes, parted by one sign."""
    return len(groups) >= 3 and len(groups[0]) <= 3 and groups[0][0] != "0" and all(len(g) == 3 for g in groups[1:]) and len(set(re.sub("[0-9]", "", s))) == 1


def features(text: str, a: int, b: int) -> np.ndarray:
    """Of the whole span text[a:b]."""
    s = text[a:b]
    digits = "".join(_DIGIT.findall(s))
    n, mail = len(digits), s.count("@")
    before, after = text[a - 1 : a], text[b : b + 1]
    plain = all(c in "0123456789 ().+-/" for c in s)
    parts = s.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    groups = re.findall(r"[0-9]+", s)
    domain = s.rpartition("@")[2] if mail else ""
    f = (
        1,
        mail == 1,
        mail == 1 and bool(_DOMAIN.fullmatch(domain)),
        mail == 1 and s[0] != "@" and " " not in s,
        quad,
        quad and all(len(p) <= 3 and int(p) <= 255 for p in parts),
        14 <= n <= 19 and plain,
        14 <= n <= 19 and plain and luhn(digits),
        10 <= n <= 15 and plain,
        s[0] == "+",
        "(" in s and ")" in s and plain,
        plain and s.count("(") == s.count(")"),
        plain and 3 <= len(groups) <= 5 and all(1 <= len(g) <= 4 for g in groups) and 10 <= n <= 15,
        n < 4 and not mail,
        before == "" or before.isspace() or before in "(:\"'",
        before.isalnum() or before in (".", "-", "+", "@", "_"),
        after == "" or after.isspace() or after in ".,;)\"'",
        after.isalnum() or after in ("@", "-", "_"),
        not s[0].isalnum() and s[0] not in "+(",
        not s[-1].isalnum(),
        plain and len(_DIGIT.findall(_DATE.sub("", s))) < min(n, MIN_DIGITS),
        plain and book_number(digits),
        plain and thousands(s, groups),
        plain and len(groups) >= 4 and sum(len(g) == 1 for g in groups) >= len(groups) / 2,
        plain and len(groups) >= 3 and all(int(y) == int(x) + 1 for x, y in zip(groups, groups[1:], strict=False)),
        plain and any(len(m[1]) == len(m[2]) and m[1] < m[2] for m in _RANGE.finditer(s)) and " " in s,
        plain and s[0] == "0" and s[1:2] != "0" and 9 <= n <= 12 and not _DATE.search(s),
        plain and s[:2] == "00" and 10 <= n <= 15,
        plain and n < 9,
        plain and len(groups) == 1 and s[0] not in "0+",
        plain and len({c for c in s if c in ".-/"}) > 1 or "." in s and any(len(g) <= 2 for g in groups[1:]),
        plain and bool(_ACCOUNT.search(text[max(0, a - 40) : a])),
        plain and [len(g) for g in groups] == [3, 3, 4],
        plain and 13 <= n <= 19 and (len(groups) == 1 or all(len(g) == 4 for g in groups[:-1])),
        plain and 13 <= n <= 19 and len(groups) > 1 and any(len(g) != 4 for g in groups[:-1]),
        plain and s.count("(") != s.count(")"),
        before in tuple(".-/:") and text[a - 2 : a - 1].isdigit(),
        after in tuple(".-/:") and text[b + 1 : b + 2].isdigit(),
        plain and len(groups) > 1 and bool(_DATE.search(text, max(0, a - 6), b + 6)),
    )
    return np.array(f, float)


def card_like(s: str) -> bool:
    digits = "".join(_DIGIT.findall(s))
    return 13 <= len(digits) <= 19 and luhn(digits)


def phone_like(s: str) -> bool:
    """Whether enough digits are left without the dates in it."""
    return len(_DIGIT.findall(_FULL_DATE.sub("", s))) >= MIN_DIGITS


class Lattice:
    """Tokens of a window and its candidate spans."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.spans: list[tuple[int, int]] = []  # token i to token j, exclusive
        n = len(self.tokens)
        kind = [text[x:y] for x, y in self.tokens]
        counts = [len(_DIGIT.findall(v)) for v in kind]
        letters = [v[0].isalpha() for v in kind]
        for i in range(n):
            if not (kind[i].isalnum() or kind[i] in ("+", "(")):
                continue
            digits, mail, alpha, gap = 0, False, False, False
            for j in range(i, min(n, i + MAX_TOKENS)):
                v = kind[j]
                mail, alpha, gap = mail or v == "@", alpha or letters[j], gap or v[0] in " \t()"
                digits += counts[j]
                if self.tokens[j][1] - self.tokens[i][0] > MAX_CHARS or not (v.isalnum() or v[0] in SIGNS_WITHIN) or gap and alpha:
                    break
                if v.isalnum() and (mail or digits >= MIN_DIGITS and not alpha):
                    self.spans.append((i, j + 1))
        self.x = np.array([features(text, self.tokens[i][0], self.tokens[j - 1][1]) for i, j in self.spans]) if self.spans else np.zeros((0, N_FEATURES))
        self.o = np.array([features(text, a, b) for a, b in self.tokens]) if n else np.zeros((0, N_FEATURES))
        whole = [text[self.tokens[i][0] : self.tokens[j - 1][1]] for i, j in self.spans]
        self.no_card, self.no_phone = (np.array([not ok(s) for s in whole], bool) for ok in (card_like, phone_like))
        self.ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(self.spans):
            self.ending[j].append(k)


    def scores(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every span for every label, and of every token as other text."""
        s = self.x @ w.T
        s[self.no_card, CARD] = s[self.no_phone, PHONE] = -np.inf
        return s, self.o @ w[0]


def decode(lat: Lattice, w: np.ndarray, t: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation's entities, as characters."""
    n = len(lat.tokens)
    if not lat.spans:
        return []
    s, o = lat.scores(w)
    best = np.full((n + 1, len(LABELS)), -np.inf)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    best[0, 0] = 0.0
    for j in range(1, n + 1):
        prev = best[j - 1] + t[:, 0]
        p = int(prev.argmax())
        best[j, 0], back[j, 0] = prev[p] + o[j - 1], (j - 1, p)
        for k in lat.ending[j]:
            i = lat.spans[k][0]
            cand = (best[i][:, None] + t).max(0) + s[k]
            for y in range(1, len(LABELS)):
                if cand[y] > best[j, y]:
                    best[j, y], back[j, y] = cand[y], (i, int((best[i] + t[:, y]).argmax()))
    out, j, y = [], n, int(best[n].argmax())
    while j:
        i, p = back[j, y]
        if y:
            out.append((LABELS[y], lat.tokens[i][0], lat.tokens[j - 1][1]))
        j, y = i, p
    return out[::-1]


def _gradient(lat: Lattice, gold: dict[tuple[int, int], int], w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log likelihood, by sums over all segmentations forwards and backwards."""
    n, m = len(lat.tokens), len(LABELS)
    s, o = lat.scores(w)
    fwd, bwd = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
    fwd[0, 0] = 0.0
    lse = np.logaddexp.reduce
    for j in range(1, n + 1):
        fwd[j, 0] = lse(fwd[j - 1] + t[:, 0]) + o[j - 1]
        for k in lat.ending[j]:
            into = lse(fwd[lat.spans[k][0]][:, None] + t, axis=0) + s[k]
            fwd[j, 1:] = np.logaddexp(fwd[j, 1:], into[1:])
    bwd[n] = 0.0
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, _) in enumerate(lat.spans):
        starting[i].append(k)
    for i in range(n - 1, -1, -1):
        nxt = np.full(m, -np.inf)
        nxt[0] = o[i] + bwd[i + 1, 0]
        for k in starting[i]:
            nxt[1:] = np.logaddexp(nxt[1:], s[k, 1:] + bwd[lat.spans[k][1], 1:])
        bwd[i] = lse(t + nxt[None, :], axis=1)
    z = lse(fwd[n])
    gw, gt, score, label, at = np.zeros_like(w), np.zeros_like(t), 0.0, 0, 0
    ends = {i: (j, y) for (i, j), y in gold.items()}
    index = {span: k for k, span in enumerate(lat.spans)}
    while at < n:
        j, y = ends.get(at, (at + 1, 0))
        x = lat.x[index[at, j]] if y else lat.o[at]
        gw[y] += x
        gt[label, y] += 1
        score += w[y] @ x + t[label, y]
        label, at = y, j
    with np.errstate(invalid="ignore"):
        for j in range(1, n + 1):
            edge = fwd[j - 1] + t[:, 0] + o[j - 1] + bwd[j, 0] - z
            p = np.exp(edge)
            gt[:, 0] -= p
            gw[0] -= p.sum() * lat.o[j - 1]
        for k, (i, j) in enumerate(lat.spans):
            p = np.exp(fwd[i][:, None] + t[:, 1:] + s[k, 1:][None, :] + bwd[j, 1:][None, :] - z)
            gt[:, 1:] -= p
            gw[1:] -= p.sum(0)[:, None] * lat.x[k][None, :]
    return gw, gt, score - z


def examples(n: int = 420, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Texts with their entities, made by rule: mail addresses, dotted quads, cards and telephone numbers in several
    writings, and numbers that are none of these (failing check digits, versions, dates and times, book numbers, pages,
    thousands, accounts, counts, coordinates, long hexadecimal keys)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    area = lambda: "0" + r.choice("123456789")

    def card(ok: bool, k: int = 16) -> str:
        while luhn(d := digits(k)) != ok:
            pass
        return d

    def book() -> str:
        d = r.choice(("978", "979")) + digits(9)
        d += str(-sum(int(c) * (1 + 2 * (k & 1)) for k, c in enumerate(d)) % 10)
        return r.choice([d, f"{d[:3]}-{d[3]}-{d[4:6]}-{d[6:12]}-{d[12]}", f"{d[:3]} {d[3]} {d[4:8]} {d[8:12]} {d[12]}"])

    def date() -> str:
        y, m, d = str(r.randint(1900, 2030)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"
        return r.choice([f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}"])

    def clock() -> str:
        h, m = f"{r.randint(0, 23):02d}", f"{r.randint(0, 59):02d}"
        return r.choice([h, f"{h}.{m}", f"{h}:{m}", f"{h}:{m}:{r.randint(10, 59)}"])

    def pages() -> str:
        a = r.randint(1, 900)
        return f"{a}-{a + r.randint(1, 60)}"

    def entity(kind: str) -> str:
        if kind == "email":
            return f"{word()}{r.choice(['', '.', '_'])}{digits(2)}@{word()}{r.choice(['', digits(1)])}.{word()}.{r.choice(['com', 'org', 'net'])}"
        if kind == "ip":
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = card(True)
            return d if r.random() < 0.6 else r.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        pairs = [area(), *(digits(2) for _ in range(4))]
        world = [f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{r.randint(30, 99)} {r.randint(1, 9)} {' '.join(pairs[1:])}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}"]
        home = [f"{area()}{digits(1)} {digits(7)}", f"00{r.randint(30, 99)} {digits(2)} {digits(7)}", f"{area()}{digits(3)} {digits(6)}", " ".join(pairs), "-".join(pairs), f"{area()}{digits(2)}/{digits(7)}", "".join(pairs)]
        return r.choice(world if r.random() < 0.5 else home)

    def count() -> str:
        a = r.randint(1, 20)
        return " ".join(str(x) for x in range(a, a + r.randint(6, 10)))

    def none() -> str:
        return r.choice(
            [
                lambda: card(False),
                lambda: r.choice("123456789") + digits(r.choice((6, 7, 8, 10, 11))),
                lambda: date(),
                lambda: f"{date()} {clock()}",
                lambda: f"{date()} {r.choice(['', '- ', 'a '])}{date()}",
                lambda: book(),
                lambda: book(),
                lambda: " ".join(pages() for _ in range(r.randint(2, 3))),
                lambda: r.choice(" .").join([r.choice("123456789"), digits(3), digits(3), digits(3)]),
                lambda: r.choice(" .").join([str(r.randint(10, 999)), digits(3), digits(3)]),
                lambda: f"{''.join(r.choice('ABDEFGLT') for _ in range(2))}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
                lambda: count(),
                lambda: " ".join(str(r.randint(0, 99)) for _ in range(r.randint(5, 9))),
                lambda: " ".join(digits(1) for _ in range(r.randint(7, 12))),
                lambda: f"{r.randint(10, 60)}.{digits(4)} {r.randint(10, 99)}.{digits(4)}",
                lambda: f"20{digits(2)}/{digits(6)}",
                lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"',
                lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)),
                lambda: f"{digits(4)}.{digits(4)}",
                lambda: f"@{word()}",
                lambda: f"{digits(5)} {digits(5)} {digits(3)}",
            ]
        )()

    out = []
    for k in range(n):
        text, spans = f"{word()} {word()} ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.6:
                kind = KINDS[k % 4] if r.random() < 0.5 else r.choice(KINDS)
                s = entity(kind)
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = none()
            text += s + r.choice([" ", ". ", ", ", "\n"]) + word() + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(epochs: int = 30, rate: float = 0.3) -> tuple[tuple, tuple]:
    """Weights of spans and of label pairs, by Adam on the likelihood of `examples`, in one fixed order and smaller and smaller steps."""
    data = []
    for text, spans in examples():
        lat = Lattice(text, 0, len(text))
        starts, ends = {a: k for k, (a, _) in enumerate(lat.tokens)}, {b: k + 1 for k, (_, b) in enumerate(lat.tokens)}
        gold = {(starts[a], ends[b]): LABELS.index(kind) for kind, a, b in spans}
        data.append((lat, {k: y for k, y in gold.items() if k in set(lat.spans)}))
    shape = len(LABELS) * N_FEATURES
    v = np.zeros(shape + len(LABELS) ** 2)
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    step, steps = 0, 1 + epochs * -(-len(data) // 16)
    for _ in range(epochs):
        for at in range(0, len(data), 16):
            g, part = np.zeros_like(v), data[at : at + 16]
            for lat, gold in part:
                gw, gt, _ = _gradient(lat, gold, v[:shape].reshape(len(LABELS), -1), v[shape:].reshape(len(LABELS), -1))
                g += np.concatenate([gw.ravel(), gt.ravel()])
            g = g / len(part) - 0.0003 * v
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            v += rate * (1 - step / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return tuple(v[:shape].tolist()), tuple(v[shape:].tolist())


def weights() -> tuple[np.ndarray, np.ndarray]:
    w, t = trained()
    return np.array(w).reshape(len(LABELS), -1), np.array(t).reshape(len(LABELS), -1)


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """From the first to the last sign of each group that may hold a candidate; a gap over MAX_CHARS parts groups."""
    a = b = None
    digits, mail = 0, False
    for m in _SIGNS.finditer(text):
        if b is not None and m.start() - b > MAX_CHARS:
            if mail or digits >= MIN_DIGITS:
                yield a, b
            a, digits, mail = None, 0, False
        if a is None:
            a = m.start()
        b = m.end()
        digits += len(m[0]) - m[0].count("@")
        mail = mail or "@" in m[0]
    if mail or digits >= MIN_DIGITS:
        yield a, b


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Whole tokens that hold all candidate spans, cut where other text is certain.

    A candidate has a sign of its stretch and at most MAX_CHARS characters, so the token that holds the MAX_CHARS-th place
    after the stretch, and all before the window, are in none."""
    start = end = None
    for a, b in _stretches(text):
        x, y = max(0, a - MAX_CHARS), min(len(text), b + MAX_CHARS)
        while x and _TOKEN.match(text, x - 1, x + 1).end() > x:
            x -= 1
        y = _TOKEN.match(text, y - 1).end()
        if end is not None and x < end:
            end = max(end, y)
            continue
        if end is not None:
            yield start, end
        start, end = x, y
    if end is not None:
        yield start, end


def find(text: str | None, w: np.ndarray, t: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    if not _SIGNS.search(text):
        return base, base
    out = list(base)
    for a, b in windows(text):
        lat = Lattice(text, a, b)
        taken = [(x, y) for _, x, y in base if x < b and y > a]
        out += [s for s in decode(lat, w, t) if not any(x < s[2] and s[1] < y for x, y in taken)]
    return base, sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, and all spans, for each row."""
    w, t = weights()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(x, w, t) for x in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, pa.array([_joined(x) for _, x in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df with personal data masked in its text; every row and column stays."""
    w, t = weights()
    place = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x if not x or not (s := find(x, w, t)[1]) else mask(x, s) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(rows, df.schema)
