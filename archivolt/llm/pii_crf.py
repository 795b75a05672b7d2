"""Personal data: plain patterns, and a linear-chain CRF over word shapes, decoded by Viterbi in numpy batches."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from archivolt.llm.common import Words, packed, slices, texts_of

KINDS = ["email", "ip", "card", "phone"]
#: O, then begin and inside of each kind.
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL_HERE.pattern)
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def is_card(run: str) -> bool:
    digits = re.sub(r"[^0-9]", "", run)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_ip(run: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in run.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns by kind, then start; each kind leftmost without overlap, in linear time."""
    out = []
    if "@" in text:
        # A start lies at the head of a run of name characters, or where a match just before it ended.
        at = 0
        while m := (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL.search(text, at):
            out.append(("email", m.start(), m.end()))
            at = m.end()
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if is_ip(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and is_card(m[0])]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The labelled table


@dataclass(frozen=True)
class Training:
    """made: lines made from a grammar beside those of the labelled file; rows: the bound on lines that fit() reads."""

    made: int = 500
    rows: int = 1000
    seed: int = 7
    passes: int = 80
    rate: float = 0.15
    l2: float = 1e-4


_MARKED = re.compile(r"\{(email|ip|card|phone):((?:[^{}]|\{[^{}]*\})+)\}")


def read_lines(path: str | Path) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each line of a labelled file, in which personal data stand as {kind:text}."""
    out = []
    for line in Path(path).read_text().splitlines():
        words, labels, at = [], [], 0
        for m in [*_MARKED.finditer(line), None]:
            plain = line[at : m.start() if m else len(line)].split()
            words, labels = words + plain, labels + ["O"] * len(plain)
            if m:
                inside = m[2].split()
                words, labels, at = words + inside, labels + [f"B-{m[1]}", *[f"I-{m[1]}"] * (len(inside) - 1)], m.end()
        out.append((words, labels))
    return out


def labelled_lines(p: Training = Training()) -> list[tuple[list[str], list[str]]]:
    """The small labelled table, (words, labels) per line: the lines of labelled.txt, and p.made lines of invented words."""
    return read_lines(Path(__file__).with_name("labelled.txt")) * 2 + made_lines(p)


def made_lines(p: Training) -> list[tuple[list[str], list[str]]]:
    """Invented words with personal data in plain and in veiled spellings, and with numbers and marks that are none."""
    r = random.Random(p.seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sch", "ung", "eau", "ción", "é", "ß"]
    word = lambda: "".join(r.choices(parts, k=r.choice((1, 1, 2, 2, 3, 4))))
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    name = lambda: r.choice([word(), f"{word()}.{digits(2)}", f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}"])
    host = lambda: r.choice([f"mail{digits(1)}", word(), f"{word()}-{word()}"])
    top = lambda: r.choice(["com", "org", "net", "example", "de", "io"])

    def card() -> list[str]:
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([[d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join((d[:4], d[4:8], d[8:12], d[12:]))], [".".join((d[:4], d[4:8], d[8:12], d[12:]))], ["/".join((d[:4], d[4:8], d[8:12], d[12:]))]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([[f"+{digits(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"({a}){b}-{c}"], [f"+{digits(2)}", a, b, c], [f"{a}.{b}.{c}"], [f"+{digits(11)}"], [f"(0{digits(2)})", digits(4), digits(4)], [f"0{digits(3)}", digits(3), digits(4)], [f"0{digits(2)}-{digits(4)}", digits(4)], [a, b, c], [f"0{digits(1)}", *(digits(2) for _ in range(4))]])

    def email() -> list[str]:
        n, h, t = name(), host(), top()
        at, dot = r.choice([("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)"), ("AT", "DOT"), ("{at}", "{dot}"), ("<at>", "<dot>")])
        return r.choice([[f"{n}@{h}.{t}"], [f"{n}@{h}.{word()}.{t}"], [n, at, h, dot, t], [n, at, f"{h}.{t}"] if at[0] in "[({<" else [n, at, h, dot, t], [f"{n}{at}{h}{dot}{t}"] if at[0] in "[({<" else [n, at, h, dot, t]])

    made = {"email": email, "ip": lambda: [r.choice((".", ".", "[.]", "(.)", "[dot]")).join(str(r.randrange(256)) for _ in range(4))], "card": card, "phone": phone}
    none = [
        lambda: [digits(r.choice((1, 2, 3, 4, 5, 6, 7, 8, 10, 12)))], lambda: [f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"], lambda: [f"{digits(1)}.{digits(1)}.{digits(1)}"],
        lambda: [f"${digits(2)}.{digits(2)}"], lambda: [f"{digits(2)}:{digits(2)}"], lambda: ["".join(r.choices("0123456789abcdef", k=r.choice((8, 16, 32, 40))))], lambda: [f"AKIA{digits(2)}{word().upper()}{digits(4)}"],
        lambda: ["token", "=", f'"{digits(12)}ab{digits(9)}"'], lambda: [f"password={digits(3)}fa{digits(5)}"], lambda: ["|", word(), "|"], lambda: [word().upper() + "!!"], lambda: [word() + "###", word() + "$$$"],
        lambda: [word(), "at", word(), word()], lambda: [word(), "dot", word()], lambda: ["at", "the", "dot"], lambda: [f"{digits(1)},{digits(3)}"], lambda: [f"{digits(2)}/{digits(2)}/{digits(4)}"], lambda: ["GPL-3.0"], lambda: [f"#{digits(5)}"], lambda: ["at", word() + ".", "the"],
    ]
    out = []
    for i in range(p.made):
        words, labels = [], []
        for _ in range(r.randrange(1, 4)):
            n = r.randrange(0, 9)
            words += [word() + r.choice(("", "", "", ",", ".")) for _ in range(n)]
            labels += ["O"] * n
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                got = made[kind]()
                labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
                if r.random() < 0.25:
                    got = [*got[:-1], got[-1] + r.choice((",", ".", "###", "$$$", "&&&", "%%%"))]
            else:
                got = r.choice(none)()
                labels += ["O"] * len(got)
            words += got
        out.append((words, labels))
    return out


# Features


#: Fixed list: words that say what stands beside them.
LEXICON = ["at", "dot", "email", "e-mail", "mail", "phone", "tel", "fax", "mobile", "call", "card", "visa", "ip", "address", "com", "org", "net", "example"]
_STRIP = " !\"'(),.:;<>?[]{}|#$%&*=/"


def shapes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The shape of each word as a code, and the distinct shapes: letters as X, x and u, runs of them as one; digits as 0, one
    for each up to 20; other signs as they are, four or more in a row as ***. A word of the lexicon is added after a blank."""
    s = words
    for pattern, to in (("[A-Z]+", "X"), ("[a-wyz]", "x"), ("x+", "x"), ("[^\\x00-\\x7f]+", "u"), ("[1-9]", "0"), ("0{20,}", "0" * 20), ("[-_.=*#$%&!|~]{4,}", "***")):
        s = pc.replace_substring_regex(s, pattern, to)
    known = pc.index_in(pc.ascii_lower(pc.ascii_trim(words, _STRIP)), pa.array(LEXICON))
    known = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
    encoded = s.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(LEXICON) + 1) + known + 1
    distinct, inverse = np.unique(codes, return_inverse=True)
    plain = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    names = [plain[c // (len(LEXICON) + 1)] + (f" {LEXICON[k - 1]}" if (k := c % (len(LEXICON) + 1)) else "") for c in distinct.tolist()]
    return inverse, names


def features(shape: str) -> list[str]:
    """The features of a shape, used for the word and for those beside it."""
    plain, _, word = shape.partition(" ")
    core = plain.strip(_STRIP)
    short = re.sub(r"0+", "0", plain)
    zeros = plain.count("0")
    runs = [len(x) for x in re.findall(r"0+", core)]
    out = [f"short={short[:12]}", f"core={re.sub(r'0+', '0', core)[:12]}", f"zeros={min(zeros, 20)}", f"runs={','.join(map(str, runs[:5]))}", f"first={plain[:1]}", f"last={plain[-1:]}"]
    if word:
        bracketed = plain[:1] in "[({<" or core[:1] == "X"
        out += [f"word={word}", f"word={word}{'+' * bracketed}"]
    for sign in "@.-/+(|=":
        if sign in core:
            out.append(f"has={sign}{min(core.count(sign), 4)}")
    if re.search(r"[\[({<]x[\])}>]", plain[1:-1]):
        out.append("veiled")
    if not zeros and re.fullmatch(r"[Xxu]*", core):
        out.append("letters")
    return out


@dataclass
class Model:
    """A linear-chain CRF. weight: {feature: scores} for the word, the one before and the one after; transition[i, j]."""

    index: dict[str, int]
    weight: np.ndarray  # (3, features, labels)
    transition: np.ndarray
    start: np.ndarray

    def slack(self, score: np.ndarray) -> tuple[float, int]:
        """(D, reach): D is the most that a transition or the start gains on staying O. A word whose labels all lose more
        than 2 D to O is dead. Putting O into k dead words in a row gains more than (k - 1) D and costs at most
        three transitions and the change of one label after it, so no entity spans more than reach dead words."""
        t, s = self.transition[allowed()] - self.transition[0, 0], self.start[self.start > -1e3] - self.start[0]
        d = float(max(t.max(), s.max(), 0.1)) + 1e-3
        cost = 3 * float(max(np.abs(t).max(), np.abs(s).max())) + float(sum((x.max(axis=1) - x.min(axis=1)).max() for x in score))
        return d, int((cost + d) / d) + 2

    def scores(self, names: list[str]) -> np.ndarray:
        """(3, shapes, labels): what a shape adds to the word itself, the next word and the word before."""
        out = np.zeros((3, len(names), len(LABELS)), np.float32)
        for i, name in enumerate(names):
            if known := [self.index[f] for f in features(name) if f in self.index]:
                out[:, i] = self.weight[:, known].sum(axis=1)
        return out


def allowed() -> np.ndarray:
    """Transitions that the labels permit: inside a kind only after that kind."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            ok[:, j] = [a != "O" and a[2:] == to[2:] for a in LABELS]
    return ok


def fit(lines: list[tuple[list[str], list[str]]], p: Training = Training()) -> Model:
    """The CRF of greatest penalised likelihood, by Adam on the whole table; the expectations come from forward and backward sums."""
    lines = [x for x in lines[: p.rows] if x[0]]
    flat = pa.array([w for words, _ in lines for w in words], pa.string())
    code, names = shapes(flat)
    feats = [features(n) for n in names]
    index = {f: i for i, f in enumerate(dict.fromkeys(f for x in feats for f in x))}
    has = np.zeros((len(names), len(index)), np.float64)
    for i, x in enumerate(feats):
        has[i, [index[f] for f in x]] = 1
    n_lines, longest = len(lines), max(len(w) for w, _ in lines)
    size = np.array([len(w) for w, _ in lines])
    grid = np.full((n_lines, longest), -1)
    gold = np.zeros((n_lines, longest), np.int64)
    at = 0
    for i, (words, labels) in enumerate(lines):
        grid[i, : len(words)] = code[at : at + len(words)]
        gold[i, : len(words)] = [LABELS.index(x) for x in labels]
        at += len(words)
    real = grid >= 0
    k = len(LABELS)
    ban = np.where(allowed(), 0.0, -1e4)
    first_ban = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
    theta = {"w": np.zeros((3, len(index), k)), "t": np.zeros((k, k)), "s": np.zeros(k)}
    moment = {x: (np.zeros_like(v), np.zeros_like(v)) for x, v in theta.items()}
    onehot = np.eye(k)[gold] * real[..., None]

    for step in range(1, p.passes + 1):
        per = (has @ theta["w"].transpose(1, 0, 2).reshape(len(index), -1)).reshape(len(names), 3, k).transpose(1, 0, 2)
        e = np.where(real[..., None], per[0][grid], 0.0)
        e[:, 1:] += np.where(real[:, 1:, None], per[1][grid[:, :-1]], 0.0)
        e[:, :-1] += np.where(real[:, 1:, None], per[2][grid[:, 1:]], 0.0)
        score = np.exp(e - e.max(axis=2, keepdims=True))
        trans = np.exp(np.minimum(theta["t"] + ban, 50))
        a, b = np.zeros((n_lines, longest, k)), np.ones((n_lines, longest, k))  # each step scaled to a sum of 1
        a[:, 0] = score[:, 0] * np.exp(theta["s"] + first_ban)
        a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            new = (a[:, t - 1] @ trans) * score[:, t]
            a[:, t] = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = (score[:, t + 1] * b[:, t + 1]) @ trans.T
            b[:, t] = np.where(real[:, t + 1, None], new / new.sum(axis=1, keepdims=True), 1.0)
        mass = a * b * real[..., None]
        mass /= np.maximum(mass.sum(axis=2, keepdims=True), 1e-300)
        diff = onehot - mass
        grad = {"w": np.zeros_like(theta["w"]), "t": np.zeros((k, k)), "s": diff[:, 0].sum(axis=0)}
        for pos, (g, d) in enumerate(((grid, diff), (grid[:, :-1], diff[:, 1:]), (grid[:, 1:], diff[:, :-1]))):
            by_shape = np.zeros((len(names), k))
            ok = g >= 0
            if pos == 1:
                ok &= real[:, 1:]
            np.add.at(by_shape, g[ok], d[ok])
            grad["w"][pos] = has.T @ by_shape
        onward = score[:, 1:] * b[:, 1:]
        both = np.einsum("nti,ij,ntj->nt", a[:, :-1], trans, onward, optimize=True)
        onward = onward * np.where(real[:, 1:], 1 / np.maximum(both, 1e-300), 0.0)[..., None]
        pair = trans * (a[:, :-1].reshape(-1, k).T @ onward.reshape(-1, k))
        grad["t"] = onehot[:, :-1].reshape(-1, k).T @ onehot[:, 1:].reshape(-1, k) - pair
        for x, g in grad.items():
            g = g / n_lines - p.l2 * theta[x]
            m, v = moment[x]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            theta[x] += p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(index, theta["w"].astype(np.float32), (theta["t"] + ban).astype(np.float32), (theta["s"] + first_ban).astype(np.float32))


def viterbi(model: Model, emission: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best label of each word; emission: (words, labels) of lines one after another, counts: their words. All
    lines go forward together, the longest first, so each step is a few array operations."""
    labels = np.zeros(len(emission), np.uint8)
    order = np.argsort(-counts, kind="stable")
    ranked = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    longest = int(ranked[0]) if len(ranked) else 0
    live = len(ranked) - np.searchsorted(ranked[::-1], np.arange(longest), side="right")
    back = np.zeros((len(emission), len(LABELS)), np.uint8)
    best = np.zeros((len(ranked), len(LABELS)), np.float32)
    to = np.ascontiguousarray(model.transition.T)
    for t in range(longest):
        n = int(live[t])
        if t == 0:
            best[:n] = model.start + emission[start[:n]]
            continue
        paths = best[:n, None, :] + to
        came = paths.argmax(axis=2)
        back[start[:n] + t] = came
        best[:n] = paths.max(axis=2) + emission[start[:n] + t]
    last = best.argmax(axis=1).astype(np.uint8)
    for t in range(longest - 1, -1, -1):
        n = int(live[t])
        at = start[:n] + t
        labels[at] = last[:n]
        if t:
            last[:n] = back[at, last[:n]]
    return labels


_VEILED = re.compile(r"[A-Za-z0-9._%+-]+\s*[\[({<]?\s*at\s*[\])}>]?\s*[A-Za-z0-9-]+(\s*([\[({<]?\s*dot\s*[\])}>]?|\.)\s*[A-Za-z0-9-]+)+", re.I | re.A)
_DOT = r"\s*(?:[\[({]\s*(?:\.|dot)\s*[\])}]|\.|\bdot\b)\s*"
_VEILED_IP = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I)
_NUMBERS = re.compile(r"[0-9]+")


def accepts(kind: str, run: str) -> bool:
    """Whether a run that the model labelled can be what it says: a bound on shapes, not a pattern of what is looked for."""
    digits = sum("0" <= c <= "9" for c in run)
    if kind == "email":
        return "@" in run and "." in run.partition("@")[2] or _VEILED.fullmatch(run) is not None
    if kind == "card":
        return is_card(run)
    if kind == "ip":
        return _VEILED_IP.fullmatch(run) is not None and all(int(x) <= 255 for x in _NUMBERS.findall(run))
    return 9 <= digits <= 15 and re.fullmatch(r"\+?[0-9()][0-9()./\s-]+[0-9]", run) is not None and re.search(r"[^0-9]", run) is not None and not is_ip_like(run)


def is_ip_like(run: str) -> bool:
    return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", run) is not None


def model_spans(model: Model, texts: pa.Array, cache: dict[str, np.ndarray]) -> list[list[tuple[str, int, int]]]:
    """Per text the spans that the model labels and accepts() lets through, in code points. Lines are its sequences."""
    lines = pc.split_pattern(texts, "\n")
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = lines.flatten()
    words = Words(flat)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    if not len(words.codes):
        return out
    by_word, names = shapes(words.dictionary)
    if len(cache) > 200_000:
        cache.clear()
    new = [n for n in names if n not in cache]
    if new:
        scored = model.scores(new)
        cache.update((n, scored[:, i]) for i, n in enumerate(new))
    score = np.stack([cache[n] for n in names], axis=1)
    code = by_word[words.codes]
    inner = words.doc[1:] == words.doc[:-1]
    gain = (score[:, :, 1:].max(axis=2) - score[:, :, 0]).astype(np.float64)
    bound = gain[0][code]
    bound[1:] += np.where(inner, gain[1][code[:-1]], 0)
    bound[:-1] += np.where(inner, gain[2][code[1:]], 0)
    labels = np.zeros(len(words.codes), np.uint8)
    slack, reach = model.slack(score)
    live = np.flatnonzero(bound > -2 * slack)
    if not len(live):
        return out
    # Words further than reach from any live word of their line are O on the best path; only the others are decoded.
    at, doc = np.arange(len(code)), words.doc
    before = live[np.maximum(np.searchsorted(live, at, side="right") - 1, 0)]
    after = live[np.minimum(np.searchsorted(live, at), len(live) - 1)]
    near = ((doc[before] == doc) & (np.abs(at - before) <= reach)) | ((doc[after] == doc) & (np.abs(after - at) <= reach))
    some = np.flatnonzero(near)
    emission = score[0][code[some]]
    begins, ends = np.ones(len(code), bool), np.ones(len(code), bool)  # of lines
    begins[1:], ends[:-1] = ~inner, ~inner
    emission += np.where(begins[some, None], 0, score[1][code[some - 1]])
    emission += np.where(ends[some, None], 0, score[2][code[np.minimum(some + 1, len(code) - 1)]])
    head = np.ones(len(some), bool)
    head[1:] = (some[1:] != some[:-1] + 1) | (doc[some[1:]] != doc[some[:-1]])
    tail = np.append(head[1:], True)
    emission[(head & ~begins[some]) | (tail & ~ends[some]), 1:] = -1e4  # where a line was cut, O is known
    first = np.flatnonzero(head)
    labels[some] = viterbi(model, emission, np.diff(np.append(first, len(some))))
    hits = np.flatnonzero(labels)
    if not len(hits):
        return out
    chars = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    first_line = np.searchsorted(of, np.arange(len(texts)))
    for line in np.unique(words.doc[hits]).tolist():
        text = flat[line].as_py()
        base = int(chars[line] - chars[first_line[of[line]]])
        got = labels[words.starts[line] : words.starts[line] + words.counts[line]].tolist()
        places = [m.span() for m in _WORD.finditer(text)]
        i = 0
        while i < len(got):
            if got[i] == 0:
                i += 1
                continue
            kind, j = LABELS[got[i]][2:], i + 1
            while j < len(got) and LABELS[got[j]] == f"I-{kind}":
                j += 1
            first, last = i, j
            while kind != "email" and last - first > 1 and not _DIGIT.search(text, *places[last - 1]):
                last -= 1  # a word without a digit is no end of a number
            while kind != "email" and last - first > 1 and not _DIGIT.search(text, *places[first]):
                first += 1
            a, b = places[first][0], places[last - 1][1]
            core = text[a:b]
            lead = len(core) - len(core.lstrip("\"'<[{,.:;#$%&*|=" + ("(" if kind != "phone" else "")))
            core = core.strip("\"'<>[]{},.:;#$%&*|=" + ("()" if kind != "phone" else ""))
            if core and accepts(kind, core):
                out[of[line]].append((kind, base + a + lead, base + a + lead + len(core)))
            i = j
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]


def _found(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text_at):
                texts = texts_of(part, text_at)
                cols = {f.name: [] for f in RESULT}
                added = model_spans(model, texts, cache)
                for text, more in zip(texts.to_numpy(zero_copy_only=False), added):
                    base = base_spans(text)
                    more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
                    for k in KINDS:
                        cols[f"n_{k}"].append(sum(s[0] == k for s in base))
                    cols["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
                    cols["spans"].append(joined(sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1]))))
                    cols["n_spans"].append(len(base) + len(more))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(v, t) for v, t in zip(cols.values(), kinds))], ["row", *cols])

    return run


def find_personal_data(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs packed as `row`, with n_email, n_ip, n_card, n_phone and base_sha256 of the plain patterns, and spans of both.

    spans: kind:start:end in code points, end exclusive, by kind, then start; n_spans: their number. The model adds what the
    patterns can't see: veiled addresses (name [at] host dot com; 192[.]0[.]2[.]1), phone numbers without a plus, cards with
    other separators. What it labels over a pattern's span is left to the pattern. Null and empty texts have no spans. Texts are
    taken whole, line by line; time is linear in their length. Repeated rows are searched each. Other columns stay in `row`,
    whatever their names; an empty table gives no rows. The model, by default fitted here on the labelled_lines(), is under 1 MB
    and goes to the executors with the code.
    """
    model = model or fit(labelled_lines())
    rows, at = packed(docs, text_col)
    return rows.mapInArrow(_found(model, at), T.StructType([rows.schema["row"], *RESULT]))
