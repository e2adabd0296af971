"""Personal data: four pattern kinds, and a linear-chain conditional random field that adds what patterns miss.

The field reads words by their shape (capital X, small x, digit d, other characters as they are) and by a few cue words
around them. It is trained from a small labelled table, in which `<kind>...</kind>` marks the spans, and decoded by
Viterbi in numpy: a text's tags are the best path through all its words. Blocks of BLOCK words are walked at once and then
joined, see blocks, however long the text.

Spans that the field finds are added only beside those of the patterns, and only if they hold what their kind needs
(`plausible`). Null texts count as empty and have no spans. Rows are judged one by one; repeated rows get equal results,
further columns are ignored, an empty table gives an empty result. Where spans of several kinds overlap all of them are
reported.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfold.llm.blocks import Blocks, settle, settle_back
from quillfold.llm.common import map_batches, table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BLOCK, FEATURES = 128, 4
MAX_CACHE = 300_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole, so that a match can only start where a run does: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An address in words, with single spaces: at and dot, in brackets or not.
_SPELLED = re.compile(r"\w ?(?:[\[({] ?at ?[\])}]| at ) ?\w[\w-]*(?: ?\. ?| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )\w", re.I)
_DATE = re.compile(r"\b(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}\b|\b[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}\b")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _part_fits(p: str) -> bool:
    return len(p := p.lstrip("0")) <= 3 and int(p or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def plausible(kind: int, s: str) -> bool:
    """What a span of the field must hold: no number is called a card that isn't one, and so on."""
    digits = _digits(s)
    if kind == 0:
        return "@" in s.strip("@") or bool(_SPELLED.search(" ".join(s.split())))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and len(digits) == len(re.sub(r"[.\s\[\]()]|dot", "", s)) and all(map(_part_fits, parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", s)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ()./-]+[0-9]", s)) and not re.search(r"[^0-9 ()./+-]", s) and not _DATE.search(s)


# --- the labelled table -------------------------------------------------------------------------------------------

_TEMPLATES = (
    "Please write to <email>{u}@{h}.example.org</email> before the end of the week.",
    "Contact: <email>{u}.{v}@{h}.example.com</email>, or visit the office.",
    "send it to <email>{u} (at) {h} (dot) org</email> and wait for the reply",
    "mail <email>{u} at {h} dot com</email> with any question",
    "e-mail: <email>{u} [at] {h} [dot] com</email> for the rest",
    "my address is <email>{u}[at]{h}[dot]net</email>, not the other one",
    "write to <email>{u}@{h} . com</email> and ask",
    "or <email>{u} @ {h}.org</email> if that fails",
    "reach <email>{u}(at){h}.example.org</email> at any time",
    "of the server <ip>{a}.{b}.{c}.{d}</ip> and the other one",
    "Blocked requests from <ip>{a}.{b}.{c}.{d}</ip>.",
    "host <ip>{a} . {b} . {c} . {d}</ip> did not answer",
    "IP: <ip>{a}[.]{b}[.]{c}[.]{d}</ip> was seen again",
    "traffic to <ip>{a}[.]{b}[.]{c}[.]{d}</ip> is blocked",
    "the address <ip>{a}(.){b}(.){c}(.){d}</ip> was banned",
    "ip <ip>{a} dot {b} dot {c} dot {d}</ip> in words",
    "from <ip>{a}[dot]{b}[dot]{c}[dot]{d}</ip> on that day",
    "paid by card <card>{card4}</card> on the same day",
    "The number <card>{card}</card> was declined by the bank.",
    "visa <card>{cardd}</card> expires soon",
    "card no. <card>{card_}</card> of the client",
    "card <card>{cards}</card> was charged twice",
    "Her credit card {e} <card>{card4}</card> and the code {e} are known",
    "cards <card>{card}</card> <card>{card}</card> were sold together",
    "by card <card>{card4}</card> {e} on that day",
    "charged to <card>{card4}</card> {f} {e} again",
    "Call <phone>+1 ({e}) 555-{f}</phone> for the details",
    "Telephone <phone>({e}) 555-{f}</phone>, mornings only.",
    "phone: <phone>{e}-555-{f}</phone> or ask at the desk",
    "tel <phone>+44 20 7946 0{e}</phone> and leave a message",
    "reach us on <phone>0{e} {f} {e}</phone> after six",
    "my number is <phone>020 {f} {f}</phone> so call me",
    "his number is <phone>0{e} {e} {f}</phone>.",
    "You can call <phone>{e}.{e}.{f}</phone> today",
    "fax <phone>0049 30 {f} {e}</phone> or come by",
    "mobile: <phone>07{e} {e}{e}</phone> at night",
    "ring <phone>0{e}/{f}{e}</phone> and ask for the owner",
    "you can phone <phone>{e}-{e}-{f}</phone> or write",
    "Tel <phone>0{g}0/{f}{e}</phone> and so on",
    "Tel.: <phone>0{e} - {f}{e}</phone> in the evening",
    "text <phone>{e} {e} {f}</phone> to win",
    "the invoice of {e}.{b} euro was sent on {a}.{c}.2024 to the client",
    "version {a}.{b}.{c} of the tool, released 2024-0{g}-1{g}, is on page {f}",
    "release {a}.{b}.{c}.{d} build {f} of the program",
    "on 2023-1{x}-0{g} {f} people and on 0{g}.1{x}.2022 {e} more",
    "order {f}{e} has {a} items at {b},{c} each",
    "order number {f} {f} {f} was shipped",
    "the total was {e} {e} {e} in that year, of {f} {f} in all",
    "part {e}-{f}-{e} is out of stock",
    "isbn 978-{g}-{f}-{e}-{g} of the book",
    "between {f} and {f} there were {e}",
    "token = \"{hexa}\" must never be shared",
    "chapter {g} of the book, with {e} pages and {b} plates",
    "he sat at home and drew a dot on the page at noon",
    "it was in the morning and the rain did not stop at the house",
    "der Mann und die Frau gehen in das Haus am See",
    "la maison est dans la ville et le chat dort",
    "el hombre y la mujer van a la casa del lago",
    "THE SALE!! ENDS!! TODAY!! at {a}:{b} o'clock",
    "a### strange$$$ line%%% with&&& marks*** and {e} more",
    "one | two | three | {a} | {b} | end",
    "see http://www.{h}.example.com/{u}/{f}?page={g} for more",
    "{f} {e} people came, {b}% of them by train",
    "sections {a}-{b} and {c}-{d} of the act",
)


def _with_luhn(digits: str) -> str:
    return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))


def labelled_rows(copies: int = 8) -> list[tuple[str]]:
    """The default labelled table, made from templates by rule."""
    out = []
    for i, template in enumerate(_TEMPLATES):
        for j in range(copies):
            h = hashlib.sha256(f"{i}:{j}".encode()).hexdigest()
            n = [int(h[k : k + 4], 16) for k in range(0, 60, 4)]
            name = lambda k: "".join("aeioulnrst"[int(c, 16) % 10] for c in h[k : k + 5 + n[k] % 4])  # noqa: B023, E731
            card = _with_luhn("4" + "".join(str(x % 10) for x in n[:14]))
            values = {"u": name(3), "v": name(8), "h": name(2), "a": n[0] % 256, "b": n[1] % 256, "c": n[2] % 256, "d": n[3] % 256, "e": 100 + n[4] % 900, "f": 1000 + n[5] % 9000, "g": 1 + n[6] % 9, "x": n[7] % 3, "hexa": h[:40]}
            values |= {"card": card} | {name: by.join(card[k : k + 4] for k in (0, 4, 8, 12)) for name, by in (("card4", " "), ("cardd", "-"), ("card_", "."), ("cards", "/"))}
            out.append((template.format(**values),))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "marked string")


# --- features -----------------------------------------------------------------------------------------------------

_CUES = (
    "at", "(at)", "[at]", "dot", "(dot)", "[dot]", "@", ".", "call", "phone", "phone:", "tel", "tel.:", "telephone", "fax", "mobile", "ring", "text", "card", "cards", "visa", "number", "is", "no", "mail", "e-mail", "contact", "write",
    "ip", "address", "host", "server", "version", "release", "build", "order", "part", "isbn", "token", "=", "euro", "total", "of",
)


_LETTERS = "c:010000000"
_DIGITS, _SMALL, _CAPITAL, _RUN = str.maketrans("0123456789", "d" * 10), re.compile("[a-z]"), re.compile("[A-Z]"), re.compile(r"(.)\1{4,}", re.S)
_EQUAL, _ONE = re.compile(r"(.)\1+", re.S), r"\1"


def shape(word: str) -> str:
    """Runs of more than four equal signs are cut to four; other alphabets count by their case."""
    if word.isascii():
        word = _CAPITAL.sub("X", _SMALL.sub("x", word)).translate(_DIGITS)
    else:
        word = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1\1\1\1", word)


def coarse(word: str) -> str:
    has = [bool(re.search(p, word)) for p in (r"[0-9]", r"[^\W\d_]", r"@", r"\+", r"\.[^.]", r"[()]", r"-", r"[#$%&*|\"=/:_]")]
    n = sum("0" <= c <= "9" for c in word)
    return "".join("01"[x] for x in has) + str(min(n, 8) if n < 13 else 9)


def features(word: str) -> tuple[str, ...]:
    """Its shape, that with runs of equal signs as one, what it has at all, and the cue word that it is."""
    low = word.lower()
    plain, mark = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
    if plain.isalpha() and plain[1:].islower() and len(plain) > 5:  # most words: what follows gives the same, slower
        head = "X" if plain[0].isupper() else "x"
        cue = low.strip(",.")
        return f"s:{'xxxx' if head == 'x' else 'Xxxxx'}{mark}", f"r:{'x' if head == 'x' else 'Xx'}{mark}", _LETTERS, f"w:{cue if cue in _CUES else ''}"
    cue = low.strip(",.") if low.strip(",.") in _CUES else low if low in _CUES else ""
    s = shape(word)
    return f"s:{s}", f"r:{_EQUAL.sub(_ONE, s)}", f"c:{coarse(word)}", f"w:{cue}"


class Field:
    """Weights of the field: emission by a word's own, previous and next word's features, and transitions."""

    def __init__(self, names: dict[str, int], own: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.names, self.own, self.before, self.after, self.move, self.first = names, own, before, after, move, first

    def rows(self, words: list[str]) -> np.ndarray:
        """Features of words as numbers, 0 for those that training has not seen."""
        return np.array([[self.names.get(f, 0) for f in features(w)] for w in words], np.int64).reshape(-1, FEATURES)


def _emission(field: Field, seq: np.ndarray) -> np.ndarray:
    """seq: [sequences, words, features]; 0 beyond either end."""
    own = field.own[seq].sum(2)
    own[:, 1:] += field.before[seq[:, :-1]].sum(2)
    own[:, :-1] += field.after[seq[:, 1:]].sum(2)
    return own


def slopes(field: Field, seq: np.ndarray, gold: np.ndarray, live: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log likelihood of the gold tags of all sequences, and its slopes by each of the field's weights.

    seq: [sequences, words, features], gold: [sequences, words] tags, live: where there are words.
    """
    n, t, k = *gold.shape, len(field.first)
    row, weights = np.arange(n), (field.own, field.before, field.after, field.move, field.first)
    emit = np.where(live[:, :, None], _emission(field, seq), 0.0)
    move = field.move
    alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
    alpha[:, 0] = field.first + emit[:, 0]
    for j in range(1, t):
        top = alpha[:, j - 1].max(1, keepdims=True)
        nxt = np.log(np.exp(alpha[:, j - 1] - top) @ np.exp(move) + 1e-300) + top + emit[:, j]
        alpha[:, j] = np.where(live[:, j, None], nxt, alpha[:, j - 1])
    for j in range(t - 2, -1, -1):
        x = beta[:, j + 1] + emit[:, j + 1]
        top = x.max(1, keepdims=True)
        nxt = np.log(np.exp(x - top) @ np.exp(move).T + 1e-300) + top
        beta[:, j] = np.where(live[:, j + 1, None], nxt, 0.0)
    log_z = np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(1, keepdims=True)).sum(1)) + alpha[:, -1].max(1)
    here, words = row[:, None].repeat(t, 1)[live], np.arange(t)[None].repeat(n, 0)[live]
    both = live[:, 1:]
    likely = emit[here, words, gold[live]].sum() + field.first[gold[:, 0]].sum() + move[gold[:, :-1][both], gold[:, 1:][both]].sum() - log_z.sum()
    g_node = -np.exp(alpha + beta - log_z[:, None, None]) * live[:, :, None]
    np.add.at(g_node, (here, words, gold[live]), 1.0)
    grads = [np.zeros_like(w) for w in weights]
    for f in range(seq.shape[2]):
        np.add.at(grads[0], seq[:, :, f][live], g_node[live])
        np.add.at(grads[1], seq[:, :-1, f][both], g_node[:, 1:][both])
        np.add.at(grads[2], seq[:, 1:, f][both], g_node[:, :-1][both])
    for j in range(1, t):
        on = live[:, j]
        if on.any():
            pair = np.exp(alpha[on, j - 1][:, :, None] + move[None] + (emit[on, j] + beta[on, j])[:, None, :] - log_z[on][:, None, None])
            grads[3] -= pair.sum(0)
            np.add.at(grads[3], (gold[on, j - 1], gold[on, j]), 1.0)
    grads[4] += g_node[:, 0].sum(0)
    return float(likely), grads


def train(labelled: DataFrame, max_rows: int = 2000, steps: int = 160, rate: float = 0.12, l2: float = 2e-4) -> Field:
    """Fits the field to the first max_rows rows, in order of their text, of the labelled table."""
    marked = [r[0] for r in labelled.select(F.col(labelled.columns[0])).where(F.col(labelled.columns[0]).isNotNull()).orderBy(labelled.columns[0]).limit(max_rows).collect()]
    sentences = []
    for line in marked:
        words, tags, kind = [], [], None
        for piece in re.split(r"(</?(?:%s)>)" % "|".join(KINDS), line):
            if m := re.fullmatch(r"<(/?)(\w+)>", piece):
                kind, begun = (None if m[1] else KINDS.index(m[2])), False
                continue
            for k, w in enumerate(_WORD.findall(piece)):
                if kind is None and k == 0 and tags and not piece[0].isspace() and words:
                    words[-1] += w  # a mark that follows a span without a space belongs to its last word
                    continue
                words.append(w)
                tags.append(0 if kind is None else 1 + 2 * kind + begun)
                if kind is not None:
                    begun = True
        if words:
            sentences.append((words, tags))
    names: dict[str, int] = {"": 0}
    for words, _ in sentences:
        for w in words:
            for f in features(w):
                names.setdefault(f, len(names))
    n, t, k = len(sentences), max((len(w) for w, _ in sentences), default=1), len(TAGS)
    seq, gold, live = np.zeros((n, t, FEATURES), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    blank = Field(names, *(np.zeros((len(names), k)) for _ in range(3)), np.zeros((k, k)), np.zeros(k))
    for i, (words, tags) in enumerate(sentences):
        seq[i, : len(words)], gold[i, : len(words)], live[i, : len(words)] = blank.rows(words), tags, True
    weights = [blank.own, blank.before, blank.after, blank.move, blank.first]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        _, grads = slopes(Field(names, *weights), seq, gold, live)
        for i, g in enumerate(grads):
            g = g / max(n, 1) - l2 * weights[i]
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            weights[i] = weights[i] + rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    for w in weights[:3]:
        w[0] = 0.0
    return Field(names, *(w.astype(np.float32) for w in weights))


# --- decoding -----------------------------------------------------------------------------------------------------


def viterbi(emit: np.ndarray, move: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags of sequences of these sizes, whose scores, [word, tag], follow each other; ties go to the smaller tag."""
    r, k = Blocks(sizes, BLOCK), emit.shape[1]
    emit, into = r.laid(emit), np.ascontiguousarray(move.T)
    score, back, tags = np.empty_like(emit), np.empty(emit.shape, np.int8), np.empty(len(emit), np.int8)

    def step(cur: np.ndarray, at) -> tuple[np.ndarray, np.ndarray]:
        """Scores less their largest, and where each came from."""
        reach = cur[:, None, :] + into
        best = reach.argmax(2)
        new = np.take_along_axis(reach, best[:, :, None], 2)[:, :, 0] + emit[at]
        return new - new.max(1, keepdims=True), best

    for t, n in enumerate(r.live.tolist()):
        at = slice(r.begin[t], r.begin[t] + n)
        if t:
            cur, back[at] = step(cur[:n], at)
        else:
            cur = emit[at] + np.where(r.begins[r.order][:, None], first, 0).astype(emit.dtype)
            cur -= cur.max(1, keepdims=True)
        score[at] = cur

    def ahead(blocks: np.ndarray) -> np.ndarray:
        changed, cur, of, t = np.zeros(len(blocks), bool), score[r.last(blocks - 1)], np.arange(len(blocks)), 0
        while len(of):
            at = r.begin[t] + r.rank[blocks[of]]
            cur, back[at] = step(cur, at)
            same, end = (cur == score[at]).all(1), r.size[blocks[of]] == t + 1
            score[at] = cur
            changed[of[end & ~same]] = True
            go = ~(same | end)
            cur, of, t = cur[go], of[go], t + 1
        return changed

    settle(r.begins, ahead)
    tag = np.zeros(0, np.int8)
    for t in range(len(r.live) - 1, -1, -1):
        n, at = int(r.live[t]), slice(r.begin[t], r.begin[t] + int(r.live[t]))
        m = len(tag)
        if m:
            tags[at][:m] = back[r.begin[t + 1] + np.arange(m), tag]
        tags[at][m:n] = score[at][m:n].argmax(1)
        tag = tags[at]

    def behind(blocks: np.ndarray) -> np.ndarray:
        changed, of, t = np.zeros(len(blocks), bool), np.arange(len(blocks)), r.size[blocks] - 1
        then = r.first(blocks + 1)
        while len(of):
            new = back[then, tags[then]]
            at = r.begin[t] + r.rank[blocks[of]]
            same, end = new == tags[at], t == 0
            tags[at] = new
            changed[of[end & ~same]] = True
            go = ~(same | end)
            then, of, t = at[go], of[go], t[go] - 1
        return changed

    settle_back(r.ends, behind)
    return tags[r.pos]


class Decoder:
    """Tags the words of many texts with one pass of Viterbi."""

    def __init__(self, field: Field):
        self.field, self.cache, self.known = field, {}, []
        self.own, self.before, self.after = (np.zeros((0, len(TAGS)), np.float32) for _ in range(3))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Words of equal features share a row of scores; 0 is the row outside a text."""
        if len(self.cache) > MAX_CACHE or not self.known:
            self.cache, self.known = {}, [(0,) * FEATURES]
            self.place = {(0,) * FEATURES: 0}
        fresh = [w for w in set(words) if w not in self.cache]
        if fresh:
            for w, key in zip(fresh, map(tuple, self.field.rows(fresh).tolist()), strict=True):
                if (at := self.place.get(key)) is None:
                    at = self.place[key] = len(self.known)
                    self.known.append(key)
                self.cache[w] = at
        if len(self.own) != len(self.known):
            rows = np.array(self.known)
            self.own, self.before, self.after = (w[rows].sum(1) for w in (self.field.own, self.field.before, self.field.after))
        return np.fromiter(map(self.cache.__getitem__, words), np.int32, len(words))

    def tags(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Tags of each text's words: the path of the highest score; ties go to the smaller tag."""
        sizes = np.array([len(x) for x in texts], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int8) for _ in texts]
        flat, cuts = self._numbers([w for x in texts for w in x]), np.cumsum(sizes)[:-1]
        emit = self.own[flat]
        joins = np.ones(len(flat) - 1, bool)  # whether a word and the next one are of one text
        joins[cuts[(cuts > 0) & (cuts < len(flat))] - 1] = False
        emit[1:][joins] += self.before[flat[:-1][joins]]
        emit[:-1][joins] += self.after[flat[1:][joins]]
        return np.split(viterbi(emit, self.field.move, self.field.first, sizes), cuts)


#: No kind's span has more words.
MOST_WORDS = 19
_EDGE = " ,.;:!?\"'<>[]{}|*#$%&="


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGE:
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def field_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of tagged words as plausible (start, kind, end), without the marks at their edges.

    A run that is no span as a whole, such as two numbers side by side, gives from its start on the longest parts that are.
    """
    out, words = [], [m.span() for m in _WORD.finditer(text)]
    i = 0
    while i < len(tags):
        if not tags[i]:
            i += 1
            continue
        kind, j = (int(tags[i]) - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 + 2 * kind:
            j += 1
        while i < j:
            for e in range(min(j, i + MOST_WORDS), i, -1):
                a, b = _trimmed(text, words[i][0], words[e - 1][1])
                if a < b and plausible(kind, text[a:b]):
                    out.append((a, kind, b))
                    i = e - 1
                    break
            i += 1
    return out


def all_spans(texts: list[str], decoder: Decoder) -> list[tuple[list, list]]:
    """Of each text: the patterns' spans, and these with the field's that overlap none of them."""
    out = []
    for text, tags in zip(texts, decoder.tags([_WORD.findall(x) for x in texts]), strict=True):
        base = base_spans(text)
        more = field_spans(text, tags) if tags.any() else []
        out.append((base, sorted(base + [(a, k, b) for a, k, b in more if all(b <= x or a >= y for x, _, y in base)])))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(batches, field):
    decoder = Decoder(field.value)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        found = all_spans(texts, decoder)
        counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
        digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([_joined(s) for _, s in found], pa.string())], schema=_ARROW)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # the model of a small table: a few hundred KB
    return map_batches(docs.select(id_col, text_col), functools.partial(_find, field=shared), SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping ones the first gives its name to all."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), train(labelled_table(spark)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with all their spans masked and n_chars counted anew; a null text stays null."""
    docs = docs.select(*(c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")))
    at, field = docs.columns.index("text"), spark.sparkContext.broadcast(train(labelled_table(spark)))

    def mask(batches):
        decoder = Decoder(field.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = all_spans([x or "" for x in texts], decoder)
            yield batch.set_column(at, batch.schema.field(at), pa.array([x and redact(x, s) for x, (_, s) in zip(texts, found, strict=True)], batch.schema.field(at).type))

    out = map_batches(docs, mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
