"""Language identification by cross-parsing: a text is cut greedily into the longest phrases that occur in a language's
labelled text, and the language that needs the fewest, normalised by the size of its labelled text, wins.

Longest matches come from a suffix automaton of each language's labelled text. The automata are tables of numbers, and
numpy walks them for many pieces of text at once. Texts are lower-cased, runs of other characters than letters are one
space. Texts are parsed whole: pieces of PIECE characters are walked at once and then joined, see blocks.

A text that is null or has no letter is `und` with score 0. The score is 1 - cost of the best / cost of the second, 1 if
only one language was learned, and ties go to the first language in alphabetical order. Rows without doc_id are not
learned from and not held out. Every row is judged alone; repeated rows get equal results, further columns are ignored,
an empty table gives an empty result. Learning needs at least one labelled text; with none all texts are `und`.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfold.llm.blocks import Blocks, settle
from quillfold.llm.common import map_batches, table

#: The labelled sample: so many texts of each language, so many characters in all.
SAMPLE_TEXTS, TRAIN_CHARS = 48, 40_000
#: What a driver and workers hold, at 2 MB a language at most. More languages are an error; none is left out.
MAX_LANGUAGES = 256
PIECE, STRETCHES = 1024, 20
#: Pieces times languages that are walked at once.
CELLS = 16_384

_LETTERS = re.compile(r"[^\W\d_]+")


def normal(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


class Automaton:
    """Suffix automaton: from state 0, exactly the substrings of the text can be walked."""

    def __init__(self, text: Iterable[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur


@dataclass
class Model:
    """Every character of the labelled texts is a symbol; symbol 0 is any character that no labelled text has.

    The transitions of all automata share one double array: that of `state` on `symbol` lies in slot base[state] + symbol
    and leads to goal[slot] if check[slot] == state. Else a new phrase starts, in state root[language, symbol]. Of each
    language, the state behind its automaton's, in starts, is the one between phrases; it has no transitions.
    """

    languages: list[str]
    alphabet: list[int]
    base: np.ndarray
    check: np.ndarray
    goal: np.ndarray
    root: np.ndarray
    starts: np.ndarray
    bits: np.ndarray

    def symbols(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return out


def _slots(nodes: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and goal of one automaton: the states of most transitions take the first slots that are free."""
    base = np.zeros(len(nodes) + 1, np.int32)
    order = sorted((i for i in range(1, len(nodes)) if len(nodes[i]) > 1), key=lambda i: -len(nodes[i]))
    single = [i for i in range(1, len(nodes)) if len(nodes[i]) == 1]
    most = max((c for out in nodes for c in out), default=0)
    used, low, tries = np.zeros(4 * sum(map(len, nodes)) + 2 * most + 1024, bool), 0, np.arange(256)[:, None]
    for i in order:
        on, at = np.fromiter(nodes[i], np.int64, len(nodes[i])), low
        while True:
            if at + 256 + most >= len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            free = np.flatnonzero(~used[at + tries + on].any(1))
            if len(free):
                break
            at += 256
        base[i] = at + free[0]
        used[base[i] + on] = True
        if used[low + most : low + most + 256].mean() > 0.9:
            low += 256
    on = np.array([next(iter(nodes[i])) for i in single], np.int64)
    free = np.flatnonzero(~used[most:])[: len(single)] + most
    if len(free) < len(single):
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
    base[single] = free - on
    states = np.repeat(np.arange(len(nodes)), [0, *map(len, nodes[1:])])
    on = np.fromiter((c for out in nodes[1:] for c in out), np.int64, len(states))
    to = np.fromiter((s for out in nodes[1:] for s in out.values()), np.int32, len(states))
    slots = base[states] + on
    check, goal = np.full(int(slots.max(initial=0)) + 1, -1, np.int32), np.zeros(int(slots.max(initial=0)) + 1, np.int32)
    check[slots], goal[slots] = states, to
    return base, check, goal


def learn(labelled: dict[str, str]) -> Model:
    """labelled: normalised text by language."""
    languages = sorted(k for k, v in labelled.items() if v)
    alphabet = sorted({ord(c) for k in languages for c in labelled[k]})
    number = {c: i + 1 for i, c in enumerate(alphabet)}
    bases, checks, goals, starts, offset, slot = [], [], [], [], 0, 0
    root = np.zeros((len(languages), len(alphabet) + 1), np.int32)
    for n, k in enumerate(languages):
        nodes = Automaton([number[ord(c)] for c in labelled[k]]).next
        base, check, goal = _slots(nodes)
        bases.append(base + slot)
        checks.append(np.where(check < 0, -1, check + offset))
        goals.append(goal + offset)
        starts.append(offset + len(nodes))
        root[n] = starts[-1]
        root[n, list(nodes[0])] = np.fromiter(nodes[0].values(), np.int32) + offset
        offset += len(nodes) + 1
        slot += len(check)
    end = len(alphabet) + 1  # slots that states of the last language may look at
    empty = [np.zeros(0, np.int32)]
    return Model(
        languages,
        alphabet,
        np.concatenate(bases or empty).astype(np.int32),
        np.concatenate([*checks, np.full(end, -1)]).astype(np.int32),
        np.concatenate([*goals, np.zeros(end)]).astype(np.int32),
        root,
        np.array(starts, np.int32),
        np.array([math.log2(len(labelled[k]) + 1) for k in languages]),
    )


def phrases(texts: list[str], model: Model, symbols: np.ndarray) -> np.ndarray:
    """[text, language] numbers of phrases of whole normalised texts."""
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not model.languages:
        return out
    blocks = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), PIECE)]
    group, carried = max(1, CELLS // len(model.languages)), None
    for at in range(0, len(blocks), group):
        part = blocks[at : at + group]
        count, carried = _parse([texts[i][a : a + PIECE] for i, a in part], np.array([a == 0 for _, a in part]), carried, model, symbols)
        np.add.at(out, np.array([i for i, _ in part]), count.T)
    return out


def _parse(pieces: list[str], begins: np.ndarray, carried: np.ndarray | None, model: Model, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[language, piece] numbers of phrases that begin in each piece, and each language's state at the last one's end.

    A piece that doesn't begin its text goes on in the state that the piece before it, or the group before, ended in.
    """
    laid = Blocks(np.array(list(map(len, pieces)), np.int64), PIECE)
    chars = laid.laid(symbols[np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)])
    state = np.repeat(model.starts[:, None], len(pieces), 1)
    count, opened = np.zeros(state.shape, np.int64), np.zeros((len(model.languages), len(chars)), bool)
    for t, n in enumerate(laid.live.tolist()):
        now, was = slice(laid.begin[t], laid.begin[t] + n), state[:, :n]
        slots = model.base.take(was) + chars[now]
        opened[:, now] = new = model.check.take(slots) != was
        count[:, :n] += new
        state[:, :n] = np.where(new, model.root.take(chars[now], axis=1), model.goal.take(slots))

    def walk(blocks: np.ndarray) -> np.ndarray:
        """Until both parsings open a phrase at the same character: from there on they are the same."""
        changed = np.zeros(len(blocks), bool)
        before = np.where(blocks > 0, laid.rank[blocks - 1], 0)
        cur = state[:, before].copy()
        if carried is not None and blocks[0] == 0:
            cur[:, 0] = carried
        lang, of = (x.ravel() for x in np.indices(cur.shape))
        cur, rank, t = cur.ravel(), laid.rank[blocks[of]], 0
        while len(cur):
            at = laid.begin[t] + rank
            slots = model.base[cur] + chars[at]
            new, had = model.check[slots] != cur, opened[lang, at]
            cur = np.where(new, model.root[lang, chars[at]], model.goal[slots])
            count[lang, rank] += new.astype(np.int64) - had
            opened[lang, at] = new
            end = laid.size[blocks[of]] == t + 1
            other = end & (cur != state[lang, rank])
            state[lang[other], rank[other]] = cur[other]
            changed[of[other]] = True
            go = ~(end | new & had)
            cur, lang, of, rank, t = cur[go], lang[go], of[go], rank[go], t + 1
        return changed

    settle(begins, walk)
    return count[:, laid.rank], state[:, laid.rank[-1]].copy()


_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_phrases", pa.int64())])
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_phrases long"


def _predict(batches, shared):
    model: Model = shared.value
    symbols = model.symbols()
    for batch in batches:
        texts = [normal(x or "") for x in batch.column(2).to_pylist()]
        counts = phrases(texts, model, symbols)
        langs, scores, best = [], [], []
        for text, row in zip(texts, counts, strict=True):
            if not model.languages or not any(map(str.isalpha, text)):
                langs.append("und")
                scores.append(0.0)
                best.append(0)
                continue
            cost = row * model.bits
            order = np.argsort(cost, kind="stable")
            langs.append(model.languages[order[0]])
            scores.append(float(1 - cost[order[0]] / cost[order[1]]) if len(order) > 1 else 1.0)
            best.append(int(row[order[0]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.int64())], schema=_ARROW)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learns) -> dict[str, str]:
    """Texts of each language, a bounded sample: of the first SAMPLE_TEXTS in order of a hash of their ids those that fit
    into TRAIN_CHARS, whole. Where each is longer than that, STRETCHES from all over the first one are the sample.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.where(learns).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.length(text_col).alias("size"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "size")
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS).limit(MAX_LANGUAGES * SAMPLE_TEXTS + 1).collect()
    if len(chosen) > MAX_LANGUAGES * SAMPLE_TEXTS or len({r["lang"] for r in chosen}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    left, taken = {}, []
    chosen.sort(key=lambda r: (r["lang"], r["n"]))
    for r in chosen:
        if 0 < r["size"] <= (room := left.get(r["lang"], TRAIN_CHARS)):
            taken.append(r)
            left[r["lang"]] = room - r["size"]
    for r in chosen:
        if r["size"] and r["lang"] not in left:
            taken.append(r)
            left[r["lang"]] = 0
    if not taken:
        return {}
    text, size = F.col(text_col), F.length(text_col)
    stretch = lambda i: F.substring(text, (i * (size / STRETCHES) + 1).cast("int"), F.lit(TRAIN_CHARS // STRETCHES))
    cut = F.when(size <= TRAIN_CHARS, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), stretch), " "))
    found = known.where(F.col(id_col).isin(list({r["id"] for r in taken}))).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), cut.alias("t")).groupBy("lang", "id").agg(F.min("t").alias("t")).collect()
    texts, out = {(r["lang"], r["id"]): r["t"] for r in found}, {}
    for r in taken:
        if t := normal(texts.get((r["lang"], r["id"]), "")):
            out[r["lang"]] = f"{out.get(r['lang'], '')} {t}".strip()
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learns from the rows outside of fold 0 and predicts every row's language."""
    fold = F.crc32(F.col(id_col).cast("string")) % folds
    model = learn(labelled_sample(docs, id_col, text_col, lang_col, fold != 0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: 2 MB a language at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(rows, functools.partial(_predict, shared=shared), SCHEMA)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
