"""Keyword-stuffed and link-list pages: lines are labelled prose, link list, tag list or menu by a hidden Markov model.

A post's own text (quotes, signatures and code blocks left out) is cut into lines and sentences. Each becomes one observation
of five language-independent features. The model's parameters come from expectation maximisation over all posts, each
round a pass of Spark tasks that return expected counts (a table of fixed size); prior tables keep the states' meaning.
Posts whose words are mostly not prose are flagged.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

PROSE, LINKS, TAGS, MENU = range(4)
STATES = ["prose", "link list", "tag list", "menu"]
#: Rounds end when no parameter changes by more, or after so many.
TOLERANCE, ROUNDS = 0.005, 50
#: Fewer words are no list, fewer lines no menu; a link counts as so many words.
LIST_WORDS, MENU_LINES, LINK_WORDS = 5, 3, 2
#: Observations that each row of a prior table stands for: much for a few posts, nothing against a corpus.
PRIOR_COUNT = 2000

# Prior tables, one row per state. Features: how the unit ends and how long it is, share of links among its words,
# separators per word, share of repeated words, share of numbers, prices and product marks.
END = np.array([[0.04, 0.03, 0.015, 0.005, 0.90, 0.01], [0.60, 0.18, 0.10, 0.07, 0.04, 0.01], [0.10, 0.15, 0.20, 0.45, 0.05, 0.05], [0.60, 0.25, 0.08, 0.02, 0.04, 0.01]])
LINK = np.array([[0.95, 0.03, 0.015, 0.005], [0.02, 0.08, 0.45, 0.45], [0.90, 0.07, 0.02, 0.01], [0.90, 0.04, 0.03, 0.03]])
SEPARATORS = np.array([[0.62, 0.34, 0.035, 0.005], [0.25, 0.25, 0.30, 0.20], [0.15, 0.15, 0.35, 0.35], [0.40, 0.20, 0.25, 0.15]])
REPEATED = np.array([[0.85, 0.13, 0.015, 0.005], [0.75, 0.15, 0.07, 0.03], [0.25, 0.20, 0.25, 0.30], [0.92, 0.05, 0.02, 0.01]])
MARKS = np.array([[0.90, 0.09, 0.01], [0.55, 0.35, 0.10], [0.55, 0.25, 0.20], [0.55, 0.25, 0.20]])
TABLES = [END, LINK, SEPARATORS, REPEATED, MARKS]
START = np.array([0.80, 0.07, 0.09, 0.04])
MOVES = np.array([[0.93, 0.02, 0.03, 0.02], [0.06, 0.90, 0.03, 0.01], [0.06, 0.03, 0.90, 0.01], [0.15, 0.03, 0.04, 0.78]])
BINS = [t.shape[1] for t in TABLES]

LINK_MARK, ANCHOR = "\x01", "\x02"
QUOTE_TAG = regex.compile(r"\[quote[^\]]*\]|\[/quote\]|<blockquote[^>]*>|</blockquote>", regex.I)
CODE = regex.compile(r"\[code\].*?(?:\[/code\]|\Z)|<pre\b.*?(?:</pre>|\Z)", regex.I | regex.S)
ATTRIBUTION = regex.compile(r"^[^\n]+:[ \t]*\n(?=\s*(?:>|&gt;))", regex.M)
QUOTED_LINE = regex.compile(r"^[ \t]*(?:>|&gt;).*$", regex.M)
SIGNATURE = regex.compile(r"\n(?:--[ \t]*|_{3,}[ \t]*)(?:\n(?!--[ \t]*\n|_{3,}[ \t]*\n)[^\n]*)*\Z|\n~~[^\n]*(?:\n[^\n]*)?~~\s*\Z")
# a host is labels joined by points (or by the word dot), the last one of letters in one case
LABELS = r"[\w-]+(?:(?:\.| dot )[\w-]+)*"
PATH = r"(?:/[^\s\[\]<>|\"]*)?(?: dot \w+\?[^\s\[\]<>|\"]*)?"
URL = re.compile(rf"(?:(?i:h(?:tt|xx)ps?://|www(?:\.| dot ))){LABELS}{PATH}|\b{LABELS}(?:\.| dot )(?:[a-z]{{2,}}|[A-Z]{{2,}})\b{PATH}")
ANCHORED = regex.compile(r"\[url=([^\]]*)\](.*?)\[/url\]|<a\s[^>]*>(.*?)</a>|\[([^\[\]\n]+)\]\((?=\S)([^()\s]+)\)", regex.I | regex.S)
IMAGE = regex.compile(r"\[(img|url)\](.*?)\[/\1\]", regex.I | regex.S)
BREAK_TAG = regex.compile(r"</?(?:p|div|br|li|ul|ol|h\d|tr|td|table)\b[^>]*>|\[/?(?:list|\*)\]", regex.I)
ANY_TAG = regex.compile(r"<[^<>\n]+>|\[/?[a-z*]+(?:=[^\]\n]*)?\]", regex.I)
SENTENCE = re.compile(r"([.!?…][\"')\]»”]{0,2})[ \t]+(?=[^\s\d])|([。！？])(?=.)")
LINK_SIGN = re.compile(r"://| dot |[\w-]\.[A-Za-z]{2}")
WORD = regex.compile(r"[\x01]|[\x02]?[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*")
ASCII_WORD = re.compile(r"\x01|\x02?[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*")  # the same for ASCII
ANCHOR_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
SEPARATOR = re.compile(r"[,;|•·/#*\t、，；]|[  ][-–—][  ]|[^\s.!?…:,;][  ]{2,}(?=\S)")
AFTER, STOP = re.compile(r"[\W_]*"), re.compile(r"[.!?…。！？।؟۔]")
MARK = re.compile(r"[$€£¥₽]\s?\d|\d+\s?[$€£¥₽]|\d{2,}|\d+x\b|#\w")


def own_text(text: str) -> str:
    """A post without quoted text, code blocks and signature; line ends are newlines."""
    if "\r" in text:
        text = regex.sub(r"\r*\n|\r+", "\n", text)
    marked = "[" in text or "<" in text
    if marked:
        kept, depth, at = [], 0, 0
        for tag in QUOTE_TAG.finditer(text):
            if depth == 0:
                kept.append(text[at : tag.start()])
            depth = max(0, depth + (-1 if "/" in tag.group()[:2] else 1))
            at = tag.end()
        if depth == 0:
            kept.append(text[at:])
        text = "\n".join(kept)
    if ">" in text or "&gt;" in text:
        text = QUOTED_LINE.sub("", ATTRIBUTION.sub("", text))
    if marked:
        text = CODE.sub("\n", text)
    text = "\n" + text.rstrip()
    return SIGNATURE.sub("\n", text) if "\n--" in text or "\n__" in text or "\n~~" in text else text


def _anchor(m: regex.Match) -> str:
    inner = m.group(2) or m.group(3) or m.group(4) or ""
    return " " + LINK_MARK + " " + " ".join(ANCHOR + w for w in ANCHOR_WORD.findall(inner)) + " "


def units(text: str) -> list[str]:
    """Lines and sentences of a post's own text, links masked."""
    text = own_text(text)
    if "[" in text or "<" in text:
        text = ANCHORED.sub(_anchor, text)
        text = IMAGE.sub(" " + LINK_MARK + " ", text)
        text = ANY_TAG.sub("", BREAK_TAG.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    if LINK_SIGN.search(text):
        text = URL.sub(LINK_MARK, text)
    return [u for u in SENTENCE.sub(r"\1\2\n", text).split("\n") if u.strip()]


def observe(unit: str) -> tuple[int, int]:
    """(observation, words) of a unit; the observation packs the bins of the five features."""
    lower, ascii_ = unit.lower(), unit.isascii()
    words = (ASCII_WORD if ascii_ else WORD).findall(lower)
    han = 0 if ascii_ else len(HAN.findall(unit))
    n = max(1, len(words) + han // 2)
    plain = [w for w in words if w[0] > ANCHOR] if LINK_MARK in unit or ANCHOR in unit else words
    links = len(words) - len(plain)
    length = n - links
    size = 0 if length <= 5 else 1 if length <= 12 else 2 if length <= 25 else 3
    # a sentence's end is among the signs behind the last word
    ended = length >= 2 and STOP.search(AFTER.match(unit[::-1]).group()) is not None
    end = (4 if length <= 60 else 5) if ended else size
    share = links / n
    link = 0 if not links else 1 if share < 0.2 else 2 if share < 0.6 else 3
    rate = len(SEPARATOR.findall(unit)) / n
    separators = 0 if rate < 0.06 else 1 if rate < 0.22 else 2 if rate < 0.45 else 3
    if han > len(unit) // 3:
        grams = [unit[i : i + 2] for i in range(len(unit) - 1)]
        repeated = 1 - len(set(grams)) / max(1, len(grams))
    else:
        repeated = 1 - len(set(plain)) / len(plain) if plain else 0.0
    rep = 0 if repeated < 0.2 else 1 if repeated < 0.4 else 2 if repeated < 0.6 else 3
    rate = len(MARK.findall(lower)) / n
    marks = 0 if rate < 0.05 else 1 if rate < 0.25 else 2
    code = 0
    for value, bins in zip((end, link, separators, rep, marks), BINS, strict=True):
        code = code * bins + value
    return code, n + (LINK_WORDS - 1) * lower.count(LINK_MARK)


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [[observe(u) for u in units(t)] if t else [] for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), *(pa.array([[x[i] for x in s] for s in seen], pa.list_(pa.int32())) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "obs", "words"])


@dataclass
class Model:
    """Start, transition and per-feature emission probabilities of the four states."""

    start: np.ndarray
    moves: np.ndarray
    tables: list[np.ndarray]

    def emissions(self) -> np.ndarray:
        """Log probability of every packed observation in every state."""
        out = np.zeros((len(STATES), 1))
        for t in self.tables:
            out = (out[:, :, None] + np.log(t)[:, None, :]).reshape(len(STATES), -1)
        return out.T


PRIOR = Model(START, MOVES, TABLES)


def _padded(obs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, lengths, padded observations) of sequences of similar length."""
    length = np.array([len(o) for o in obs])
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    i = 0
    while i < len(order):
        longest = max(8, 2 * length[order[i]])
        j = i + int(np.searchsorted(length[order[i:]], longest, "right"))
        j = min(j, i + max(1, 400_000 // int(longest)))
        part = order[i:j]
        n = length[part]
        grid = np.zeros((len(part), n.max()), np.int64)
        for row, p in enumerate(part):
            grid[row, : n[row]] = obs[p]
        yield part, n, grid
        i = j


def expected_counts(obs: list[np.ndarray], model: Model, weights: np.ndarray | None = None) -> np.ndarray:
    """Start, transition and observation counts (flat) by forward and backward passes, scaled per step; a sequence counts as
    often as its weight says."""
    emit = np.exp(model.emissions())
    k, size = len(STATES), len(emit)
    start, moves, seen = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    weights = np.ones(len(obs)) if weights is None else weights
    for part, n, grid in _padded(obs):
        steps, weight = grid.shape[1], weights[part][:, None]
        live = np.arange(steps)[None, :] < n[:, None]
        e = emit[grid] * live[:, :, None] + ~live[:, :, None]
        f = np.zeros(e.shape)
        a = model.start * e[:, 0]
        f[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, steps):
            a = np.where(live[:, t, None], (f[:, t - 1] @ model.moves) * e[:, t], f[:, t - 1])
            f[:, t] = a / a.sum(1, keepdims=True)
        b = np.ones((len(n), k))
        post = f[:, -1] * live[:, -1, None] * weight
        np.add.at(seen, grid[:, -1], post)
        if steps == 1:
            start += post.sum(0)
        for t in range(steps - 2, -1, -1):
            on = live[:, t + 1]
            pair = f[:, t, :, None] * model.moves[None] * (e[:, t + 1] * b)[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moves += (pair * weight[:, :, None])[on].sum(0)
            b = np.where(on[:, None], (e[:, t + 1] * b) @ model.moves.T, b)
            b /= b.sum(1, keepdims=True)
            post = f[:, t] * b
            post = post / post.sum(1, keepdims=True) * live[:, t, None] * weight
            np.add.at(seen, grid[:, t], post)
            if t == 0:
                start += post.sum(0)
    return np.concatenate([start, moves.ravel(), seen.ravel()])


def labels(obs: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """Most probable states of each sequence."""
    emit, moves = model.emissions(), np.log(model.moves)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(obs)
    for part, n, grid in _padded(obs):
        steps = grid.shape[1]
        score = np.log(model.start) + emit[grid[:, 0]]
        back = np.zeros((*grid.shape, len(STATES)), np.int8)
        for t in range(1, steps):
            options = score[:, :, None] + moves[None]
            on = (t < n)[:, None]
            back[:, t] = np.where(on, options.argmax(1), np.arange(len(STATES))[None])
            score = np.where(on, options.max(1) + emit[grid[:, t]], score)
        state = score.argmax(1)
        path = np.zeros(grid.shape, np.int64)
        for t in range(steps - 1, -1, -1):
            path[:, t] = state
            state = np.take_along_axis(back[:, t], state[:, None], 1)[:, 0]
        for row, p in enumerate(part):
            out[p] = path[row, : n[row]]
    return out


def settled(path: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Labels of a post where a list has at least LIST_WORDS words, and a menu MENU_LINES lines or the words of as many lists;
    less is a remark, hence prose."""
    edges = np.flatnonzero(np.diff(path)) + 1
    for a, b in zip([0, *edges], [*edges, len(path)], strict=True):
        if a == b:
            continue
        least = MENU_LINES * LIST_WORDS if path[a] == MENU and b - a < MENU_LINES else LIST_WORDS
        if path[a] != PROSE and words[a:b].sum() < least:
            path[a:b] = PROSE
    return path


def _sequences(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in batch.column(column)]


def _counter(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            counts = expected_counts(_sequences(batch, 0), model, batch.column(1).to_numpy().astype(np.float64))
            total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "c"])

    return work


def updated(model: Model, flat: np.ndarray) -> Model:
    """The model after a round: expected counts, and those the prior tables stand for."""
    k = len(STATES)
    start, moves, seen = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(*BINS, k)
    blend = lambda c, p: (c + PRIOR_COUNT * p) / (c.sum() + PRIOR_COUNT)
    tables = [np.stack([blend(seen[..., s].sum(tuple(i for i in range(len(BINS)) if i != f)), TABLES[f][s]) for s in range(k)]) for f in range(len(BINS))]
    return Model(blend(start, START), np.stack([blend(moves[s], MOVES[s]) for s in range(k)]), tables)


def _change(a: Model, b: Model) -> float:
    return max(float(np.abs(x - y).max()) for x, y in zip([a.start, a.moves, *a.tables], [b.start, b.moves, *b.tables], strict=True))


def fit(observations: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Model:
    """Expectation maximisation over all posts until no parameter changes by more than ``tolerance``. Posts of equal
    observations are one row with a weight. The driver gets one number per parameter, whatever the corpus."""
    model, k, size = PRIOR, len(STATES), int(np.prod(BINS))
    distinct = stage(observations.filter(F.size("obs") > 0).groupBy("obs").agg(F.count("*").alias("weight")), "sequences")
    for _ in range(rounds):
        counts = distinct.mapInArrow(_counter(model), "i int, c double").groupBy("i").agg(F.sum("c").alias("c")).collect()
        flat = np.zeros(k + k * k + size * k)
        for row in counts:
            flat[row["i"]] = row["c"]
        before, model = model, updated(model, flat)
        if _change(before, model) <= tolerance:
            break
    return model


def _judge(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            obs, words = _sequences(batch, 1), _sequences(batch, 2)
            place: dict[bytes, int] = {}  # equal posts are labelled once
            at = [place.setdefault(o.tobytes(), len(place)) for o in obs]
            paths = labels([np.frombuffer(k, obs[0].dtype) for k in place], model) if obs else []
            sums = np.array([np.bincount(settled(paths[i].copy(), w), w, minlength=len(STATES)) for i, w in zip(at, words, strict=True)]).reshape(len(obs), len(STATES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[:, s].astype(np.int64)) for s in range(len(STATES)))], names=["doc_id", *("prose", "links", "tags", "menu")])

    return work


def label_words(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, prose, links, tags, menu): words of each post's own text by the label of their line.

    Every row is judged, repeated ones too; a null, empty or only quoted text has no words. Other columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    observations = stage(docs.mapInArrow(_observations, f"doc_id {kind}, obs array<int>, words array<int>"), "observations")
    model = fit(observations, rounds)
    return observations.mapInArrow(_judge(model), f"doc_id {kind}, prose long, links long, tags long, menu long")


def flagged(labelled: DataFrame) -> DataFrame:
    """Posts with more words in link lists, tag lists and menus than in prose."""
    return labelled.filter("links + tags + menu > prose").select("doc_id")
