"""Languages learned from the texts themselves, as clusters of character trigrams.

All distinct texts take part. Dealt by hash, they are clustered some at a time (spherical k-means on square roots of trigram
frequencies from farthest seeds); what leaves is the clusters' trigram counts, which are folded level by level until a few
languages are left (`fold`). Their trigram frequencies become the models. The log-likelihood of a text per trigram also has
a mean and a deviation within its language, again over all distinct texts, so a text can fit none.
Scripts come from the Unicode blocks of letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern import runtime

_BINS, _SMALL = 1 << 16, 1 << 12
#: Texts clustered at a time, texts of a task, tasks whose clusters are folded into one. They decide how work is dealt; no text is left out.
_AT_ONCE, _TASK, _FAN = 2000, 16_000, 16
#: Characters from which on a normalised text is learned from.
LEAST = 120
#: First code point of each run of letters, and its script; '' is no letter.
_BLOCKS = [
    (0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
    (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x750, "arabic"), (0x780, ""), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, ""), (0xB80, "tamil"),
    (0xC00, "telugu"), (0xC80, ""), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x3041, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"),
    (0xFB00, ""), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""),
]
_STARTS = np.array([b[0] for b in _BLOCKS])
_NAMES = sorted({b[1] for b in _BLOCKS if b[1]})
_OF = np.array([_NAMES.index(b[1]) if b[1] else len(_NAMES) for b in _BLOCKS])
_LATIN, _HAN, _KANA = (_NAMES.index(x) for x in ("latin", "han", "kana"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def script_counts(text: str) -> np.ndarray:
    """Letters by script; han beside a fifth or more of kana counts as kana."""
    n = np.bincount(_OF[np.searchsorted(_STARTS, _points(text), "right") - 1], minlength=len(_NAMES) + 1)[:-1]
    if n[_KANA] * 5 >= n[_KANA] + n[_HAN]:
        n[_KANA], n[_HAN] = n[_KANA] + n[_HAN], 0
    return n


def other_script(prompt: str, answer: str) -> bool:
    """Whether more than half of the letters are of one script in each, and not of the same. A Latin answer must have five
    words and less than a tenth of its letters in the prompt's script, as names stay Latin."""
    if prompt.isascii() and answer.isascii():
        return False
    p, a = script_counts(prompt), script_counts(answer)
    x, y = int(p.argmax()), int(a.argmax())
    if x == y or p[x] * 2 <= p.sum() or a[y] * 2 <= a.sum():
        return False
    return y != _LATIN or len(answer.split()) >= 5 and a[x] * 10 < a[_LATIN]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of the trigrams of normalised texts; those with a digit are left out."""
    points = _points("\n".join(f" {t} " for t in texts))
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.cumsum(points == 10)
    bad = (points == 10) | (points >= 48) & (points <= 57)
    p = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (p[:-2] * np.uint64(0x9E3779B1) + p[1:-1] * np.uint64(0x85EBCA77C2B2AE63) + p[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    keep = ~(bad[:-2] | bad[1:-1] | bad[2:])
    return (h >> np.uint64(48)).astype(np.int64)[keep], row[1:-1][keep]


class Languages:
    """logs: (languages, trigrams) log-likelihoods; mean, spread: of the texts of a language, per trigram; single: the
    deviation of one trigram's; types: how many trigrams a language was seen with."""

    def __init__(self, logs: np.ndarray, mean: np.ndarray, spread: np.ndarray, single: np.ndarray, types: np.ndarray) -> None:
        self.logs, self.mean, self.spread, self.single, self.types = logs, mean, spread, single, types

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log-likelihoods by text and language, trigrams of each text)."""
        h, row = trigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        out, some = np.zeros((len(texts), len(self.logs))), np.flatnonzero(n)
        if len(some):
            begins = np.concatenate(([0], np.cumsum(n[some])[:-1]))
            for k, x in enumerate(self.logs):
                out[some, k] = np.add.reduceat(x[h], begins)
        return out, n

    def low(self, n: np.ndarray, language: np.ndarray, far: float) -> np.ndarray:
        """The least log-likelihood per trigram that n trigrams of a language have: `far` deviations below the mean. Three
        neighbours share a character, so only every third counts."""
        return self.mean[language] - far * (self.spread[language] + self.single[language] * np.sqrt(3 / np.maximum(n, 1)))

    def measure(self, prompts: list[str], answers: list[str], told: list[bool] | None = None) -> dict[str, np.ndarray]:
        """What `differs` looks at, of each pair: whether the scripts differ (of pairs to be told only); the prompt's and the
        answer's most likely language, trigrams and log-likelihood per trigram; the answer's in the prompt's language, and
        how many nats that is below its best one."""
        script = [(told is None or told[i]) and other_script(p, a) for i, (p, a) in enumerate(zip(prompts, answers))]
        (p, n_p), (a, n_a) = self.scores(prompts), self.scores(answers)
        at, none = np.arange(len(prompts)), not len(self.logs)
        own, best = (np.zeros(len(prompts), np.int64),) * 2 if none else (p.argmax(axis=1), a.argmax(axis=1))
        p, a = (np.zeros((len(prompts), 1)),) * 2 if none else (p, a)
        per_p, per_a = np.maximum(n_p, 1), np.maximum(n_a, 1)
        return {
            "script": np.array(script, bool), "own": own, "n_p": n_p, "fit_p": p[at, own] / per_p, "best": best, "n_a": n_a,
            "fit_a": a[at, best] / per_a, "fit": a[at, own] / per_a, "gap": a[at, best] - a[at, own],
        }

    def differs(self, m: dict[str, np.ndarray], margin: float, least: int = 40, far: float = 5.0, known: int = 2500) -> np.ndarray:
        """Whether each answer is of another language than its prompt: of another script, more likely by the margin (in
        nats) in another language, or, from `least` trigrams on, `far` deviations away from the prompt's language, if that was
        seen with `known` trigrams: of one known from few words, other words tell nothing."""
        if not len(self.logs):
            return m["script"]
        own = m["own"]
        # a prompt of few trigrams, or of none of the languages, tells nothing
        sure = (m["n_p"] >= least) & (m["fit_p"] >= self.low(m["n_p"], own, far))
        alien = (m["n_a"] >= least) & (self.types[own] >= known) & (m["fit"] < self.low(m["n_a"], own, far))
        return m["script"] | sure & ((m["gap"] >= margin) | alien)

    def differ(self, prompts: list[str], answers: list[str], margin: float, **how: float) -> np.ndarray:
        return self.differs(self.measure(prompts, answers), margin, **how)


class Part(NamedTuple):
    """A cluster of texts: how many, and how often they have each trigram."""

    texts: int
    bins: np.ndarray
    counts: np.ndarray


def _root(wide: np.ndarray) -> np.ndarray:
    small = wide.reshape(-1, _SMALL, _BINS // _SMALL).sum(axis=2)
    return np.sqrt(small / np.maximum(small.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _logs(wide: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Log-likelihoods, with `extra` counts of each trigram besides the seen ones."""
    return np.log((wide + extra) / (wide.sum(axis=-1, keepdims=True) + extra * _BINS))


def _likely(wide: np.ndarray) -> np.ndarray:
    """Log-likelihoods in which unseen trigrams have a hundredth, however much was seen."""
    return _logs(wide, wide.sum(axis=-1, keepdims=True) * 0.01 / _BINS).astype(np.float32)


def clusters(texts: list[str], seeds: int = 24, rounds: int = 4) -> list[Part]:
    """The clusters of some texts, those of one language joined; a single strange text is one of its own."""
    count, found = np.zeros((len(texts), _SMALL), np.float32), []
    for i in range(0, len(texts), 200):  # in small arrays, which stay in the cache
        some = texts[i : i + 200]
        h, row = trigrams(some)
        count[i : i + 200] = np.bincount(row * _SMALL + (h >> 4), minlength=len(some) * _SMALL).reshape(len(some), _SMALL)
        found.append((h, row + i))
    h, row = (np.concatenate(x) for x in zip(*found))
    total = np.maximum(count.sum(axis=1, keepdims=True), 1)
    x = np.sqrt(count / total)
    centre = [x[int(total.argmax())]]
    nearest = x @ centre[0]
    for _ in range(min(seeds, len(texts)) - 1):  # farthest first
        centre.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ centre[-1])
    c, of = np.array(centre), np.full(len(texts), -1)
    for _ in range(rounds):
        before, of = of, (x @ c.T).argmax(axis=1)
        if (of == before).all():
            break
        c = np.array([count[of == k].sum(axis=0) for k in range(len(c))])
        c = np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1))
    wide = np.bincount(of[row] * _BINS + h, minlength=len(c) * _BINS).reshape(len(c), _BINS)
    n = np.bincount(of, minlength=len(c))
    return fold([Part(int(n[k]), at, wide[k][at]) for k in range(len(c)) if len(at := np.flatnonzero(wide[k]))])


def _joined(parts: list[Part], same: float, near: float) -> list[Part]:
    """From the largest down, each part joins the likeliest of those before it that its frequencies overlap by more than
    `same`, or that its trigrams are less than `near` nats worse in than that one's own are: few words of a language, as in
    a form that recurs, overlap little with all of it, but fit it."""
    n, wide, root, logs, own = [], [], np.zeros((len(parts), _SMALL), np.float32), [], []
    for p in sorted(parts, key=lambda p: -p.texts):
        new = np.zeros(_BINS, np.int64)
        new[p.bins] = p.counts
        share, k = p.counts / p.counts.sum(), len(n)
        fits = np.array([share @ x[p.bins] for x in logs])
        to = np.flatnonzero((root[:k] @ _root(new)[0] > same) | (np.array(own) - fits < near)) if k else ()
        if len(to):
            k = int(to[fits[to].argmax()])
            n[k], wide[k] = n[k] + p.texts, wide[k] + new
        else:
            for held, x in ((n, p.texts), (wide, new), (logs, None), (own, 0.0)):
                held.append(x)
        root[k], logs[k] = _root(wide[k])[0], _likely(wide[k])
        own[k] = float(wide[k] @ logs[k] / wide[k].sum())
    return [Part(t, at := np.flatnonzero(w), w[at]) for t, w in zip(n, wide)]


def _gathered(parts: list[Part], few: int, most: int) -> list[Part]:
    """Parts of fewer than `few` texts, and the small ones of more than `most` parts, join the one that they are likeliest in,
    the likeliest two first: so what is rare comes together before it goes to what is frequent."""
    n, wide = np.array([p.texts for p in parts]), np.zeros((len(parts), _BINS), np.int64)
    for k, p in enumerate(parts):
        wide[k, p.bins] = p.counts
    logs, left, fits = np.array([_likely(x) for x in wide]), np.ones(len(parts), bool), np.zeros((len(parts), len(parts)))
    likely = lambda k: logs[:, at := np.flatnonzero(wide[k])] @ (wide[k, at] / wide[k].sum())
    for k in range(len(parts)):
        fits[k] = likely(k)
    while (left_n := int(left.sum())) > 1:
        small = left & (n < few)
        if not small.any() and left_n > most:
            small[np.argsort(np.where(left, -n, 1), kind="stable")[most // 2 : left_n]] = True
        if not small.any():
            break
        allowed = small[:, None] & left & ~np.eye(len(parts), dtype=bool)
        i, j = divmod(int(np.where(allowed, fits, -np.inf).argmax()), len(parts))
        left[i], n[j], wide[j] = False, n[j] + n[i], wide[j] + wide[i]
        logs[j] = _likely(wide[j])
        fits[j] = likely(j)
        for k in np.flatnonzero(left):
            at = np.flatnonzero(wide[k])
            fits[k, j] = logs[j, at] @ (wide[k, at] / wide[k].sum())
    return [Part(int(n[k]), at := np.flatnonzero(wide[k]), wide[k][at]) for k in np.flatnonzero(left)]


def fold(parts: list[Part], few: int = 0, most: int = 32, same: float = 0.72, near: float = 1.5) -> list[Part]:
    """At most `most` parts, of `few` texts and more, that hold all counts of the given ones."""
    parts = _joined(parts, same, near)
    return _joined(_gathered(parts, few, most), same, near) if len(parts) > most or any(p.texts < few for p in parts) else parts


def modelled(parts: list[Part]) -> Languages:
    """The languages of parts, without means and spreads of their texts. All languages have the same counts besides those
    seen, in all a thousandth of the counts of the table (no more than a language's own): the smaller a language's part in a
    table of any size, the less an unseen trigram tells against it."""
    wide = np.zeros((len(parts), _BINS))
    for k, p in enumerate(parts):
        wide[k, p.bins] = p.counts
    own = wide.sum(axis=1, keepdims=True)
    logs, share = _logs(wide, np.maximum(0.05, np.minimum(wide.sum() / 1000, own) / _BINS)), wide / np.maximum(own, 1)
    single = np.sqrt((share * (logs - (share * logs).sum(axis=1, keepdims=True)) ** 2).sum(axis=1))
    return Languages(logs, np.zeros(len(parts)), np.zeros(len(parts)), single, (wide > 0).sum(axis=1))


def fit(texts: list[str], few: int = 5, least: int = LEAST) -> Languages:
    """The languages of normalised texts; those shorter than `least` are left out."""
    texts = [t for t in dict.fromkeys(texts) if len(t) >= least]
    found = modelled(fold([p for i in range(0, len(texts), _AT_ONCE) for p in clusters(texts[i : i + _AT_ONCE])], few))
    m = found.measure(texts, [""] * len(texts))
    for k in range(len(found.logs)):
        own = m["fit_p"][(m["own"] == k) & (m["n_p"] > 0)]
        found.mean[k], found.spread[k] = (own.mean(), own.std()) if len(own) else (0, 0)
    return found


_PARTS = "task long, place long, texts long, bins array<int>, counts array<long>"


def _batch(parts: list[Part], task: int) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(p.bins) for p in parts]))).astype(np.int32))
    flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p.bins for p in parts], [p.counts for p in parts])]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(kind))) for x, kind in zip(flat, (np.int32, np.int64))]
    place, texts = np.arange(len(parts)), pa.array([p.texts for p in parts], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), task)), pa.array(place), texts, *lists], names=["task", "place", "texts", "bins", "counts"])


def _parts(t: pa.Table) -> list[Part]:
    t = t.sort_by([("task", "ascending"), ("place", "ascending")])
    return [Part(n, b.values.to_numpy(), c.values.to_numpy()) for n, b, c in zip(t["texts"].to_pylist(), t["bins"], t["counts"])]


def learn(texts: DataFrame, few: int = 5) -> Languages:
    """The languages of all distinct texts of (h, t), h the hash of t; means and spreads of their texts are for `describe`."""
    tasks = max(1, -(-texts.count() // _TASK))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, last = [], [], None
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h != last:
                    held.append(t)
                    last = h
                if len(held) == _AT_ONCE:
                    parts, held = parts + clusters(held), []
        parts += clusters(held) if held else []
        if parts:
            yield _batch(fold(parts), TaskContext.get().partitionId())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        t = pa.Table.from_batches(held).sort_by("task") if held else None
        for task in sorted(set(t["task"].to_pylist())) if held else []:  # a shuffle partition may hold several
            one = t.filter(pc.equal(t["task"], task))
            yield _batch(fold(_parts(one.drop_columns("task").rename_columns({"was": "task"}))), task)

    found = runtime.cut(texts.select("h", "t").repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(first, _PARTS))
    while tasks > _FAN:
        tasks = -(-tasks // _FAN)
        dealt = found.withColumnRenamed("task", "was").withColumn("task", F.floor(F.col("was") / _FAN)).repartition(tasks, "task")
        found = runtime.cut(dealt.mapInArrow(again, _PARTS))
    return modelled(fold(_parts(found.toArrow()), few))


def describe(languages: Languages, fits: DataFrame) -> Languages:
    """The languages with the means and spreads of all distinct texts of (h, language, fit)."""
    each = fits.groupBy("h").agg(F.first("language").alias("language"), F.first("fit").alias("fit"))
    for r in each.groupBy("language").agg(F.avg("fit").alias("mean"), F.stddev_pop("fit").alias("spread")).collect():
        languages.mean[r.language], languages.spread[r.language] = r["mean"], r["spread"]
    return languages
