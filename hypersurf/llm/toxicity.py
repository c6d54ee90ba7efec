"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins word and character parts: the log odds of the word and of its character 3- to 5-grams between
toxic and other training documents, and trained embeddings of both.  The network reads windows of WINDOW words that overlap by
half, over the whole text; attention weighs a window's words; a document's score is the calibrated logit of its
highest window.  As only documents are labelled, training looks for the window to blame: it starts from the log odds and
then picks each document's highest windows by the network itself.  Log odds used in training come from the other half of
the documents, so that no document vouches for its own words.

Training is bounded: at most about TOXIC + CLEAN labelled documents of up to TEXT_BYTES, one text an id, picked by a hash of the id over all labels, on the driver; seeds are
fixed.  Scoring is one pass without a shuffle; only the model (about 3 MB) is sent out.

A score is read at a fixed threshold (THRESHOLD), so its calibration may not depend on how rare toxic labels are in a sample: the classes
are weighted as if PRIOR of the texts were toxic (or more, if more labels are).  A score is thus the probability at that prior.

Cases: a text without words, or null, scores 0; if the labels hold one class only (or none) every text with words scores the share
of toxic labels, and where no labelled text has a word, 0; labels repeated for a document count once (toxic if any is); null labels and labels of no document are ignored; a
labelled id with several rows teaches with the least of their texts; a labelled text of over TEXT_BYTES is scored, but not learned from; repeated rows repeat; an empty table gives no rows; other columns are ignored (score and
predicted among them, by query), and the stage keeps all columns of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import sample
from .words import mixed, split_words, word_hashes
from .work import columns, own_names, plain_names, release, slices, table

WINDOW, STRIDE, HIDDEN, EMBED = 16, 8, 8, 3
SLOTS, ROWS = 1 << 18, 1 << 12
TOXIC, CLEAN, STEPS, THRESHOLD = 800, 1200, 240, 0.7
#: Bytes of the longest text that is learned from.
TEXT_BYTES = 1 << 20
#: Share of toxic texts that the calibration takes as given at least; text bytes that are scored together.
PRIOR, SCORE_BYTES = 0.3, 1 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Corpus:
    """Words of some texts, their character n-grams, and their windows."""

    def __init__(self, texts: pa.Array):
        self.flat, self.ends, distinct = split_words(texts)
        self.n = len(distinct)
        self.word = (mixed(word_hashes(distinct)) % np.uint64(SLOTS)).astype(np.int64)
        marked = [f"^{w}$" for w in distinct.to_pylist()]
        lengths = np.fromiter(map(len, marked), np.int64, self.n)
        rolled = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes, owner, first = rolled, np.repeat(np.arange(self.n, dtype=np.int32), lengths), np.cumsum(lengths) - lengths
        del marked
        counts = [np.maximum(lengths - k, 0) for k in (2, 3, 4)]  # of 3, 4 and 5 characters
        self.gram_starts = np.concatenate([[0], np.cumsum(sum(counts))])
        self.gram, before = np.zeros(self.gram_starts[-1], np.int32), self.gram_starts[:-1].copy()
        for k in range(1, 5):
            if len(codes) <= k:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[k:]
            if k >= 2:
                at = np.flatnonzero(owner[: len(rolled)] == owner[k:])
                of = owner[at]
                self.gram[at + (before - first)[of]] = (mixed(rolled[at] + np.uint64(k)) % np.uint64(SLOTS)).astype(np.int32)
                before += counts[k - 2]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of each window with self.n as filler, its text)."""
        sizes = np.diff(self.ends, prepend=0)
        counts = np.where(sizes == 0, 0, np.maximum(1, -(-(sizes - STRIDE) // STRIDE)))
        doc = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = ((self.ends - sizes)[doc] + nth * STRIDE)[:, None] + np.arange(WINDOW)
        inside = places < self.ends[doc][:, None]
        return np.where(inside, self.flat[np.where(inside, places, 0)] if len(self.flat) else self.n, self.n), doc

    def spans(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `gram`, count) of the grams of some distinct words; every word has one, as its marks make three characters."""
        starts = self.gram_starts[words]
        sizes = self.gram_starts[words + 1] - starts
        return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes

    def inputs(self, words: np.ndarray, odds: tuple[np.ndarray, np.ndarray], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Inputs of some distinct words, and zeros for the filler."""
        x = np.zeros((len(words) + 1, 3 + 2 * EMBED), np.float32)
        for low in range(0, len(words), 1 << 14):  # words' n-grams are many times the words
            own = words[low : low + (1 << 14)]
            at, sizes = self.spans(own)
            starts, grams, part = np.cumsum(sizes) - sizes, self.gram[at], x[low : low + len(own)]
            chars, sizes = odds[1][grams], sizes[:, None].astype(np.float32)
            part[:, 0] = odds[0][self.word[own]]
            part[:, 1] = np.maximum.reduceat(chars, starts)
            part[:, 2] = np.add.reduceat(chars, starts) / sizes[:, 0]
            part[:, 3 : 3 + EMBED] = tables[0][self.word[own] % ROWS]
            part[:, 3 + EMBED :] = np.add.reduceat(tables[1][grams % ROWS], starts, axis=0) / sizes
        return x


def slot_counts(corpus: Corpus, toxic: np.ndarray) -> np.ndarray:
    """How many documents hold a slot: (word or character slots, toxic or not, slot)."""
    counts, starts = np.zeros((2, 2, SLOTS)), corpus.gram_starts
    for first in range(0, len(corpus.ends), 50):  # documents' n-grams are many times their words
        low, high = corpus.ends[first - 1] if first else 0, corpus.ends[min(first + 50, len(corpus.ends)) - 1]
        owner = np.searchsorted(corpus.ends, np.arange(low, high), side="right")
        pairs = np.unique(owner * np.int64(corpus.n + 1) + corpus.flat[low:high])
        doc, word = pairs // (corpus.n + 1), pairs % (corpus.n + 1)
        sizes = np.diff(starts)[word]
        at = np.repeat(starts[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        word_pairs = np.unique(doc * np.int64(SLOTS) + corpus.word[word])
        gram_pairs = np.unique(np.repeat(doc, sizes) * np.int64(SLOTS) + corpus.gram[at])
        for kind, both in enumerate((word_pairs, gram_pairs)):
            for bad in (0, 1):
                counts[kind, bad] += np.bincount(both[toxic[both // SLOTS] == bad] % SLOTS, minlength=SLOTS)
    return counts


def odds_of(counts: np.ndarray, toxic: int, others: int) -> tuple[np.ndarray, np.ndarray]:
    """Shrunken log odds, between toxic and other documents, that a document holds a word slot or a character slot."""
    out = []
    for good, bad in counts:
        odds = np.log((bad + 0.5) / (toxic + 1)) - np.log((good + 0.5) / (others + 1))
        out.append((odds * (bad + good) / (bad + good + 4)).astype(np.float32))
    return out[0], out[1]


class Network:
    """Two gated recurrent layers, one for each direction; attention over their states and inputs; a logit a window."""

    def __init__(self, seed: int = 7):
        r, d, h = np.random.default_rng(seed), 3 + 2 * EMBED, HIDDEN
        draw = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"Ew": draw(ROWS, EMBED) * 0.1, "Ec": draw(ROWS, EMBED) * 0.1, "q": draw(2 * h + d), "w": draw(2 * h + d), "b": np.zeros(1, np.float32)}
        for k in ("q", "w"):  # attention and verdict start from the log odds
            self.p[k][2 * h : 2 * h + 2] = 1.0
        self.p["b"] -= 3
        for k in "fb":
            self.p |= {f"W{k}": draw(d, 3 * h), f"c{k}": np.zeros(3 * h, np.float32), f"U{k}": draw(h, 3 * h)}

    def states(self, gates: np.ndarray, words: np.ndarray, live: np.ndarray, k: str, keep: list | None = None) -> np.ndarray:
        h, out, u = np.zeros((len(words), HIDDEN), np.float32), np.empty((WINDOW, len(words), HIDDEN), np.float32), self.p[f"U{k}"]
        for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
            g, hu, m = gates[words[:, t]], h @ u, live[:, t, None]
            zr = g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
            zr = 1 / (1 + np.exp(-zr))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            new = n + z * (h - n)
            h = out[t] = new if m.all() else np.where(m, new, h)
        return out

    def forward(self, x: np.ndarray, words: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; x: inputs by word, the last one the filler."""
        p, live, h = self.p, words < len(x) - 1, HIDDEN
        kept: dict = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        f, b = (self.states(x @ p[f"W{k}"] + p[f"c{k}"], words, live, k, kept[k]) for k in "fb")
        score, value = ((f @ v[:h] + b @ v[h : 2 * h] + (x @ v[2 * h :])[words].T) for v in (p["q"], p["w"]))
        a = np.where(live.T, score, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        if keep is not None:
            keep |= {"f": f, "b": b, "a": a, "value": value, "live": live, "kept": kept}
        return (a * value).sum(0) + p["b"][0]

    def gradients(self, corpus: Corpus, odds: tuple[np.ndarray, np.ndarray], words: np.ndarray, target: np.ndarray) -> dict:
        p, keep, h = self.p, {}, HIDDEN
        used, local = np.unique(np.append(words, corpus.n), return_inverse=True)
        used, words = used[:-1], local[:-1].reshape(words.shape)
        x = corpus.inputs(used, odds, (p["Ew"], p["Ec"]))
        logits = self.forward(x, words, keep)
        error = ((sigmoid(logits) - target) / len(words)).astype(np.float32)
        a, value, live = keep["a"], keep["value"], keep["live"]
        d_value = a * error
        d_score = a * (value - (a * value).sum(0)) * error
        g, dx = {"b": error.sum(keepdims=True), "q": np.zeros_like(p["q"]), "w": np.zeros_like(p["w"])}, np.zeros_like(x)
        for name, d in (("q", d_score), ("w", d_value)):
            by_word = np.bincount(words.T.ravel(), d.ravel(), len(x)).astype(np.float32)
            g[name] = np.concatenate([np.einsum("tn,tnd->d", d, keep["f"]), np.einsum("tn,tnd->d", d, keep["b"]), x.T @ by_word])
            dx += by_word[:, None] * p[name][2 * h :]
        by_place = np.argsort(words.T.ravel(), kind="stable")
        met, first = np.unique(words.T.ravel()[by_place], return_index=True)
        for i, k in enumerate("fb"):
            u, d_h = p[f"U{k}"], np.zeros((len(words), h), np.float32)
            d_u, steps = np.zeros_like(u), np.empty((WINDOW, len(words), 3 * h), np.float32)
            own = slice(i * h, (i + 1) * h)
            for t, before, z, r, n, hn in reversed(keep["kept"][k]):
                d = d_h + d_score[t][:, None] * p["q"][own] + d_value[t][:, None] * p["w"][own]
                m = live[:, t, None]
                d_n = d * (1 - z) * (1 - n * n) * m
                d_z, d_r = d * (before - n) * z * (1 - z) * m, d_n * hn * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_n * r], 1)
                d_h = np.where(m, d * z, d) + d_hu @ u.T
                d_u += before.T @ d_hu
                steps[t] = np.concatenate([d_z, d_r, d_n], 1)
            d_gates = np.zeros((len(x), 3 * h), np.float32)
            d_gates[met] = np.add.reduceat(steps.reshape(-1, 3 * h)[by_place], first, axis=0)
            g |= {f"U{k}": d_u, f"W{k}": x.T @ d_gates, f"c{k}": d_gates.sum(0)}
            dx += d_gates @ p[f"W{k}"].T
        at, sizes = corpus.spans(used)
        for name, slot, d in (("Ew", corpus.word[used], dx[:-1, 3 : 3 + EMBED]), ("Ec", corpus.gram[at], np.repeat(dx[:-1, 3 + EMBED :] / sizes[:, None], sizes, axis=0))):
            g[name] = np.stack([np.bincount(slot % ROWS, d[:, j], ROWS) for j in range(EMBED)], 1).astype(np.float32)
        return g


class Model:
    """odds, network and calibration; `flat` is the score of every text with words where nothing could be learned."""

    def __init__(self, texts: list[str], toxic: np.ndarray, share: float, seed: int = 7):
        toxic = np.asarray(toxic, np.int64)
        self.flat = None
        if not 0 < toxic.sum() < len(toxic):
            self.flat = float(toxic.mean()) if len(toxic) else 0.0
            return
        halves = [np.arange(len(texts)) % 2 == k for k in (0, 1)]
        corpora = [Corpus(pa.array([t for t, own in zip(texts, half, strict=True) if own], pa.large_string())) for half in halves]
        counts = [slot_counts(c, toxic[half]) for c, half in zip(corpora, halves, strict=True)]
        odds = [odds_of(x, toxic[half].sum(), (1 - toxic[half]).sum()) for x, half in zip(counts, halves, strict=True)]
        release()
        self.net, r = Network(seed), np.random.default_rng(seed)
        sets = []
        for k, corpus in enumerate(corpora):
            words, doc = corpus.windows()
            sets.append((corpus, odds[1 - k], words, doc, toxic[halves[k]]))
        moments: dict = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items()}
        step = 0
        while step < STEPS:
            for corpus, odd, words, doc, target in sets:
                if not len(doc):
                    continue
                if step < STEPS // 3:
                    x = corpus.inputs(np.arange(corpus.n), odd, (self.net.p["Ew"], self.net.p["Ec"]))
                    ranks = (np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0))[words].max(1)
                else:
                    ranks = self.logits(corpus, odd, words)
                order = np.lexsort((-ranks, doc))
                nth = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
                picked = order[nth < np.where(target[doc[order]] == 1, 1, 3)]
                clean = np.flatnonzero(target[doc] == 0)
                toxic_picked = picked[target[doc[picked]] == 1]
                for _ in range(STEPS // 6):
                    own = np.concatenate([r.choice(part, n) for part, n in ((toxic_picked, 32), (picked, 80), (clean, 16)) if len(part)])
                    step += 1
                    for k, g in self.net.gradients(corpus, odd, words[own], target[doc[own]]).items():
                        m, v = moments[k]
                        m += 0.1 * (g - m)
                        v += 0.01 * (g * g - v)
                        self.net.p[k] -= (0.02 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if not any(len(s[3]) for s in sets):
                break
        if not any(len(s[3]) for s in sets):  # no labelled text has a word
            self.flat = 0.0
            return
        tops, labels = [], []
        for corpus, odd, words, doc, target in sets:
            top = self.tops(corpus, odd)
            tops.append(top[np.isfinite(top)])
            labels.append(target[np.isfinite(top)])
        self.scale, self.shift = self._calibrate(np.concatenate(tops), np.concatenate(labels), max(share, PRIOR))
        # Slots are hashes of what they count, so the halves' counts add up.
        self.odds = odds_of(counts[0] + counts[1], toxic.sum(), (1 - toxic).sum())

    @staticmethod
    def _calibrate(top: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
        """Logistic fit of one logit by gradient steps, the classes weighted to their share among all labels."""
        weight = np.where(toxic == 1, share / max(1, toxic.sum()), (1 - share) / max(1, (1 - toxic).sum()))
        mid, spread = top.mean(), top.std() + 1e-6
        a, b = 1.0, 0.0
        for _ in range(3000):
            e = weight * (sigmoid(a * (top - mid) / spread + b) - toxic)
            a, b = a - 2 * ((e * (top - mid) / spread).sum() + 1e-4 * a), b - 2 * e.sum()
        return a / spread, b - a * mid / spread

    def logits(self, corpus: Corpus, odds: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
        x = corpus.inputs(np.arange(corpus.n), odds, (self.net.p["Ew"], self.net.p["Ec"]))
        return np.concatenate([np.zeros(0, np.float32), *(self.net.forward(x, words[i : i + 2048]) for i in range(0, len(words), 2048))])

    def tops(self, corpus: Corpus, odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Highest window logit of each text, -inf without words."""
        words, doc = corpus.windows()
        top = np.full(len(corpus.ends), -np.inf)
        np.maximum.at(top, doc, self.logits(corpus, odds, words))
        return top

    def score(self, texts: pa.Array) -> np.ndarray:
        corpus = Corpus(texts)
        if self.flat is not None:
            return np.where(np.diff(corpus.ends, prepend=0) > 0, self.flat, 0.0)
        top = self.tops(corpus, self.odds)
        return np.where(np.isfinite(top), sigmoid(self.scale * np.where(np.isfinite(top), top, 0) + self.shift), 0.0)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC, clean_rows: int = CLEAN) -> Model:
    """From labels whose crc32(doc_id) mod 3 is not 1 and the documents they name."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for value, most in ((1, toxic_rows), (0, clean_rows)):
        own = sample(known.where(F.col("toxic") == value), "toxic", most, seed=3)
        picked = own if picked is None else picked.unionByName(own)
    # At most about toxic_rows + clean_rows labels are left, so they may be broadcast whatever the size of the corpus.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    got = own.join(F.broadcast(picked), "doc_id").groupBy("pick", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["pick"], r["doc_id"], r["text"] or ""))
    texts, toxic = [r["text"] or "" for r in got], np.array([r["toxic"] for r in got], np.int64)
    del got
    model = Model(texts, toxic, sizes.get(1, 0) / max(1, sum(sizes.values())))
    release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (score at least THRESHOLD)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SCORE_BYTES):
                got = shared.value.score(b.column("text"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64()), pa.array((got >= THRESHOLD).astype(np.int32))], [*b.schema.names, "score", "predicted"])
        release()

    return docs.mapInArrow(run, columns(docs, "score double, predicted int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents that are predicted toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return own_names(score(plain_names(docs), model).where("predicted = 0"), docs)
