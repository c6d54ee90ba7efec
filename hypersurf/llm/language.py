"""Language ID by cross-parsing entropy.

Each language's labelled text gives a suffix automaton.  A text is parsed greedily into the longest matches with that
text: every phrase is the longest string at its place that occurs in it (a single character where none does).  k phrases cost
k * log2(N), N being the characters of the largest training text: one measure for all languages, so that one with little labelled text has
longer texts' phrases at the same price, not cheaper ones.  The language of least cost wins, the first by name of equals.

Each language has an alphabet of its own, of all letters of its training text; a letter that is not in it matches nowhere.
The automaton's failures lead to the root and count a phrase, which makes it a transition table: plain for the DENSE
commonest letters, and the transitions that exist, sorted, for the others.  Texts are walked side by side, one
lookup a character, in stretches of SEGMENT characters: a phrase ends with its stretch, in every language and in texts of every length
alike, which adds about one phrase in 200.  Upper and lower case are one; everything between letters is one space.

Training is bounded: every labelled text is cut into consecutive pieces of PIECE characters (the last one shorter), and about SAMPLE pieces a language
are picked by a hash of id and place over all pieces of all rows, so that each part of each text is as likely to be learned.  The tables (at most
2 * SAMPLE * PIECE states of DENSE classes and 3 * SAMPLE * PIECE other transitions a language) go to executors by Spark's broadcast.
Prediction is one pass without a shuffle.

The pipeline's stage rejects a text in none of the learned languages: one whose cost, less that of two phrases for its ends, is above
a bound a letter.

Cases: null text or no letter gives `und` with score 0; without any labelled row (an empty table, too) every text is `und`; rows with null id
are never in the sample; repeated rows repeat; equal costs go to the first language by name; other columns are ignored, and the stage keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import columns, own_names, plain_names, release, slices, table

SAMPLE, PIECE, SEGMENT, DENSE = 48, 1000, 1024, 64
#: Cost a letter, in bits, above which a text is in none of the learned languages: a letter of a script that no language has
#: costs a phrase each, over 14 bits; text of a learned language costs about 3.  One with a large alphabet costs more, so its
#: bound is half way between its own cost and that of unknown letters if that is higher.
STRANGE = 9.0
#: Text bytes that are predicted together.
PREDICT_BYTES = 1 << 20


class Parser:
    """Total transitions: twice the next state, plus 1 where a phrase ends before this character."""

    def __init__(self, steps: list[dict[int, int]], classes: int):
        self.classes, self.width = classes, min(classes, DENSE)
        self.fresh = np.ones(classes, np.int64)
        for c, to in steps[0].items():
            self.fresh[c] = 2 * to + 1
        self.dense = np.tile(self.fresh[: self.width].astype(np.int32), (len(steps), 1))
        at = np.fromiter((s * classes + c for s, step in enumerate(steps) for c in step), np.int64)
        to = np.fromiter((2 * x for step in steps for x in step.values()), np.int64)
        common = at % classes < self.width
        self.dense[at[common] // classes, at[common] % classes] = to[common]
        order = np.argsort(at[~common])
        self.keys, self.next = at[~common][order], to[~common][order]

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.classes == self.width:
            return self.dense.ravel()[state * self.width + c]
        got = self.dense.ravel()[state * self.width + np.minimum(c, self.width - 1)].astype(np.int64)
        rare = np.flatnonzero(c >= self.width)
        if len(rare):
            key = state[rare] * self.classes + c[rare]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            got[rare] = np.where(self.keys[place] == key, self.next[place], self.fresh[c[rare]])
        return got

    def __getitem__(self, at: tuple[int, int]) -> int:
        state, c = at
        return int(self.step(np.array([state]), np.array([c]))[0]) if c < self.classes else 1


class Automaton:
    """Suffix automaton of a string of character classes."""

    def __init__(self, classes: np.ndarray):
        self.classes = int(classes.max(initial=0)) + 1
        steps, link, length, last = [{}], [-1], [0], 0
        for c in classes.tolist():
            new = len(steps)
            steps.append({})
            link.append(-1)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and c not in steps[at]:
                steps[at][c] = new
                at = link[at]
            if at < 0:
                link[new] = 0
            else:
                old = steps[at][c]
                if length[at] + 1 == length[old]:
                    link[new] = old
                else:
                    copy = len(steps)
                    steps.append(dict(steps[old]))
                    length.append(length[at] + 1)
                    link.append(link[old])
                    while at >= 0 and steps[at].get(c) == old:
                        steps[at][c] = copy
                        at = link[at]
                    link[old] = link[new] = copy
            last = new
        self.steps = steps

    def parser(self) -> Parser:
        return Parser(self.steps, self.classes)


class Model:
    def __init__(self, texts: dict[str, str], bounds: bool = True):
        """texts: training text of each language; bounds: whether to learn the bounds of strange texts."""
        self.names = sorted(texts)
        clean = {k: " ".join("".join(c if c.isalpha() else " " for c in texts[k].lower()).split()) for k in self.names}
        self.names = [k for k in self.names if clean[k]]
        self.classes = {c: i + 2 for i, c in enumerate(sorted(set("".join(clean.values())) - {" "}))}
        self.alphabets, self.tables = [], []
        for k in self.names:
            seen = sorted(Counter(clean[k].replace(" ", "")).items(), key=lambda x: (-x[1], x[0]))
            own = np.ones(len(self.classes) + 2, np.int32)
            own[[0, *(self.classes[c] for c, _ in seen)]] = [0, *range(2, len(seen) + 2)]
            self.alphabets.append(own)
            self.tables.append(Automaton(own[[self.classes.get(c, 0) for c in clean[k]]]).parser())
        self.bits = float(np.log2(max(2, *(len(clean[k]) for k in self.names)))) if self.names else 0.0
        self.bounds = dict.fromkeys(self.names, STRANGE)
        for k, own in zip(self.names, self.alphabets, strict=True):
            if bounds and own.max() >= DENSE:
                first, rest = clean[k][: len(clean[k]) // 2], clean[k][len(clean[k]) // 2 :]
                half = Model({k: first}, bounds=False)
                letters, cost = half.costs([rest], half.code_table())
                self.bounds[k] = max(STRANGE, (cost[0, 0] / half.bits * self.bits / letters[0] + self.bits) / 2)

    def code_table(self) -> np.ndarray:
        """Class of each code point: 0 no letter, 1 a letter of no language."""
        out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)
        for c, k in self.classes.items():
            out[ord(c)] = k
        return out

    def costs(self, texts: list[str | None], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letters, cost of each language) of each text."""
        lowered = [(t or "").lower() for t in texts]
        flat = codes[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        letters = np.bincount(owner[flat > 0], minlength=len(texts))
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] > 0) | (flat[:-1] > 0) | (owner[1:] != owner[:-1])
        flat, owner = flat[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        cuts = -(-sizes // SEGMENT)
        seg_owner = np.repeat(np.arange(len(texts)), cuts)
        within = np.arange(len(seg_owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        starts = (np.cumsum(sizes) - sizes)[seg_owner] + within * SEGMENT
        lengths = np.minimum(SEGMENT, sizes[seg_owner] - within * SEGMENT)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, seg_owner = starts[order], lengths[order], seg_owner[order]
        out = np.zeros((len(texts), len(self.names)))
        live = np.searchsorted(-lengths, -np.arange(1, SEGMENT + 1), side="right") if len(lengths) else []
        for k, (own, parser) in enumerate(zip(self.alphabets, self.tables, strict=True)):
            mine, state, phrases = own[flat], np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
            for t in range(int(lengths[0]) if len(lengths) else 0):
                n = live[t]
                got = parser.step(state[:n], mine[starts[:n] + t])
                state[:n] = got >> 1
                phrases[:n] += got & 1
            out[:, k] = np.bincount(seg_owner, phrases, len(texts)) * self.bits
        return letters, out

    def predict(self, texts: list[str | None], codes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of the winner if costs are read as code lengths tempered by 1/16, and cost a letter beyond two phrases."""
        letters, costs = self.costs(texts, codes)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = costs.argmin(1)
        low = costs.min(1)
        share = 1 / np.exp2(np.maximum((low[:, None] - costs) / 16, -1000)).sum(1)
        none = letters == 0
        return ["und" if z else self.names[i] for i, z in zip(best, none, strict=True)], np.where(none, 0.0, share), np.maximum(low - 2 * self.bits, 0) / np.maximum(letters, 1)


def sample(rows: DataFrame, label: str, per_label: int, seed: int = 0) -> DataFrame:
    """About per_label rows of each value of label, by a hash of doc_id over all rows, with that hash as `pick`."""
    pick = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << 31) - 1)
    sizes = rows.groupBy(label).count().where(F.col(label).isNotNull()).collect()
    limit = F.lit(-1)
    for r in sizes:
        limit = F.when(F.col(label) == F.lit(r[0]), F.lit(min(1 << 31, int((1 << 31) * min(1.0, per_label / r[1]))))).otherwise(limit)
    return rows.withColumn("pick", pick).where(F.col("pick") < limit)


def fit(docs: DataFrame, pieces: int = SAMPLE, piece: int = PIECE) -> Model:
    """From doc_id, text, lang of the documents whose crc32(doc_id) mod 5 is not 0."""
    known = docs.where("lang is not null and doc_id is not null and text is not null and length(text) > 0").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.select("doc_id", "lang", "text", F.ceil(F.length("text") / piece).cast("int").alias("n"))
    pick = F.xxhash64("doc_id", "at").bitwiseAND((1 << 31) - 1)
    limit = F.lit(-1)
    for r in known.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        limit = F.when(F.col("lang") == F.lit(r["lang"]), F.lit(min(1 << 31, int((1 << 31) * min(1.0, pieces / r["n"]))))).otherwise(limit)
    # Only the places that are picked are exploded, so a long text isn't copied for each of its pieces.
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.xxhash64("doc_id", k).bitwiseAND((1 << 31) - 1) < limit)
    got = known.select("doc_id", "lang", "text", F.explode(places).alias("at")).select("lang", "doc_id", "at", pick.alias("pick"), F.expr(f"substring(text, at * {piece} + 1, {piece})").alias("text"))
    held: dict[str, list[str]] = {}
    for r in sorted(got.collect(), key=lambda r: (r["pick"], r["doc_id"], r["at"], r["text"])):
        held.setdefault(r["lang"], []).append(r["text"])
    return Model({k: " ".join(v) for k, v in held.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and cost (bits a letter)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value.code_table()
        for batch in batches:
            for b in slices(batch, "text", PREDICT_BYTES):
                langs, scores, costs = shared.value.predict(b.column("text").to_pylist(), codes)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(costs)], [*b.schema.names, "lang_pred", "score", "cost"])
        release()

    return docs.mapInArrow(run, columns(docs, "lang_pred string, score double, cost double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "cost")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents without letters and those in none of the learned languages."""
    model = fit(docs)
    bound = F.lit(STRANGE)
    for k, most in model.bounds.items():
        bound = F.when(F.col("lang_pred") == F.lit(k), F.lit(float(most))).otherwise(bound)
    got = predict(plain_names(docs), model)
    return own_names(got.where((F.col("lang_pred") != "und") & (F.col("cost") <= bound)), docs)
