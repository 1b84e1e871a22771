"""Toxicity by weak supervision.

Voters. Lexicon voters hold words and stems whose document frequencies differ most between toxic
and other labelled texts (learned from at most `max_labelled` labelled rows outside the
held-out fold, drawn by a hash; dealt to several voters by rank). General voters know
nothing of the labels: a list of common English insults, any of these with letters
replaced by look-alikes, insults in direct address, shouting, repeated hits and the
absence of any hit. A listed insult that the labelled texts show to be an ordinary word
of theirs is silent. Each votes toxic, not toxic, or not at all.

Label model. Voters' joint votes are counted over all documents outside the held-out
fold. Expectation-maximisation fits a generative model of a hidden label with one tree
of dependences between voters (Chow-Liu on their mutual information given the label),
so it has each voter's accuracy and the correlations along the tree; rows with labels
keep these. It yields a posterior label for every combination of votes.

Classifier. A logistic regression on votes and text measures is trained on posterior
labels of at most `max_fit` rows drawn by a hash, weighted as documents are; it scores
every document from measures taken over its whole text.

Defined results: null or empty texts are scored as texts without hits; a null id is not
held out; without labelled rows the general voters alone decide; equal rows get equal
scores; labels, lang, source and ids are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .decontaminate import TO_WORDS
from .near_dedup import shingle_sets

GROUPS = 6
#: the weight of one text in the lexicon's sums
SHARE = 1 << 20
#: words that are insults or swear words of English in nearly all their uses, by no table's count
INSULTS = """arse arsehole ass asshat asshole bastard bastards bigot bigots bimbo bitch bitches blockhead bollocks bonehead bozo
brainless brat buffoon bullshit clown clowns coward cowards crap creep creeps cretin damn degenerate despicable
dickhead dimwit dipshit disgusting dolt douche dumb dumbass dummy dunce fatso filth filthy fuck fucker fucking garbage
gutless halfwit hate hateful idiot idiotic idiots ignoramus imbecile imbeciles jackass jerk jerks knucklehead loser
losers lowlife lunatic maggot maniac mongrel moron moronic morons muppet nitwit numbskull nutcase oaf parasite
parasites pathetic piss prat repulsive retard retarded revolting rubbish scoundrel scum scumbag scumbags shit shitty
sicko simpleton slob slut spineless stupid stupidity sucker trash twat twit ugly vermin vile wanker weakling weirdo
whore wimp witless worthless wretch""".split()
_ALIKE = {"a": "[a@4*]", "e": "[e3*]", "i": "[i1!*]", "l": "[l1]", "o": "[o0*]", "s": "[s5$]", "t": "[t7+]", "u": "[u*]"}
#: an insult of at least four letters, spelled plainly or with look-alikes
HIDDEN = r"(?i)\b(?:" + "|".join("".join(_ALIKE.get(c, c) for c in w) for w in INSULTS if len(w) > 3) + r")\b"
ADDRESS = r"(?i)\b(?:you|he|she|they|u)(?: are|'re| is|'s)? (?:such )?(?:an? |the )?(?:fucking |stupid |total |complete )?(?:" + "|".join(INSULTS) + r")\b"
VOTERS = [*(f"learned{g}" for g in range(GROUPS)), "insults", "hidden", "address", "shouting", "repeated", "none"]
MEASURES = [*(f"hits{g}" for g in range(GROUPS)), "insults", "hidden", "address", "density", "upper", "marks", "length"]


#: leading characters of longer words that may be an entry of the lexicon, written with a star
STEMS = (4, 5, 6, 7)


def entries(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def lexicon(texts: DataFrame, most: int = 240, least_docs: int = 4) -> tuple[list[str], list[str]]:
    """Words and stems that tell toxic texts, best first, and listed insults that do not, from rows (text, toxic).

    Texts with the same smallest shingle hash (copies, mostly) count as one together, each
    with its share, so that what only a group of copies has is no sign of its own.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.steps(batches):
            sets = shingle_sets(base.strings(base.col(b, "text")), 5)
            yield pa.RecordBatch.from_arrays([base.col(b, "text"), base.col(b, "toxic"), pa.array([int(s[0]) if len(s) else 0 for s in sets], pa.int64())], ["text", "toxic", "key"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.steps(batches):
            flat, counts = base.split_words(base.translated(base.strings(base.col(b, "text")), TO_WORDS))
            if not len(flat):
                continue
            codes, words = base.coded(flat)
            names: dict[str, int] = {}
            of_word = [[names.setdefault(e, len(names)) for e in entries(w)] for w in words]
            n_own = np.fromiter(map(len, of_word), np.int64, len(words))
            first, own = base.starts_of(n_own), np.fromiter((i for x in of_word for i in x), np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            each = np.unique(doc * len(words) + codes)
            doc, w = each // len(words), each % len(words)
            at = np.repeat(first[w] - np.cumsum(n_own[w]) + n_own[w], n_own[w]) + np.arange(int(n_own[w].sum()))
            each = np.unique(np.repeat(doc, n_own[w]) * len(names) + own[at])
            toxic, share, e = (base.col(b, "toxic").to_numpy() == 1)[each // len(names)], base.col(b, "share").to_numpy()[each // len(names)], each % len(names)
            pos, neg = (np.bincount(e, share * y, len(names)).astype(np.int64) for y in (toxic, ~toxic))
            yield pa.RecordBatch.from_arrays([pa.array(list(names)), pa.array(pos), pa.array(neg)], ["word", "pos", "neg"])

    # whole numbers, so that sums do not hang on their order
    texts = texts.mapInArrow(key, "text string, toxic int, key long")
    texts = texts.join(texts.groupBy("key", "toxic").agg(F.floor(F.lit(SHARE) / F.count("*")).alias("share")), ["key", "toxic"])
    sums = texts.select("text", "toxic", "share").mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg((F.sum("pos") / SHARE).alias("pos"), (F.sum("neg") / SHARE).alias("neg"))
    n = {r.toxic: r.n / SHARE for r in texts.groupBy("toxic").agg(F.sum("share").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return [], []
    share = pos / (pos + neg)
    gain = (F.col("pos") - (F.col("pos") + F.col("neg")) * share) ** 2 / ((F.col("pos") + F.col("neg")) * share * (1 - share))
    tells = F.col("pos") / pos > 8 * F.col("neg") / neg
    good = sums.where(F.col("pos") >= least_docs).withColumn("chi", gain).where((F.col("chi") > 25) & tells)
    silent = sums.where(F.col("word").isin(INSULTS) & (F.col("neg") >= least_docs) & ~tells)
    return [r.word for r in good.orderBy(F.desc("chi"), "word").limit(most).collect()], sorted(r.word for r in silent.collect())


class Lexicon:
    """The lexicon's group of a word (GROUPS: an insult outside the lexicon; -1: none), remembered up to a bound."""

    def __init__(self, words: list[str], silent: list[str] = ()):
        self.listed = {w: GROUPS for w in INSULTS if w not in silent} | {w: i % GROUPS for i, w in enumerate(words)}
        self.known: dict[str, int] = {}

    def find(self, word: str) -> int:
        return next((self.listed[e] for e in entries(word) if e in self.listed), -1)

    def groups(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known.clear()
        out = list(map(self.known.get, words))
        for i, g in enumerate(out):
            if g is None:
                out[i] = self.known[words[i]] = self.find(words[i])
        return np.array(out, np.int64)


def measure(docs: DataFrame, words: list[str], silent: list[str] = ()) -> DataFrame:
    """id, votes (base-3 number, 1 for abstaining), x (measures) of rows (id, text)."""
    insults, long, words = frozenset(INSULTS) - frozenset(silent), frozenset(w for w in INSULTS if len(w) > 3), tuple(words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = base.held(("lexicon", words, insults), lambda: Lexicon(list(words), silent))
        for b in base.steps(batches, keep=("lexicon", words, insults)):
            texts = base.strings(base.col(b, "text"))
            n = len(texts)
            flat, counts = base.split_words(base.translated(texts, TO_WORDS))
            codes, own = base.coded(flat)
            group = listed.groups(own)
            is_long = np.fromiter((w in long for w in own), bool, len(own))
            plain = np.searchsorted(base.starts_of(counts), np.flatnonzero(is_long[codes]), "right") - 1 if len(own) else np.zeros(0, np.int64)
            is_insult = np.fromiter((g >= 0 and w in insults for g, w in zip(group.tolist(), own)), bool, len(own))
            at = np.flatnonzero(group[codes] >= 0) if len(own) else np.zeros(0, np.int64)
            doc, code = np.searchsorted(base.starts_of(counts), at, "right") - 1, codes[at]
            hits = np.bincount(doc * (GROUPS + 1) + group[code], minlength=n * (GROUPS + 1)).reshape(n, GROUPS + 1)
            rude = np.bincount(doc[is_insult[code]], minlength=n)
            alike, address, upper, marks = (pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False).astype(np.float64) for p in (HIDDEN, ADDRESS, "[A-Z]", "!"))
            hidden = np.maximum(alike - np.bincount(plain, minlength=n), 0)  # less those spelled plainly
            size = np.diff(base.raw(texts)[0])
            total = hits.sum(1)
            any_hit = (total > 0) | (hidden > 0) | (address > 0)
            shout = (upper > 0.5 * np.maximum(size, 1)) & (marks >= 3)
            votes = np.stack([*(hits[:, g] > 0 for g in range(GROUPS)), rude > 0, hidden > 0, address > 0, shout, total >= 2, np.where(any_hit, 0, -1)], 1).astype(np.int64)
            number = ((votes + 1) * 3 ** np.arange(len(VOTERS))).sum(1)
            words_n = np.maximum(counts, 1)
            x = np.stack([*(np.log1p(hits[:, g]) for g in range(GROUPS)), np.log1p(rude), np.log1p(hidden), np.log1p(address), np.sqrt(total / words_n), upper / np.maximum(size, 1), np.minimum(marks / words_n, 3), np.log1p(counts) / 10], 1)
            full = np.concatenate([votes != 0, x], 1).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * full.shape[1]), pa.array(full.ravel()))
            yield pa.RecordBatch.from_arrays([base.col(b, "id"), pa.array(number), lists], ["id", "votes", "x"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(emit, f"id {kind}, votes long, x array<float>")


class LabelModel:
    """P(label, votes) with a tree of dependences between voters, fitted to counts of vote combinations."""

    def __init__(self, votes: np.ndarray, free: np.ndarray, labelled: np.ndarray, steps: int = 60):
        """votes: combinations x voters in -1, 0, 1; free: unlabelled counts; labelled: combinations x 2 counts."""
        self.votes = votes + 1
        m = votes.shape[1]
        score = votes.sum(1) + 0.0
        post = 1 / (1 + np.exp(-2 * score))  # majority, until labels or the model say more
        if labelled.sum():
            prior = (labelled[:, 1].sum() + 1) / (labelled.sum() + 2)
            post = np.where(labelled.sum(1) > 0, (labelled[:, 1] + prior) / (labelled.sum(1) + 1), post)
        for _ in range(steps):
            w = np.stack([free * (1 - post), free * post], 1) + labelled
            self._fit(w, m)
            new = self.posterior(self.votes - 1)
            if np.abs(new - post).max(initial=0) < 1e-9:
                break
            post = new
        self.w = np.stack([free * (1 - post), free * post], 1) + labelled

    def _fit(self, w: np.ndarray, m: int) -> None:
        self.prior = np.log((w.sum(0) + 1) / (w.sum() + 2))
        pair = np.zeros((m, m, 2, 3, 3))
        hot = np.eye(3)[self.votes]
        for y in range(2):
            pair[:, :, y] = np.einsum("cia,cjb,c->ijab", hot, hot, w[:, y], optimize=True)
        one = np.einsum("iiyaa->iya", pair) + 0.01
        p = (pair + 0.01 / 3) / (pair.sum((3, 4), keepdims=True) + 0.03)
        pa_, pb = p.sum(4, keepdims=True), p.sum(3, keepdims=True)
        share = np.exp(self.prior)[None, None, :, None, None]
        self.information = (share * p * np.log(p / (pa_ * pb))).sum((2, 3, 4))
        np.fill_diagonal(self.information, -np.inf)
        self.parent, done = [-1] * m, [0]
        self.order = [0]
        while len(done) < m:  # the maximum spanning tree
            i, j = max(((i, j) for i in done for j in range(m) if j not in done), key=lambda e: self.information[e])
            self.parent[j] = i
            done.append(j)
            self.order.append(j)
        self.root = np.log(one[0] / one[0].sum(1, keepdims=True))
        self.given = {j: np.log((pair[self.parent[j], j] + 0.01) / (pair[self.parent[j], j].sum(2, keepdims=True) + 0.03)) for j in self.order[1:]}
        agree = one[:, 1, 2] + one[:, 0, 0]
        self.accuracy = agree / np.maximum(one[:, :, [0, 2]].sum((1, 2)), 1e-9)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes + 1
        ll = np.tile(self.prior, (len(v), 1))
        for y in range(2):
            ll[:, y] += self.root[y][v[:, 0]]
            for j in self.order[1:]:
                ll[:, y] += self.given[j][y][v[:, self.parent[j]], v[:, j]]
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))


def unpack_votes(numbers: np.ndarray) -> np.ndarray:
    return numbers[:, None] // 3 ** np.arange(len(VOTERS)) % 3 - 1


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic regression on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (q - p) + keep * w
        d = np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(keep), g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_fit: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5) -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs."""
    scratch = base.Scratch(docs.sparkSession, "toxic")
    held = base.in_fold(F.col("id"), fold, 0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held)
    # a bounded number of rows, so their ids can be sent to all tasks
    known = scratch.save(known.orderBy(F.xxhash64("id", F.lit(5)), "id", "toxic").limit(max_labelled), "known")
    words, silent = lexicon(rows.join(F.broadcast(known), "id").select("text", "toxic"))
    measured = scratch.save(measure(rows, words, silent).withColumn("held_out", held), "measured")
    train = measured.where(~F.col("held_out"))
    counts = train.groupBy("votes").count().toPandas()  # combinations of votes: at most 2**11 * 2
    seen = train.join(F.broadcast(known), "id").groupBy("votes", "toxic").count().toPandas()
    if not len(counts):
        return measured.select(F.col("id").alias(id_col), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    at = {v: i for i, v in enumerate(counts["votes"])}
    labelled = np.zeros((len(at), 2))
    for v, y, n in seen.itertuples(index=False):
        labelled[at[v], y] += n
    free = np.maximum(counts["count"].to_numpy(float) - labelled.sum(1), 0)
    combos = unpack_votes(counts["votes"].to_numpy())
    model = LabelModel(combos, free, labelled)
    post = dict(zip(counts["votes"].tolist(), model.posterior(combos).tolist()))
    fit = train.orderBy(F.xxhash64("id", F.lit(6)), "id").limit(max_fit).select("votes", "x").toArrow()
    v = fit.column("votes").combine_chunks().to_pylist()
    x = fit.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)
    w = logistic(x, np.array([post[i] for i in v])).tolist()
    z = sum((F.col("x")[i].cast("double") * F.lit(c) for i, c in enumerate(w[:-1])), F.lit(w[-1]))
    score = 1 / (1 + F.exp(-z))
    return measured.select(F.col("id").alias(id_col), "held_out", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))
