"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import U64, bounded_batches, lists, pieces, tidied, utf8
from provspark.llm.words import hash_of, letters, prefix_sums, span_hash, split
from provspark.session import cut_lineage

#: Words of the lexicon voters, one voter per line.
LEXICONS = (
    "idiot moron imbecile fool dumb stupid",
    "loser pathetic worthless useless failure",
    "scum trash garbage filth vermin",
    "clown disgusting ugly freak creep",
    "bastard bitch asshole shit fuck damn crap",
    "hate kill murder destroy hurt burn",
)
#: Pattern voters, over the lower-cased text.
PATTERNS = (
    rb"\byou(?:'re| are) (?:an? |so |such an? |all )?(?:idiot|moron|fool|loser|clown|stupid|pathetic|worthless|disgusting|scum|trash)",
    rb"\b(?:shut up|go away|get lost|drop dead|kill yourself)\b",
    rb"\b[a-z]{1,2}[*#$@]{2,}[a-z]{0,4}\b",
)
#: Terms are words and their first bytes, as many as these; a prefix's hash differs from that of the same word.
PREFIXES, PREFIX = (4, 5, 6, 7, 8), U64(0xA5A5A5A55A5A5A5A)
#: Bounds of the sample, per label, and of documents whatever their labels (about).
PER_LABEL, ANY = 4000, 4000
#: Candidates for terms, terms of the learned voters, these voters, terms of a context, terms of the classifier.
CANDIDATES, LEARNED, GROUPS, CONTEXT, TERMS = 2048, 96, 6, 32, 384
FIXED = len(LEXICONS) + len(PATTERNS)
VOTERS = FIXED + GROUPS
#: Bits of a vote pattern: one per voter, then the context (0: none), then the label (0: none, 1: clean, 2: toxic).
CONTEXT_AT, LABEL_AT = VOTERS, VOTERS + 4
#: A voter's silence tells something only in contexts where it fires on so many of the toxic texts.
COMPETENT = 0.05


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, word) pairs, each once, of the batch's distinct words, and the hashes of each word's terms: a row per word
    with the word itself and its prefixes, 0 where it is too short."""
    normal = letters()
    words = split(raw, offsets, normal)
    value, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, size = words.start[at], words.end[at] - words.start[at]
    table = np.zeros((len(value), 1 + len(PREFIXES)), U64)
    table[:, 0] = value
    if len(value):
        sums = prefix_sums(normal[raw])
        for i, k in enumerate(PREFIXES):
            long = size > k
            table[long, i + 1] = span_hash(sums, start[long], start[long] + k) ^ PREFIX
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    pair = np.unique(doc * max(len(value), 1) + which)
    return np.stack([pair // max(len(value), 1), pair % max(len(value), 1)]), table


def look_up(terms: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, number in the sorted ``wanted``), each pair once, for the terms of a batch."""
    (doc, word), table = terms
    if not len(wanted) or not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, table), len(wanted) - 1)
    hit = wanted[at] == table
    some = hit.any(axis=1)
    keep = some[word]
    doc, word = doc[keep], word[keep]
    row, column = np.nonzero(hit[word])
    pair = np.unique(doc[row] * len(wanted) + at[word[row], column])
    return pair // len(wanted), pair % len(wanted)


@dataclass
class Voters:
    """Term hashes, sorted, with the voter of each, and those that tell a text's context."""

    term: np.ndarray
    voter: np.ndarray
    context_term: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, groups: list[list[int]], contexts: list[list[int]]) -> Voters:
        """The fixed lists and the groups of learned terms; a term of both is a fixed one."""
        voter = {h: FIXED + g for g, terms in enumerate(groups) for h in terms}
        voter |= {hash_of(w.encode()): k for k, line in enumerate(LEXICONS) for w in line.split()}
        context = {h: c for c, terms in enumerate(contexts) for h in terms}
        halves = []
        for found in (voter, context):
            order = sorted(found)
            halves += [np.array(order, U64), np.array([found[h] for h in order], np.int64)]
        return cls(*halves)

    def plain(self) -> tuple:
        return self.term, self.voter, self.context_term, self.context


def votes_of(raw: np.ndarray, offsets: np.ndarray, voters: tuple) -> np.ndarray:
    """The vote pattern of each document: a bit per voter that fires, and the number of the context."""
    term, voter, context_term, context = voters
    n = len(offsets) - 1
    terms = terms_of(raw, offsets)
    bits = np.zeros(n, np.int64)
    doc, hit = look_up(terms, term)
    np.bitwise_or.at(bits, doc, np.int64(1) << voter[hit])
    parted = np.insert(raw, offsets[1:-1], 0)  # no pattern reaches over the end of a document
    begins = offsets[:-1] + np.arange(n)
    text = parted.tobytes().lower()
    for k, pattern in enumerate(PATTERNS):
        places = np.fromiter((m.start() for m in re.finditer(pattern, text)), np.int64)
        doc = np.unique(np.searchsorted(begins, places, side="right") - 1)
        np.bitwise_or.at(bits, doc, np.int64(1) << (len(LEXICONS) + k))
    share = np.zeros((n, GROUPS + 1))
    share[:, 0] = 1.5  # fewer than two terms of a context are none
    doc, hit = look_up(terms, context_term)
    np.add.at(share, (doc, context[hit] + 1), 1)
    return bits | (share.argmax(axis=1) << CONTEXT_AT)


def as_matrix(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(VOTERS) & 1).astype(float)


def context_of(bits: np.ndarray) -> np.ndarray:
    return bits >> CONTEXT_AT & 15


@dataclass
class LabelModel:
    """Chance of each voter to fire on toxic and on clean texts, how far its vote repeats others', and where it is heard.

    A voter votes toxic when it fires, and clean when it is silent in a context it knows; elsewhere silence is no vote.
    Known labels are one more voter, with chances of their own.
    """

    prior: float = 0.05
    toxic: np.ndarray = field(default_factory=lambda: np.full(VOTERS, 0.5))
    clean: np.ndarray = field(default_factory=lambda: np.full(VOTERS, 0.02))
    correlation: np.ndarray = field(default_factory=lambda: np.eye(VOTERS))
    discount: np.ndarray = field(default_factory=lambda: np.ones(VOTERS))
    heard: np.ndarray = field(default_factory=lambda: np.ones((GROUPS + 1, VOTERS), bool))
    labelled: tuple[float, float] = (0.9, 0.02)  # chance of the label toxic on toxic and on clean texts

    def posterior(self, bits: np.ndarray, with_labels: bool = True) -> np.ndarray:
        """P(toxic | votes, label); a vote that repeats others' counts as the share that is its own."""
        votes = as_matrix(bits)
        silent = (1 - votes) * self.heard[context_of(bits)]
        odds = votes * np.log(self.toxic / self.clean) + silent * np.log((1 - self.toxic) / (1 - self.clean))
        total = (odds * self.discount).sum(axis=1) + np.log(self.prior / (1 - self.prior))
        if with_labels:
            label, (t, c) = bits >> LABEL_AT, self.labelled
            total += np.where(label == 2, np.log(t / c), np.where(label == 1, np.log((1 - t) / (1 - c)), 0))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))

    @classmethod
    def fit(cls, bits: np.ndarray, count: np.ndarray, rounds: int = 40) -> LabelModel:
        """Expectation maximisation over the distinct vote patterns and their counts, twice: as if voters were
        independent, then with the correlations that are left within each class.

        It starts from the voters' chances on labelled texts, and labels are heard as a voter in every round, so that the
        classes stay those of the labels. Without labels it starts from the prior's defaults.
        """
        model = cls()
        if not count.sum():
            return model
        votes, label, context = as_matrix(bits), bits >> LABEL_AT, context_of(bits)
        known = count * (label > 0)
        q = np.where(label == 2, 1.0, np.where(label == 1, 0.0, np.nan))
        if known[label == 2].sum() and known[label == 1].sum():
            for c in range(GROUPS + 1):
                there = count * (label == 2) * (context == c)
                if there.sum():
                    model.heard[c] = (there @ votes) / there.sum() >= COMPETENT
            model._estimate(votes, context, np.nan_to_num(q) * known, (1 - np.nan_to_num(q)) * known)
            model.prior = float(np.clip(known[label == 2].sum() / known.sum(), 1e-4, 0.5))
        for _ in range(2):
            for _ in range(rounds):
                q = model.posterior(bits) * count
                model.prior = float(np.clip(q.sum() / count.sum(), 1e-4, 0.5))
                model._estimate(votes, context, q, count - q)
                said = [(w[label == 2].sum() + a) / (w[label > 0].sum() + a + b) for w, a, b in ((q, 90, 10), (count - q, 2, 98))]
                model.labelled = float(np.clip(said[0], 0.6, 0.999)), float(np.clip(said[1], 1e-4, 0.2))
            model._correlate(bits, votes, context, count)
        return model

    def _estimate(self, votes: np.ndarray, context: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """Chances from the weights of the classes; texts where a voter is not heard count only where it fires."""
        heard = np.maximum(self.heard[context], votes)
        self.clean = np.clip((clean @ votes + 0.1) / (clean @ heard + 10), 1e-5, 0.5)
        # a voter that fires speaks for toxic: its chance there is no lower
        self.toxic = np.clip((toxic @ votes + 1) / (toxic @ heard + 2), self.clean, 0.999)

    def _correlate(self, bits: np.ndarray, votes: np.ndarray, context: np.ndarray, count: np.ndarray) -> None:
        q = self.posterior(bits) * count
        heard = np.maximum(self.heard[context], votes)
        pooled = np.zeros((VOTERS, VOTERS))
        for weight, mean in ((q, self.toxic), (count - q, self.clean)):
            rest = (votes - mean) * heard
            pooled += (rest * weight[:, None]).T @ rest
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.correlation = pooled / np.outer(scale, scale)
        np.fill_diagonal(self.correlation, 1.0)
        self.discount = 1 / np.maximum(self.correlation * (self.correlation > 0.1), 0).sum(axis=1)


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """(text, toxic, weight): about ``PER_LABEL`` labelled documents of each label and ``ANY`` of all that may teach,
    whose ``toxic`` is null, by a hash of their ids.

    ``weight`` is how many rows a sampled one stands for. The sample has a bound, so its ids are broadcast and no text is
    shuffled.
    """
    known = labels.where(may_learn & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, PER_LABEL / size.get(1, 1))).otherwise(min(1.0, PER_LABEL / size.get(0, 1)))
    some = known.where(draw < share).withColumn("weight", 1 / share)
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic", "weight")
    n = docs.where(may_learn).select("doc_id").count()
    part = min(1.0, ANY / max(n, 1))
    other = F.pmod(F.xxhash64(F.lit("any"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rest = docs.where(may_learn & (other < part)).select("text", F.lit(None).cast("int").alias("toxic"), F.lit(1 / part).alias("weight"))
    return labelled.unionByName(rest)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term of a batch: of how many toxic and clean documents it is."""
    for batch in pieces(batches, "text", 1 << 20):
        (doc, word), table = terms_of(*utf8(batch.column("text")))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        value, which = np.unique(table, return_inverse=True)
        pair = np.unique((doc[:, None] * max(len(value), 1) + which.reshape(table.shape)[word]).ravel())
        doc, term = pair // max(len(value), 1), pair % max(len(value), 1)
        n1, n0 = (np.bincount(term[toxic[doc] == k], minlength=len(value)) for k in (1, 0))
        some = value != 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(value[some].view(np.int64)), pa.array(n1[some]), pa.array(n0[some])], ["term", "k1", "k0"]
        )


def _shown(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, votes) -> Iterator[pa.RecordBatch]:
    """(toxic, weight, votes, numbers of the wanted terms) of each document."""
    for batch in pieces(batches, "text", 1 << 20):
        raw, offsets = utf8(batch.column("text"))
        doc, term = look_up(terms_of(raw, offsets), wanted)
        bits = votes_of(raw, offsets, votes) if votes else np.zeros(batch.num_rows, np.int64)
        found = lists(term.astype(np.int32), np.bincount(doc, minlength=batch.num_rows), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), batch.column("weight"), pa.array(bits), found], ["toxic", "weight", "votes", "terms"]
        )


SHOWN = "toxic int, weight double, votes long, terms array<int>"


def _matrix(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), bool)
    for i, r in enumerate(rows):
        x[i, r["terms"]] = True
    return x


def _unlike(x: np.ndarray, order: np.ndarray, most: int, alike: float = 0.8) -> list[int]:
    """Columns in that order, at most so many, none of which hits much the same rows as an earlier one."""
    kept: list[int] = []
    some = x[:, order].astype(np.float32)
    both = some.T @ some
    size = np.diag(both)
    for j in range(len(order)):
        if not (both[j, kept] / np.maximum(size[kept] + size[j] - both[j, kept], 1) > alike).any():
            kept.append(j)
        if len(kept) == most:
            break
    return [int(order[j]) for j in kept]


def _grouped(x: np.ndarray, groups: int) -> np.ndarray:
    """A group for each column, by the rows they hit: centres far from each other, then rounds of spherical k-means."""
    unit = x / np.maximum(np.linalg.norm(x, axis=0), 1e-9)
    chosen = [int(np.argmax(x.sum(axis=0)))]
    while len(chosen) < min(groups, x.shape[1]):
        chosen.append(int(np.argmin((unit[:, chosen].T @ unit).max(axis=0))))
    centre = unit[:, chosen]
    for _ in range(10):
        own = (centre.T @ unit).argmax(axis=0)
        for g in range(centre.shape[1]):
            if (own == g).any():
                centre[:, g] = unit[:, own == g].sum(axis=1)
        centre /= np.maximum(np.linalg.norm(centre, axis=0), 1e-9)
    return (centre.T @ unit).argmax(axis=0)


def _choose(terms: np.ndarray, rows: list) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """(terms of each learned voter, terms of each context, terms of the classifier) from the sample's hits."""
    x, toxic = _matrix(rows, len(terms)), np.array([r["toxic"] == 1 for r in rows], bool)
    clean = np.array([r["toxic"] == 0 for r in rows], bool)
    n1, n0 = max(toxic.sum(), 1), max(clean.sum(), 1)
    k1, k0 = x[toxic].sum(axis=0), x[clean].sum(axis=0)
    z = _z(k1, k0, n1, n0)
    lift = (k1 + 0.5) / n1 / ((k0 + 0.5) / n0)
    telling = np.flatnonzero((z > 6) & (lift > 12))
    telling = telling[np.argsort(-z[telling], kind="stable")]
    picked = _unlike(x[toxic], telling, LEARNED)
    groups: list[list[int]] = [[] for _ in range(GROUPS)]
    contexts: list[list[int]] = [[] for _ in range(GROUPS)]
    if picked:
        own = _grouped(x[toxic][:, picked].astype(float), GROUPS)
        for g in range(GROUPS):
            columns = [picked[i] for i in np.flatnonzero(own == g)]
            groups[g] = [int(terms[j]) for j in columns]
            there = x[:, columns].any(axis=1) & toxic
            if columns and there.any():  # what marks texts like those it fires on, clean ones too: frequent terms
                inside, outside = x[there].mean(axis=0), x[toxic & ~there].mean(axis=0) if (toxic & ~there).any() else 0
                base = x[clean].mean(axis=0) if clean.any() else np.zeros(len(terms))
                shown = np.where(base > 0.02, inside - outside, -1.0)
                best = np.argsort(-shown, kind="stable")[:CONTEXT]
                contexts[g] = [int(terms[j]) for j in best if shown[j] > 0.1]
    order = np.argsort(-np.abs(z), kind="stable")
    return groups, contexts, terms[_unlike(x, order[np.abs(z[order]) > 3], TERMS, 0.95)]


def _z(k1, k0, n1, n0):
    """How far apart the shares of two classes are, in standard deviations."""
    p = (k1 + k0) / (n1 + n0)
    return (k1 / n1 - k0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)


@dataclass
class Classifier:
    """Terms, sorted, and their weights."""

    terms: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration by the sample's labels
    shift: float = 0.0

    def plain(self) -> tuple:
        return self.terms, self.weight, self.bias, self.slope, self.shift


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    classifier: Classifier


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """Votes are counted on every document that may teach; labels choose learned terms, anchor the label model, and
    calibrate scores.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; ``may_learn`` is a condition on doc_id. Without labels
    there are no learned voters and no calibration; without votes every posterior is the prior. Of a document with several
    labels the highest counts in the votes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = cut_lineage(sample(docs, labels, may_learn))
    counts = rows.where("toxic is not null").mapInArrow(tidied(_term_counts), "term long, k1 long, k0 long")
    counts = counts.groupBy("term").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = float(max(size.get(1, 0), 1)), float(max(size.get(0, 0), 1))
    p = (F.col("k1") + F.col("k0")) / (n1 + n0)
    gap = (F.col("k1") / n1 - F.col("k0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    counts = cut_lineage(counts.where("k1 + k0 >= 5").withColumn("z", gap))
    best = counts.orderBy(F.desc("z"), "term").limit(CANDIDATES // 2)
    common = counts.orderBy(F.desc(F.col("k1") + F.col("k0")), "term").limit(CANDIDATES // 2)  # these tell contexts
    candidates = np.unique(np.array([r["term"] % (1 << 64) for r in best.union(common).select("term").collect()], U64))
    labelled = rows.where("toxic is not null")
    hits = labelled.mapInArrow(tidied(lambda b: _shown(b, candidates, None)), SHOWN).collect()  # of the bounded sample
    hits.sort(key=lambda r: (r["toxic"], r["terms"]))
    groups, contexts, strong = _choose(candidates, hits)
    voters = Voters.of(groups, contexts)
    held = spark.sparkContext.broadcast(voters.plain())  # LEARNED and CONTEXT terms, and the fixed lists

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            bits = votes_of(*utf8(batch.column("text")), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], ["doc_id", "votes"])

    known = labels.where(may_learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg((F.max("toxic") + 1).cast("long").alias("label"))
    voted = docs.where(may_learn).select("doc_id", "text").mapInArrow(tidied(vote), "doc_id long, votes long")
    # votes meet the labels, and no text is shuffled
    voted = voted.join(known, "doc_id", "left").withColumn("label", F.shiftleft(F.coalesce("label", F.lit(0).cast("long")), LABEL_AT))
    patterns = voted.groupBy(F.col("votes").bitwiseOR(F.col("label")).alias("votes")).agg(F.count("*").alias("n"))
    patterns = patterns.collect()  # at most 2 ** VOTERS * 3 * (GROUPS + 1), whatever the documents
    label_model = LabelModel.fit(np.array([r["votes"] for r in patterns], np.int64), np.array([r["n"] for r in patterns], float))
    fixed = np.array([hash_of(w.encode()) for line in LEXICONS for w in line.split()], U64)
    chosen = np.unique(np.concatenate([fixed, strong.astype(U64), voters.term]))
    shown = rows.mapInArrow(tidied(lambda b: _shown(b, chosen, held.value)), SHOWN).collect()  # of the bounded sample
    return Model(voters, label_model, _fit(shown, voters, label_model, chosen))


def _fit(rows: list, voters: Voters, labels: LabelModel, terms: np.ndarray) -> Classifier:
    """Logistic regression with an L1 penalty on the posteriors, then a slope and shift fitted to the labels."""
    if not any(r["toxic"] is not None for r in rows):
        return Classifier(terms, np.where(np.isin(terms, voters.term), 3.0, 0.0), -3.0)
    rows = sorted(rows, key=lambda r: (r["toxic"] is not None, r["toxic"] or 0, r["votes"], r["terms"]))
    row = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    column = np.concatenate([np.array(r["terms"], np.int64) for r in rows])
    toxic = np.array([-1 if r["toxic"] is None else r["toxic"] for r in rows])
    bits = np.array([r["votes"] for r in rows], np.int64) | (toxic + 1) << LABEL_AT
    weight = np.array([r["weight"] for r in rows])
    w, b = _logistic(row, column, np.ones(len(row)), len(terms), labels.posterior(bits), np.sqrt(weight / weight.mean()), 2e-4)
    known = np.flatnonzero(toxic >= 0)
    score = (np.bincount(row, w[column], minlength=len(rows)) + b)[known]
    own = weight[known] / weight[known].mean()
    slope, shift = _logistic(np.arange(len(known)), np.zeros(len(known), int), score, 1, toxic[known].astype(float), own, 0.0)
    return Classifier(terms, w, b, max(float(slope[0]), 1e-3), shift)


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 2000):
    """Accelerated proximal gradient on the weighted log loss of a sparse matrix; y may be a probability."""
    times = lambda w: np.bincount(row, value * w[column], minlength=len(y))
    back = lambda g: np.bincount(column, value * g[row], minlength=width)
    scale = weight.sum()
    v, c, gram = np.ones(width), 1.0, 0.0
    for _ in range(60):  # largest eigenvalue, of the matrix with a column of ones
        size = np.sqrt(v @ v + c * c)
        u = (times(v / size) + c / size) * weight
        v, c = back(u), u.sum()
        gram = np.sqrt(v @ v + c * c)
    step = 1 / max(1.05 * gram / scale / 4, 1e-9)
    w, b = np.zeros(width), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(times(vw) + vb, -50, 50))) - y) * weight / scale
        nw = vw - step * back(g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        if max(np.abs(nw - w).max(initial=0), abs(nb - b)) < 1e-6:
            w, b = nw, nb
            break
        w, b, t = nw, nb, nt
    return w, float(b)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score``, from 0 to 1; null and empty texts score as texts without any term.

    Whole texts are read; repeated rows score alike. A column of ``docs`` named score is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.classifier.plain())  # TERMS, LEARNED and the fixed lists
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, bias, slope, shift = held.value
        for batch in pieces(batches, text, 1 << 20):
            doc, hit = look_up(terms_of(*utf8(batch.column(text))), terms)
            value = bias + np.bincount(doc, weight[hit], minlength=batch.num_rows)
            value = 1 / (1 + np.exp(-np.clip(slope * value + shift, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(value)], [*rest, "score"])

    chosen = docs.select(*(F.col(f"`{c}`") for c in rest))
    return chosen.mapInArrow(tidied(run), chosen.withColumn("score", F.lit(0.0).cast("double")).schema)
