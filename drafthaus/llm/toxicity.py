"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, BYTE_LOWER, CHUNK, Words, chunks, give_back, in_batches, mixed, pieces, written

#: Features are hashed to so many bits.
BITS = 20
#: Byte lengths of the word prefixes that are features beside the word itself.
PREFIXES = (4, 5, 6, 7, 8)
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, features) of each distinct word of each text, whatever its case: a row of hashed features, -1 for none."""
    if len(data) <= CHUNK:
        text, _, feats = _word_features(data, at)
        return text, feats
    found = [_word_features(data[a:b], np.array([0, b - a]))[1:] for a, b in pieces(data, NOT_WORD)]  # one long text
    feats = np.concatenate([f for _, f in found])[np.unique(np.concatenate([h for h, _ in found]), return_index=True)[1]]
    return np.zeros(len(feats), np.int64), feats


def _word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = data.copy()
    if len(low) > 1:
        capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[capital] += 0x20
    w = Words(low, at, NOT_WORD, BYTE_LOWER)
    text = np.repeat(np.arange(len(at) - 1), w.count)
    h = w.hashes()
    order = np.lexsort((h, text))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    pick = order[new]
    out = np.full((len(pick), 1 + len(PREFIXES)), -1, np.int32)
    shift = np.uint64(64 - BITS)
    out[:, 0] = h[pick] >> shift
    for k, size in enumerate(PREFIXES, 1):
        long = w.size[pick] > size
        s = w.start[pick][long]
        out[long, k] = mixed((w.sums[s + size] - w.sums[s]) ^ BYTE[size]) >> shift
    return text[pick], h[pick], out


class Model:
    """weights of the hashed features and a bias; score = sigmoid(bias + sum over distinct words)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = np.append(weights, 0.0).astype(np.float32), bias  # -1 finds the 0

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        text, feats = word_features(data, at)
        z = self.bias + np.bincount(text, weights=self.weights[feats].sum(axis=1), minlength=len(at) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def telling_features(df_p: np.ndarray, n_p: int, df_u: np.ndarray, n_u: int, least: int = 3, evidence: float = 16.0) -> np.ndarray:
    """Features that tell confirmed documents from the corpus: those of `least` confirmed documents or more whose share
    among the confirmed is the larger one by a likelihood ratio (G squared) of `evidence`.  df: documents with each."""
    term = lambda k, n, q: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(n * q, 1e-12)), 0.0)
    share = (df_p + df_u) / max(1, n_p + n_u)
    ratio = 2 * (term(df_p, n_p, share) + term(n_p - df_p, n_p, 1 - share) + term(df_u, n_u, share) + term(n_u - df_u, n_u, 1 - share))
    return np.flatnonzero((df_p >= least) & (df_p * n_u > 2 * df_u * n_p) & (ratio >= evidence))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, used: np.ndarray, start: np.ndarray, epochs: int = 60, batch: int = 1024, rate: float = 0.05, decay: float = 1e-3, seed: int = 5) -> Model:
    """rows: features (of those in used) of each document; positive: which are confirmed, the others are unlabelled.

    Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss; when the second part
    of a batch is under 0, the step goes against it instead.  The weights of the used features begin at start.  In the
    end the bias is set so that the share of unlabelled documents over 0.5 is the prior; a document without any of the
    features stays under 0.27.
    """
    size = 1 << BITS
    weights = np.zeros(size)
    if not len(used) or not positive.any() or positive.all() or not 0 < prior < 1:
        return Model(weights, float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999)))))
    name = np.full(size, -1, np.int64)
    name[used] = np.arange(len(used))
    rows = [name[r][name[r] >= 0] for r in rows]
    w, m, v = start.astype(float), np.zeros(len(used)), np.zeros(len(used))
    b, mb, vb = float(np.log(prior / (1 - prior))), 0.0, 0.0
    rng = np.random.default_rng(seed)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    steps = max(1, (len(pos) + len(unl)) // batch)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    t = 0
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(pos), steps), np.array_split(rng.permutation(unl), steps)):
            if not len(p) or not len(u):
                continue
            t += 1
            both = np.concatenate([p, u])
            n = np.array([len(rows[i]) for i in both])
            idx = np.concatenate([rows[i] for i in both])
            doc = np.repeat(np.arange(len(both)), n)
            z = b + np.bincount(doc, weights=w[idx], minlength=len(both))
            s = sigmoid(z)
            sp, su = s[: len(p)], s[len(p) :]
            loss_neg = lambda x: np.log1p(np.exp(np.clip(x, -30, 30)))
            negative = loss_neg(z[len(p) :]).mean() - prior * loss_neg(z[: len(p)]).mean()
            g = np.empty(len(both))
            if negative >= 0:
                g[: len(p)] = prior * ((sp - 1) - sp) / len(p)
                g[len(p) :] = su / len(u)
            else:
                g[: len(p)] = prior * sp / len(p)
                g[len(p) :] = -su / len(u)
            gw = np.bincount(idx, weights=g[doc], minlength=len(used)) + decay * w / steps
            gb = g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    # as many unlabelled documents are to be over 0.5 as the prior says, if they have evidence of some weight at all
    n = np.array([len(rows[i]) for i in unl])
    z = b + np.bincount(np.repeat(np.arange(len(unl)), n), weights=w[np.concatenate([rows[i] for i in unl])], minlength=len(unl))
    b -= max(float(np.quantile(z, 1 - prior)), b + 1.0)
    weights[used] = w
    return Model(weights, b)


def _counts(among: np.ndarray | None):
    """(feature, documents with it) of a task's texts, of the features in among."""

    def run(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                text, feats = word_features(data, at)
                pairs = np.unique((text[:, None] * (1 << BITS) + feats)[feats >= 0])  # a document counts once
                counts += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        if among is not None:
            counts[~among] = 0
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["feature", "docs"])
        give_back()

    return run


def _document_frequencies(texts: DataFrame, among: np.ndarray | None = None) -> np.ndarray:
    """How many of the texts have each feature; added up by feature, so at most a row for each comes to the driver."""
    found = in_batches(texts).mapInArrow(_counts(among), "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[found["feature"].to_numpy()] = found["docs"].to_numpy()
    return out


def _sample_features(used: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                text, feats = word_features(data, at)
                ends = np.searchsorted(text, np.arange(len(at)))
                blobs = [(f := np.unique(feats[a:b]))[(f >= 0) & used[f]].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), pa.array(blobs, pa.binary())], names=["confirmed", "feats"])

    return run


def train(docs: DataFrame, labels: DataFrame, confirmed: int = 4000, unlabelled: int = 8000, usable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the model on at most `confirmed` rows of labels with a 1 and at most `unlabelled` rows of labels whatever
    their label, which these then don't show; and on how many of all documents have a feature.

    Both samples are those with the smallest hash of the id, so reruns agree; usable (a condition on id_col) says which
    ids may be learnt from, all by default.  The corpus counts go over every usable document.  What comes to the driver
    are counts by feature (2 ** 20 at most) and, of the samples, the few features that were chosen.  The class prior is
    the mean of the usable labels.  Null ids and labels are left out; without a confirmed document, every score is
    the prior.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("y")).where(usable & F.col(id_col).isNotNull() & F.col("y").isNotNull())
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    order = F.xxhash64(id_col, F.lit(17))
    p = known.where("y = 1").select(id_col).distinct().orderBy(order, id_col).limit(confirmed).withColumn("confirmed", F.lit(True))
    u = known.select(id_col).distinct().orderBy(order, id_col).limit(unlabelled).withColumn("confirmed", F.lit(False))
    wanted = written(p.unionByName(u))  # two rows for a document in both
    texts = docs.select(id_col, F.col(text_col).alias("text")).where(usable & F.col(id_col).isNotNull())
    sample = texts.join(F.broadcast(wanted), id_col).select("confirmed", "text")
    df_p = _document_frequencies(sample.where("confirmed").select("text"))
    n_p, n_u = sample.where("confirmed").count(), texts.count()
    df_u = _document_frequencies(texts.select("text"), df_p >= 3)
    used = telling_features(df_p, n_p, df_u, n_u)
    mask = np.zeros(1 << BITS, bool)
    mask[used] = True
    rows = in_batches(sample).mapInArrow(_sample_features(mask), "confirmed boolean, feats binary").toArrow()
    rows = sorted(zip(rows["confirmed"].to_pylist(), rows["feats"].to_pylist()))  # in an order that reruns share
    clean = np.maximum((df_u[used] / max(1, n_u) - prior * df_p[used] / max(1, n_p)) / max(1e-9, 1 - prior), 0.5 / max(1, n_u))  # share among the rest
    start = 0.25 * np.log(np.maximum(df_p[used] / max(1, n_p) / clean, 1.0))  # a quarter, as prefixes of a word come together
    return fit_nnpu([np.frombuffer(f, np.int32) for _, f in rows], np.array([c for c, _ in rows], bool), prior, used, start)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row of docs, from the whole text alone.

    A null or empty text has no features and gets the score of the bias.  Null ids are kept, repeated rows come back
    as often, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 4 MB whatever the data
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        weights, bias = shared.value
        own = Model(weights[:-1], bias)
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), pa.array(own.scores(data, at))], names=["id", "score"])

    out = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold.

    Only texts go to Python; the rows are filtered where they are, so the names of other columns can't clash.  A null or
    empty text has the score of the bias; repeated rows share their score; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        own = Model(weights[:-1], bias)
        return pa.array(np.concatenate([own.scores(data, at) for _, data, at in chunks(texts)] or [np.zeros(0)]))

    return in_batches(docs).where(score(F.col(text_col)) < threshold)
