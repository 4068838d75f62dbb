"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other, then are combined.

Content: presence of telling words (by 64-bit hash, chosen by the root of their log-likelihood ratio) and binned surface figures of the
text (case, symbols, repeats, line and word lengths). Metadata: source, language and length class. In each round both
views are fitted to the labelled rows (which also choose the words) and to what the other gave; then both score all unlabelled documents, and each hands
the other those it is most confident of: beyond the score at which it is right ``PRECISION`` of the time on held-out
labelled rows, the ``GIVEN`` highest different texts of either class. In the end each view is calibrated on the held-out
rows and a logistic combination of both scores every document.
There are two such classifiers, for quality and for toxicity; a document is kept if it is good and not toxic.

Fitting is bounded: at most ``MAX_LABELLED`` labelled rows (of least hash of their id) and 8 x ``GIVEN`` pseudo-labelled rows
a round reach the driver. The exchange and the scoring read every whole text, each time in one narrow stage.

Nulls: a null text is empty; null source, language or length are classes of their own; labels that are null or whose
document is missing aren't used; a null doc_id keeps its row. Repeated rows are scored each for itself; repeated labels
all count. Without labels of both classes a classifier answers with the share it saw (0.5 without any label) and rejects
nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bytewords import Words, column_bytes, column_words

#: The bound of labelled rows that fitting takes, and what a view gives for one class in one round.
MAX_LABELLED, GIVEN = 12000, 100
ROUNDS, PRECISION, MOST_WORDS, MIN_Z, BINS = 2, 0.98, 256, 3.5, 10
#: What a pseudo-label weighs beside a label.
PSEUDO = 0.25

#: How many figures ``surface`` gives.
FIGURES = 11

_B = np.arange(256)
_UPPER = ((_B >= 65) & (_B <= 90)).astype(np.int64)
_LETTER = (((_B >= 97) & (_B <= 122)) | (_B >= 128)).astype(np.int64) + _UPPER
_DIGIT = ((_B >= 48) & (_B <= 57)).astype(np.int64)
_MARK = np.isin(_B, list(b".,;:'\"-()?")).astype(np.int64)
_SYMBOL = ((_B > 32) & (_B < 127)).astype(np.int64) * (1 - _MARK) * (1 - _DIGIT) * (1 - _LETTER)
_BREAK = (_B == 10).astype(np.int64)
_WIDE = (_B >= 128).astype(np.int64)


def _repeated(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Per group the number of distinct values."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n)


def surface(data: np.ndarray, w: Words) -> np.ndarray:
    """Per text: figures of its surface, as columns."""
    n, edges = w.n_docs, w.first_byte
    size = np.diff(edges)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[edges[1:]] - total[edges[:-1]]

    many = w.per_doc()
    some, bytes_ = np.maximum(many, 1), np.maximum(size, 1)
    letters = np.maximum(count(_LETTER), 1)
    again = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n)
    lines = count(_BREAK) + 1
    # a line is known by the sum of its words' hashes
    line = np.cumsum(data == 10)[w.start] if len(w.start) else np.zeros(0, np.int64)
    first = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(w.doc, prepend=-1) != 0))
    sums = np.add.reduceat(w.hash, first) if len(first) else np.zeros(0, np.uint64)
    line_doc = w.doc[first]
    full = np.maximum(np.bincount(line_doc, minlength=n), 1)
    return np.stack(
        [
            np.log1p(many),
            count(_UPPER) / letters,
            count(_DIGIT) / bytes_,
            count(_SYMBOL) / bytes_,
            count(_MARK) / bytes_,
            lines / some,
            again / some,
            _repeated(w.doc, w.hash, n) / some,
            1 - _repeated(line_doc, sums, n) / full,
            letters / some,
            count(_WIDE) / bytes_,
        ],
        axis=1,
    )


@common.lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, edges = column_bytes(b.column("text"))
        for lo, hi, w in column_words(b.column("text")):
            figures = surface(data[edges[lo] : edges[hi]], w)
            cut = np.searchsorted(w.doc, np.arange(hi - lo + 1))
            own = [np.unique(w.hash[x:y]).view(np.int64) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            part = b.slice(lo, hi - lo)
            cols = [part.column(c) for c in ("fold", "source", "lang", "n_chars", "quality", "toxic")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in figures], pa.binary())], ["fold", "source", "lang", "n_chars", "quality", "toxic", "words", "figures"])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, center: np.ndarray | None = None) -> np.ndarray:
    """Newton's method; the first coefficient is the intercept. Rows are taken block by block.

    The penalty draws to zero and leaves the intercept alone; with a center, it draws all coefficients there.
    """
    ridge = np.full(x.shape[1] + 1, l2)
    if center is None:
        center = np.zeros(len(ridge))
        share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        center[0] = np.log(share / (1 - share))
        ridge[0] = 1e-9
    beta = center.copy()
    for _ in range(12):
        grad, h = ridge * (beta - center), np.diag(ridge)
        for lo in range(0, len(x), 1024):
            part = np.concatenate([np.ones((len(x[lo : lo + 1024]), 1)), x[lo : lo + 1024]], axis=1)
            w = weight[lo : lo + 1024]
            p = sigmoid(part @ beta)
            grad += part.T @ (w * (p - y[lo : lo + 1024]))
            h += (part * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
        step = np.linalg.solve(h, grad)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Rows:
    """Features of some documents. words: sorted distinct hashes, flat; of: their document's number."""

    words: np.ndarray
    of: np.ndarray
    figures: np.ndarray
    source: list
    lang: list
    n_chars: np.ndarray
    #: Whether no earlier row has the same words.
    first: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.figures)


class Content:
    """Words that tell the classes apart (log-likelihood ratio), and binned figures."""

    def __init__(self, rows: Rows, use: np.ndarray, y: np.ndarray):
        use = use & rows.first  # a text that is there several times tells once
        pick = use[rows.of]
        w, positive = rows.words[pick], y[rows.of][pick]
        u, inverse = np.unique(w, return_inverse=True)
        a, n = np.bincount(inverse, positive, len(u)), np.bincount(inverse, minlength=len(u))
        share = np.clip(y[use].mean(), 1e-6, 1 - 1e-6)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.nan_to_num(a * np.log(a / (n * share))) + np.nan_to_num((n - a) * np.log((n - a) / (n * (1 - share))))
        z = np.sqrt(2 * np.maximum(g, 0))
        best = np.argsort(-z, kind="stable")[:MOST_WORDS]
        self.words = np.sort(u[best[z[best] >= MIN_Z]])
        self.cuts = np.quantile(rows.figures[use], np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.words >> np.uint64(48)] = True

    def matrix(self, rows: Rows) -> np.ndarray:
        x = np.zeros((len(rows), len(self.words) + rows.figures.shape[1] * BINS), np.float32)
        maybe = np.flatnonzero(self.bits[rows.words >> np.uint64(48)]) if len(self.words) else np.zeros(0, np.int64)
        at = np.searchsorted(self.words, rows.words[maybe])
        ok = self.words[np.minimum(at, len(self.words) - 1)] == rows.words[maybe] if len(maybe) else np.zeros(0, bool)
        x[rows.of[maybe[ok]], at[ok]] = 1
        for k in range(rows.figures.shape[1]):
            x[np.arange(len(rows)), len(self.words) + k * BINS + np.searchsorted(self.cuts[:, k], rows.figures[:, k], "right")] = 1
        return x


class Metadata:
    """One column for each frequent source and language, and for length classes."""

    def __init__(self, rows: Rows, use: np.ndarray):
        def frequent(values: list, most: int) -> dict:
            kinds: dict = {}
            for i in np.flatnonzero(use):
                kinds[values[i]] = kinds.get(values[i], 0) + 1
            return {v: k for k, v in enumerate(sorted(kinds, key=lambda v: (-kinds[v], str(v)))[:most])}

        self.source, self.lang = frequent(rows.source, 64), frequent(rows.lang, 32)
        known = rows.n_chars[use][rows.n_chars[use] >= 0]
        self.cuts = np.quantile(known, np.linspace(0, 1, BINS)[1:-1]) if len(known) else np.zeros(BINS - 2)

    def matrix(self, rows: Rows) -> np.ndarray:
        a, b = len(self.source), len(self.lang)
        x = np.zeros((len(rows), a + b + BINS), np.float32)
        for table, values, at in ((self.source, rows.source, 0), (self.lang, rows.lang, a)):
            k = np.array([table.get(v, -1) for v in values], np.int64)
            x[np.flatnonzero(k >= 0), at + k[k >= 0]] = 1
        x[np.arange(len(rows)), a + b + np.where(rows.n_chars < 0, BINS - 1, np.searchsorted(self.cuts, rows.n_chars, "right"))] = 1
        return x


class Classifier:
    """One target over growing rows. y: 0 or 1, or -1 for rows without a label; held: kept for confidence, calibration and combination."""

    def __init__(self, y: np.ndarray, held: np.ndarray):
        known = y >= 0
        train = known & ~held
        self.y, self.held = y, known & held
        self.views: list = []
        self.constant = float(y[known].mean()) if known.any() else 0.5
        self.able = min((y[train] == 1).sum(), (y[train] == 0).sum(), (y[self.held] == 1).sum(), (y[self.held] == 0).sum()) >= 2
        # what each view is fitted to
        self.target = np.stack([y, y], axis=1).astype(np.float64)
        self.weight = np.stack([train, train], axis=1).astype(np.float64)
        self.prior = float(y[train].mean()) if train.any() else 0.5

    def fit(self, rows: Rows) -> None:
        self.views, self.logits = [], []
        for v in range(2):
            use = self.weight[:, v] > 0
            sure = self.weight[:, v] == 1  # words and classes are chosen by what is labelled
            view = Content(rows, sure, np.where(sure, self.target[:, v], 0)) if v == 0 else Metadata(rows, sure)
            x = view.matrix(rows)
            beta = fit_logistic(x, np.where(use, self.target[:, v], 0), self.weight[:, v])
            self.views.append((view, beta))
            self.logits.append(x @ beta[1:] + beta[0])

    def bounds(self) -> list[tuple[int, int, float]]:
        """(view, class, least score) beyond which a view is sure enough to teach the other."""
        out = []
        for v in range(2):
            for kind in (0, 1):
                s = self.logits[v] if kind else -self.logits[v]
                out.append((v, kind, _confident(s[self.held], self.y[self.held] == kind)))
        return [x for x in out if np.isfinite(x[2])]

    def learn(self, marks: list[tuple[int, int, int]], n: int) -> None:
        """n more rows; marks: (which of them, view that is sure, class) - for the other view."""
        target, weight = np.zeros((n, 2)), np.zeros((n, 2))
        for i, v, kind in marks:
            target[i, 1 - v], weight[i, 1 - v] = kind, PSEUDO
        self.target, self.weight = np.concatenate([self.target, target]), np.concatenate([self.weight, weight])
        self.y, self.held = np.concatenate([self.y, np.full(n, -1)]), np.concatenate([self.held, np.zeros(n, bool)])

    def calibrate(self) -> None:
        z = np.stack([x[self.held] for x in self.logits], axis=1)
        # drawn to the identity, and to the sum of two independent views' evidence, as few rows may be held out
        one, yes = np.ones(len(z)), self.y[self.held].astype(float)
        self.scale = [fit_logistic(z[:, v : v + 1], yes, one, 2.0, np.array([0.0, 1.0])) for v in range(2)]
        both = np.stack([logit(sigmoid(z[:, v] * self.scale[v][1] + self.scale[v][0])) for v in range(2)], axis=1)
        self.blend = fit_logistic(both, yes, one, 2.0, np.array([-float(logit(np.array([self.prior]))[0]), 1.0, 1.0]))
        del self.target, self.weight, self.logits, self.y, self.held  # what is sent to the workers is small

    def score(self, rows: Rows) -> np.ndarray:
        """Probabilities: of the content view, the metadata view, and both combined."""
        if not self.views or not hasattr(self, "blend"):
            return np.full((len(rows), 3), self.constant)
        p = []
        for (view, beta), scale in zip(self.views, self.scale, strict=True):
            p.append(sigmoid((view.matrix(rows) @ beta[1:] + beta[0]) * scale[1] + scale[0]))
        both = sigmoid(logit(p[0]) * self.blend[1] + logit(p[1]) * self.blend[2] + self.blend[0])
        return np.stack([*p, both], axis=1)


def _confident(score: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on at least PRECISION are right, and surely (one-sided 95 %) more than the class's share.

    A view that is no better than the share of the class has nothing to teach.
    """
    order = np.argsort(-score, kind="stable")
    n = np.arange(1, len(order) + 1)
    share, z = np.cumsum(right[order]) / n, 1.645
    surely = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = np.flatnonzero((share >= PRECISION) & (surely > right.mean()))
    return float(score[order[good[-1]]]) if len(good) else np.inf


@dataclass
class Model:
    quality: Classifier
    toxic: Classifier
    threshold: float = 0.5


def _shape(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The fixed columns that features are made of; missing metadata columns are null."""

    def of(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), of("source", "string"), of("lang", "string"), of("n_chars", "long"))


FEATURES = "fold long, source string, lang string, n_chars long, quality int, toxic int, words binary, figures binary"


def _collected(frame: DataFrame, order: list[str]) -> tuple[Rows, dict[str, list], list[int]]:
    """A bounded frame's features on the driver: as rows, the other columns, and a digest of each row's words."""
    got = frame.orderBy(*order).toArrow()
    kept = got["words"].combine_chunks()
    n = len(kept)
    size = pc.binary_length(kept).to_numpy(zero_copy_only=False).astype(np.int64) // 8 if n else np.zeros(0, np.int64)
    flat = np.frombuffer(kept.buffers()[2], np.uint64, int(size.sum())).copy() if n and size.sum() else np.zeros(0, np.uint64)
    digests = [hash(x.as_py()) for x in kept]
    r = got.drop_columns(["words"]).to_pydict()
    del got, kept
    figures = np.array([np.frombuffer(x, np.float64) for x in r["figures"]]).reshape(n, FIGURES)
    chars = np.array([-1 if x is None else x for x in r["n_chars"]], np.int64)
    return Rows(flat, np.repeat(np.arange(n), size), figures, r["source"], r["lang"], chars), r, digests


def _joined(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.words, b.words]), np.concatenate([a.of, b.of + len(a)]), np.concatenate([a.figures, b.figures]), a.source + b.source, a.lang + b.lang, np.concatenate([a.n_chars, b.n_chars]))


def most_confident(pool: DataFrame, classifiers: list[Classifier], asked: list[tuple[int, int, int, float]], given: int) -> DataFrame:
    """(doc_id, text_hash, ask, score): for each ask (classifier, view, class, bound) the ``given`` surest different texts.

    pool: all unlabelled rows. A task keeps no more than a bounded number for an ask; the rest of the choice is a
    window whose limit is applied before the shuffle too.
    """
    used = {(c, v): classifiers[c].views[v] for c, v, _, _ in asked}
    sent = pool.sparkSession.sparkContext.broadcast((used, asked))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, asks = sent.value
        best: list[dict[int, tuple[float, int]]] = [{} for _ in asks]  # text hash: score, id

        def cut(k: int) -> None:
            best[k] = dict(sorted(best[k].items(), key=lambda x: (-x[1][0], x[0]))[:given])

        for b in batches:
            data, edges = column_bytes(b.column("text"))
            ids, hashes = b.column("doc_id").to_numpy(), b.column("text_hash").to_numpy()
            for lo, hi, w in column_words(b.column("text")):
                rows = _rows(b, lo, hi, data[edges[lo] : edges[hi]], w)
                logits = {key: view.matrix(rows) @ beta[1:] + beta[0] for key, (view, beta) in views.items()}
                for k, (c, v, kind, bound) in enumerate(asks):
                    s = logits[c, v] if kind else -logits[c, v]
                    for i in np.flatnonzero(s >= bound).tolist():
                        h, x = int(hashes[lo + i]), (float(s[i]), -int(ids[lo + i]))
                        if x > best[k].get(h, (-np.inf, 0)):
                            best[k][h] = x
                    if len(best[k]) > 8 * given:
                        cut(k)
        for k in range(len(asks)):
            cut(k)
            if best[k]:
                rows_ = [(-x[1], h, k, x[0]) for h, x in best[k].items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "text_hash", "ask", "score"])

    found = pool.mapInArrow(run, "doc_id long, text_hash long, ask int, score double")
    once = found.groupBy("ask", "text_hash").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("id"))).alias("x")).select((-F.col("x.id")).alias("doc_id"), "text_hash", "ask", "x.score")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "text_hash"))
    return once.withColumn("rank", rank).where(F.col("rank") <= given).drop("rank")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, given: int = GIVEN, rounds: int = ROUNDS) -> Model:
    """Fit both classifiers. labels: doc_id, quality, toxic. What reaches the driver is bounded by the two limits."""
    spark = docs.sparkSession
    rows = _shape(docs, id_col, text_col)
    key = F.xxhash64("doc_id")
    chosen = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), key.alias("fold")).orderBy("fold", "quality", "toxic").limit(max_labelled)
    labelled = rows.join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of four numbers
    data, r, digests = _collected(labelled.mapInArrow(_features, FEATURES), ["fold", "words"])
    seen: set[int] = set()
    data.first = np.array([not (x in seen or seen.add(x)) for x in digests], bool)
    held = np.array([x % 5 == 0 for x in r["fold"]], bool)
    made = [Classifier(np.array([-1 if x is None else int(x > 0) for x in r[t]], np.int64), held) for t in ("quality", "toxic")]
    # all rows without a label; those that were given already are left out by the hash of their text
    pool = rows.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_anti")
    able = [c for c, m in enumerate(made) if m.able]
    taken: list[int] = []
    for turn in range(rounds + 1):
        for c in able:
            made[c].fit(data)
        asked = [(c, v, kind, bound) for c in able for v, kind, bound in made[c].bounds()] if turn < rounds else []
        if not asked:
            break
        left = pool.join(F.broadcast(spark.createDataFrame([(h,) for h in taken], "text_hash long")), "text_hash", "left_anti")
        marks = most_confident(left, made, asked, given).collect()  # 8 x given rows at most
        if not marks:
            break
        place: dict[int, int] = {}
        for m in sorted(marks, key=lambda m: (m["text_hash"], m["doc_id"])):
            place.setdefault(m["text_hash"], m["doc_id"])
        ids = spark.createDataFrame([(d, h) for h, d in place.items()], "doc_id long, text_hash long")
        more = rows.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "text_hash"])
        more = more.dropDuplicates(["text_hash"]).select(*rows.columns, F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), F.col("text_hash").alias("fold"))
        new, r, digests = _collected(more.mapInArrow(_features, FEATURES), ["fold"])
        at = {h: i for i, h in enumerate(r["fold"])}
        for c in range(len(made)):
            made[c].learn([(at[m["text_hash"]], asked[m["ask"]][1], asked[m["ask"]][2]) for m in marks if asked[m["ask"]][0] == c and m["text_hash"] in at], len(new))
        taken += list(at)
        first = data.first
        data = _joined(data, new)
        data.first = np.concatenate([first, np.array([not (x in seen or seen.add(x)) for x in digests], bool)])
    for c in able:
        made[c].calibrate()
    return Model(*made)


def _rows(b: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, w: Words) -> Rows:
    part = b.slice(lo, hi - lo)
    chars = part.column("n_chars").fill_null(-1).to_numpy(zero_copy_only=False)
    return Rows(w.hash, w.doc, surface(data, w), part.column("source").to_pylist(), part.column("lang").to_pylist(), chars)


def _decide(model: Model, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    good = p[:, 2] >= model.threshold if model.quality.views else np.ones(len(p), bool)
    bad = t[:, 2] >= model.threshold if model.toxic.views else np.zeros(len(t), bool)
    return good & ~bad


def _scored(b: pa.RecordBatch, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, edges = column_bytes(b.column("text"))
    for lo, hi, w in column_words(b.column("text")):
        rows = _rows(b, lo, hi, data[edges[lo] : edges[hi]], w)
        yield lo, hi, model.quality.score(rows), model.toxic.score(rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, the probabilities of quality and toxicity (both combined, and the content view's), keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, p, t in _scored(b, sent.value):
                cols = [p[:, 2], p[:, 0], p[:, 1], t[:, 2], t[:, 0], t[:, 1], _decide(sent.value, p, t)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(c) for c in cols)], ["doc_id", "p_quality", "p_quality_content", "p_quality_metadata", "p_toxic", "p_toxic_content", "p_toxic_metadata", "keep"])

    return _shape(docs, id_col, text_col).mapInArrow(run, "doc_id long, p_quality double, p_quality_content double, p_quality_metadata double, p_toxic double, p_toxic_content double, p_toxic_metadata double, keep boolean")


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifiers keep, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    prefix = "__quern_"
    shaped = _shape(docs, id_col, text_col)
    extra = [F.coalesce(F.col(text_col), F.lit("")).alias(f"{prefix}text")]
    extra += [(F.col(c) if c in docs.columns else F.lit(None)).cast(shaped.schema[c].dataType).alias(f"{prefix}{c}") for c in ("source", "lang", "n_chars")]
    n = len(docs.columns)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_arrays(b.columns[n:], ["text", "source", "lang", "n_chars"])
            keep = np.ones(b.num_rows, bool)
            for lo, hi, p, t in _scored(own, sent.value):
                keep[lo:hi] = _decide(sent.value, p, t)
            yield b.select(range(n)).filter(pa.array(keep))

    return docs.select("*", *extra).mapInArrow(run, docs.schema)
