"""Language identification with segmentation-marginalised unigram models.

Each language has a probability for every piece of one fixed public
vocabulary.  The probability of a word is the sum over all ways to segment it
into pieces, found by the forward algorithm; a text's is the product over its
words.  A text gets the language with the largest probability, and its score
is that language's share under equal priors.

Words are runs of letters (with their marks), lowered, headed by the
vocabulary's word mark; other characters take no part.  A letter outside the
vocabulary is a piece of its own with the probability of the unknown piece.
Runs may have any length: sums are scaled from place to place, so none falls out
of floating point, and only as many places are held as a piece is long.

Learning is expectation maximisation: forward and backward sums give expected
piece counts per language, added up by Spark over the words of the learning
rows, so only one count per piece and language reaches the driver.  The
learning rows are a sample of about ``per_language`` rows per language, chosen
by a hash of the id; their texts are used whole.  Scoring reads each text once
without a shuffle; scores of words met before are kept per worker, up to
``CACHE_UNITS`` of them.

Defined cases: a null or empty text, or one without a letter, is ``und`` with
score 0, as is every text when there is no learning row; ties go to the
smaller language code; a null id is never a learning row and not held out;
repeated rows are judged each by itself; columns besides id, text and lang
take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm import text as tx
from valora.session import cut_lineage

UND = "und"
SMALL = 1e-100     # sums below are scaled up
PLACES = 4096      # of a run, looked up in the vocabulary at a time
CELLS = 1 << 17    # letters of the words that are scored together
CACHE_UNITS = 1_000_000
ROUNDS = 3
SMOOTH = 0.05
MAX_LANGUAGES = 2_000

_MARK = "▁"
# ASCII letters (1) and other ASCII (2): words end where they meet.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 2
for _c in range(128):
    if chr(_c).isalpha():
        _CLASS[_c] = 1


class Pieces:
    """The vocabulary's pieces that consist of lower-case letters."""

    def __init__(self, vocabulary: str):
        import regex
        import sentencepiece

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
        whole = regex.compile(rf"{_MARK}?[\p{{L}}\p{{M}}]+|{_MARK}")
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        names = sorted({p for p in names if whole.fullmatch(p) and p == p.lower()})
        self.size = len(names)
        self.unknown, self.absent = self.size, self.size + 1
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(names):
            by_length.setdefault(len(p), []).append(i)
        self.longest = max(by_length)
        for n, own in by_length.items():
            codes = np.array([[ord(c) for c in names[i]] for i in own], np.uint64)
            h = self._hash(codes)
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(own)[order]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[0], np.uint64)
        for k in range(codes.shape[1]):
            h = tx.mix(h * np.uint64(31) + codes[:, k])
        return h

    def runs(self, unit: str) -> list[str]:
        return self.letters.findall(unit.lower())

    def codes(self, words: list[str]) -> np.ndarray:
        """Code points of words of one length, headed by the mark."""
        out = np.empty((len(words), len(words[0]) + 1), np.uint64)
        out[:, 0] = ord(_MARK)
        out[:, 1:] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        return out

    def lattice(self, words: list[str]) -> np.ndarray:
        """``id[w, i, l - 1]``: the piece that ends before place ``i`` and is
        ``l`` long.  Words have one length, without the mark."""
        return self.lookup(self.codes(words))

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        n, m = codes.shape
        ids = np.full((n, m + 1, min(self.longest, m)), self.absent, np.int32)
        for start in range(m):
            h = np.zeros(n, np.uint64)
            for k in range(start, min(m, start + self.longest)):
                h = tx.mix(h * np.uint64(31) + codes[:, k])
                length = k - start + 1
                if length in self.tables:
                    keys, own = self.tables[length]
                    p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[p] == h
                    ids[hit, k + 1, length - 1] = own[p[hit]]
        first = ids[:, 1:, 0]
        first[first == self.absent] = self.unknown
        return ids


def _next(ids: np.ndarray, i: int, before: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sums up to place ``i`` from those of the places before, the nearest first."""
    out = np.zeros_like(before[0])
    for length in range(1, min(len(before), ids.shape[2]) + 1):
        hit = np.flatnonzero(ids[:, i, length - 1] < len(p) - 1)
        if len(hit):
            out[hit] += before[length - 1][hit] * p[ids[hit, i, length - 1]]
    return out


def _scaled(before: list[np.ndarray], log: np.ndarray) -> None:
    """Scale the held places up where the nearest has become small."""
    small = before[0] < SMALL
    if small.any():
        by = np.where(small, np.maximum(before[0], 1e-300), 1.0)
        for a in before:
            a /= by
        log += np.log(by)


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over segmentations up to each place: ``[word,
    place, language]``."""
    n, m1, _ = ids.shape
    out, log = np.zeros((n, m1, p.shape[1])), np.zeros((n, p.shape[1]))
    before = [np.ones((n, p.shape[1]))]
    for i in range(1, m1):
        before.insert(0, _next(ids, i, before, p))
        del before[ids.shape[2]:]
        _scaled(before, log)
        out[:, i] = np.log(np.maximum(before[0], 1e-300)) + log
    return out


def log_sums(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """The last place of ``forward``, holding a part of the lattice at a time:
    ``[word, language]``."""
    codes = pieces.codes(words)
    n, m = codes.shape
    log, before = np.zeros((n, p.shape[1])), [np.ones((n, p.shape[1]))]
    for lo in range(0, m, PLACES):
        base = max(0, lo - pieces.longest + 1)
        ids = pieces.lookup(codes[:, base:lo + PLACES])
        for i in range(lo + 1 - base, ids.shape[1]):
            before.insert(0, _next(ids, i, before, p))
            del before[pieces.longest:]
            _scaled(before, log)
    return np.log(np.maximum(before[0], 1e-300)) + log


def expected(ids: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words under one language's ``p``."""
    n, m1, wide = ids.shape
    a = forward(ids, p[:, None])[:, :, 0]
    out = np.zeros(len(p))
    # sums after each place, the nearest first, and the logarithm they are scaled by
    after, log = [np.ones((n, 1))], np.zeros((n, 1))
    for i in range(m1 - 2, -1, -1):
        now = np.zeros((n, 1))
        for length in range(1, min(len(after), wide) + 1):
            own = ids[:, i + length, length - 1]
            hit = np.flatnonzero(own < len(p) - 1)
            if len(hit):
                through = p[own[hit]] * after[length - 1][hit, 0]
                now[hit, 0] += through
                np.add.at(out, own[hit], weight[hit] * through * np.exp(np.minimum(a[hit, i] + log[hit, 0] - a[hit, -1], 700)))
        after.insert(0, now)
        del after[wide:]
        _scaled(after, log)
    return out


def by_length(words: list[str], most: int = 2048) -> Iterator[np.ndarray]:
    """Places of words of one length, at most ``most`` and ``CELLS`` letters at a time."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(n, kind="stable")
    edges = np.flatnonzero(np.diff(n[order])) + 1
    for own in np.split(order, edges):
        some = max(1, min(most, CELLS // max(1, n[own[0]]))) if len(own) else 1
        for i in range(0, len(own), some):
            yield own[i:i + some]


def _units(b: tx.Block) -> tuple[tx.Words, np.ndarray]:
    kind = _CLASS[b.buf]
    cut = np.zeros(len(kind), bool)
    if len(kind):
        cut[1:] = (kind[:-1] > 0) & (kind[1:] > 0) & (kind[:-1] != kind[1:])
    u = tx.words(b, cut)
    return u, tx.span_hash(tx.prefix_hash(b.buf), u.starts, u.ends)


_PIECES: dict[str, Pieces] = {}


def pieces_of(vocabulary: str) -> Pieces:
    if vocabulary not in _PIECES:
        _PIECES[vocabulary] = Pieces(vocabulary)
    return _PIECES[vocabulary]


class Model:
    """Languages and the piece probabilities ``[piece, language]``; the last
    two pieces are the unknown one and the absent one (probability 0)."""

    def __init__(self, vocabulary: str, languages: list[str], p: np.ndarray):
        self.vocabulary, self.languages, self.p = vocabulary, languages, p


class Scorer:
    """Log-probabilities of texts; those of units are kept between blocks."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.index = tx.HashIndex()
        self.values = np.zeros((1 << 12, len(self.model.languages) + 1))

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        for own in by_length(words):
            out[own] = log_sums(self.pieces, [words[i] for i in own.tolist()], self.model.p)
        return out

    def __call__(self, b: tx.Block) -> tuple[np.ndarray, np.ndarray]:
        """Per row: sums of the languages' log-probabilities and of letters."""
        u, h = _units(b)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.index) > CACHE_UNITS:
            self._clear()
        new = self.index.missing(distinct)
        if len(new):
            raw = b.buf.tobytes()
            s, e = u.starts[first[new]].tolist(), u.ends[first[new]].tolist()
            runs, owner = [], []
            for k, (i, j) in enumerate(zip(s, e, strict=True)):
                for w in self.pieces.runs(raw[i:j].decode("utf-8", "replace")):
                    runs.append(w)
                    owner.append(k)
            at = len(self.index)
            while at + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            rows = self.values[at:at + len(new)]
            rows[:] = 0
            if runs:
                own = np.array(owner)
                np.add.at(rows[:, :-1], own, self.words(runs))
                np.add.at(rows[:, -1], own, np.fromiter(map(len, runs), float, len(runs)))
            self.index.add(distinct[new], at + np.arange(len(new)))
        each = self.values[self.index.rows(distinct)][inverse]
        return tx.segment_sums(each, u.first), np.arange(len(b.starts) + 1)


_SCORER: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    """One scorer per Python worker, for the model in use."""
    if not _SCORER or _SCORER[0].model.languages != model.languages or not np.array_equal(_SCORER[0].model.p, model.p):
        _SCORER[:] = [Scorer(model)]
    return _SCORER[0]


def fit(rows: DataFrame, vocabulary: str = "piece_bpe_32k.model", per_language: int = 1500) -> Model:
    """Learn from ``id, text, lang``; rows with a null among them take no part.

    About ``per_language`` rows per language are used, by a hash of the id
    (every row of a language that has no more)."""
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(found, key=lambda x: x.encode())
    pieces = pieces_of(vocabulary)
    p = np.zeros((pieces.size + 2, len(languages)))
    p[:-1] = 1 / (pieces.size + 1)
    if not languages:
        return Model(vocabulary, languages, p)
    spark = rows.sparkSession
    parts = 1 << 30
    share = spark.createDataFrame([(x, int(parts * min(1.0, per_language / n))) for x, n in found.items()],
                                  "lang string, share long")
    chosen = (rows.join(F.broadcast(share), "lang")
              .where(F.pmod(F.xxhash64("id"), F.lit(parts)) < F.col("share")).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(vocabulary)
        for b in batches:
            counts: dict[tuple[str, str], int] = {}
            langs = b.column(0).to_pylist()
            for blk in tx.blocks(b.column(1)):
                u, _ = _units(blk)
                raw = blk.buf.tobytes()
                for k in range(len(blk.starts)):
                    for i in range(u.first[k], u.first[k + 1]):
                        for w in own.runs(raw[u.starts[i]:u.ends[i]].decode("utf-8", "replace")):
                            key = langs[blk.first + k], w
                            counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()),
                                              pa.array([x[1] for x in counts], pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    words = cut_lineage(chosen.mapInArrow(count, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    place = {x: i for i, x in enumerate(languages)}
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(p)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = pieces_of(vocabulary), shared.value
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                langs = np.array(b.column(0).to_pylist(), object)
                texts, n = b.column(1).to_pylist(), b.column(2).to_numpy()
                for x in set(langs):
                    at = np.flatnonzero(langs == x)
                    total = sums.setdefault(x, np.zeros(len(now)))
                    mine = [texts[i] for i in at.tolist()]
                    for k in by_length(mine):
                        total += expected(own.lattice([mine[i] for i in k.tolist()]), now[:, place[x]], n[at[k]])
            for x, total in sums.items():
                hit = np.flatnonzero(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(hit), pa.string()), pa.array(hit, pa.int32()),
                                                  pa.array(total[hit])], names=["lang", "piece", "n"])

        got = (words.mapInArrow(step, "lang string, piece int, n double")
               .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow())
        c = np.zeros_like(p)
        c[got["piece"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
        c[:-1] += SMOOTH
        c[-1] = 0
        p = c / c.sum(axis=0)
        shared.unpersist()
    return Model(vocabulary, languages, p)


def _predictions(model: Model, col: pa.Array) -> tuple[list[str], np.ndarray]:
    score = _scorer(model)
    names = model.languages
    pred, best = [UND] * len(col), np.zeros(len(col))
    sums = np.zeros((len(col), len(names) + 1))
    for blk in tx.blocks(col):
        v, _ = score(blk)
        sums[blk.first:blk.first + len(v)] += v
    if names:
        for i in np.flatnonzero(sums[:, -1] > 0).tolist():
            own = sums[i, :-1]
            top = int(np.argmax(own))
            pred[i], best[i] = names[top], 1 / np.exp(own - own[top]).sum()
    return pred, best


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, best = _predictions(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(best)],
                                             names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all columns as they are, that have a language (not
    ``und``) with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, best = _predictions(shared.value, b.column(place))
            yield b.filter(pa.array((np.array(pred, object) != UND) & (best >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column) -> Column:
    """The rows that learning leaves aside: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_outside(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows that are not held out."""
    i = F.col(f"`{id_col}`")
    return fit(docs.where(~held_out(i)).select(i.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                                               F.col(f"`{lang_col}`").cast("string").alias("lang")))
