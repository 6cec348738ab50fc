"""Language identification by unigram models marginalised over segmentations.

A language gives every piece of a fixed public vocabulary a probability; a text's
likelihood is the sum, over all ways to cut its words into pieces, of the product
of the pieces' probabilities. The forward algorithm sums them word by word, each
distinct word of a slice once, and short ones that a task remembers not again. Piece probabilities are learned by
expectation-maximisation over the same lattice from a bounded sample
(``MOST_TRAINING_DOCS`` documents, shared fairly by the languages; at least
``LEAST_PER_LANGUAGE`` of each, or all it has).

Words are white-space separated, lower-cased and led by a space mark; a piece is
a vocabulary entry of at most eight bytes, and every single byte is a piece, so
every word has a segmentation. Words beyond 24 bytes are scored in runs of 24, which keeps the sums within doubles.

``score`` is the posterior of the predicted language under equal priors. Null
text and text without a letter get ``und`` and score 0, as does every text when
nothing was learned. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.llm.sampling import bounded_ids_by, held_out
from nearspark.llm.textops import give_back_memory, keep_memory_low

MOST_TRAINING_DOCS = 2000
LEAST_PER_LANGUAGE = 50
LONGEST = 8
RUN = 24
SCALE = 16.0  # per byte, keeps forward sums in range
SLICE_BYTES = 1 << 20
REMEMBERED = 1 << 20  # numbers of short words' scores that a task keeps, at most
_U = np.uint64
_BLANK = set(b" \t\n\v\f\r")


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a ``.tiktoken`` vocabulary: lower case, no inner white space, all single bytes."""
    pieces = {bytes([b]) for b in range(1, 256)}  # 0 parts words in a lattice
    for line in open(path, "rb"):
        piece = base64.b64decode(line.split()[0])
        if len(piece) <= LONGEST and piece == piece.lower() and b"\0" not in piece and not set(piece[1:]) & _BLANK:
            pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """Piece occurrences in a list of words (bytes), as index arrays."""

    def __init__(self, words: list[bytes], vocabulary: "Vocabulary"):
        self.order = np.argsort([-len(w) for w in words], kind="stable")
        words = [words[i] for i in self.order.tolist()]
        self.length = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"\0".join(words) + b"\0" * (LONGEST + 1), np.uint8)
        self.node = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1]  # a word has length + 1 nodes
        self.size = int(self.length.sum()) + len(words)
        self.piece = vocabulary.lookup(flat, self.size)
        longest = int(self.length[0]) if len(words) else 0
        self.active = np.searchsorted(-self.length, -np.arange(longest + 1), side="right")

    def forward(self, p: np.ndarray) -> np.ndarray:
        a, none = np.zeros((self.size, p.shape[1])), len(p) - 1
        a[self.node] = 1.0
        for i in range(1, len(self.active)):
            at = self.node[:self.active[i]] + i
            total = a[at - 1] * p[self.piece[1][at - 1]]
            for n in range(2, min(LONGEST, i) + 1):
                piece = self.piece[n][at - n]
                has = np.flatnonzero(piece < none)  # most nodes have no long piece
                total[has] += a[at[has] - n] * p[piece[has]]
            a[at] = total
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        b = np.zeros((self.size, p.shape[1]))
        b[self.node + self.length] = 1.0
        for i in range(len(self.active) - 2, -1, -1):
            for n in range(1, LONGEST + 1):
                if i + n < len(self.active):
                    at = self.node[:self.active[i + n]] + i
                    b[at] += b[at + n] * p[self.piece[n][at]]
        return b

    def totals(self, a: np.ndarray) -> np.ndarray:
        """Scaled probability of each word, in the order given."""
        out = np.empty((len(self.node), a.shape[1]))
        out[self.order] = a[self.node + self.length]
        return out


class Vocabulary:
    """Pieces by length as sorted 64-bit keys; the index after the last piece means none."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(x) for x in pieces])
        self.keys, self.index = {}, {}
        for n in range(1, LONGEST + 1):
            own = [(int.from_bytes(x, "little"), i) for i, x in enumerate(pieces) if len(x) == n]
            own.sort()
            self.keys[n] = np.array([k for k, _ in own], np.uint64)
            self.index[n] = np.array([i for _, i in own], np.int32)

    def lookup(self, flat: np.ndarray, size: int) -> dict[int, np.ndarray]:
        out, key = {}, np.zeros(size, np.uint64)
        for n in range(1, LONGEST + 1):
            key = key | flat[n - 1:n - 1 + size].astype(np.uint64) << _U(8 * (n - 1))
            at = np.minimum(np.searchsorted(self.keys[n], key), max(len(self.keys[n]) - 1, 0))
            found = self.keys[n][at] == key if len(self.keys[n]) else np.zeros(size, bool)
            out[n] = np.where(found, self.index[n][at] if len(self.index[n]) else 0, len(self.pieces))
        return out


@dataclass
class Model:
    langs: list[str]
    pieces: list[bytes]
    log_p: np.ndarray  # piece x language

    def scaled(self, vocabulary: Vocabulary) -> np.ndarray:
        """Probabilities times ``SCALE`` per byte, and a zero row for 'no piece'."""
        p = np.exp(self.log_p + (np.log(SCALE) * vocabulary.lengths)[:, None])
        return np.vstack([p, np.zeros((1, p.shape[1]))])


def runs_of(word: str) -> list[bytes]:
    raw = b" " + word.lower().encode().replace(b"\0", b"\1")
    return [raw[i:i + RUN] for i in range(0, len(raw), RUN)] if len(raw) > RUN else [raw]


def learn(counts: dict[str, dict[str, int]], pieces: list[bytes], rounds: int = 4, chunk: int = 40_000) -> Model:
    """EM from word counts per language."""
    langs = sorted(counts)
    vocabulary = Vocabulary(pieces)
    lengths = vocabulary.lengths
    start = 1.0 / 8.0 ** lengths
    log_p = np.log(start / start.sum())[:, None]
    columns = []
    for lang in langs:
        pairs = [(r, n) for w, n in sorted(counts[lang].items()) for r in runs_of(w)]
        blocks = [pairs[i:i + chunk] for i in range(0, len(pairs), chunk)]
        lattices = [(Lattice([w for w, _ in b], vocabulary), np.array([n for _, n in b], float)) for b in blocks]
        own = log_p
        for _ in range(rounds):
            p = Model([lang], pieces, own).scaled(vocabulary)
            seen = np.zeros(len(pieces) + 1)
            for lat, n in lattices:
                a, b = lat.forward(p), lat.backward(p)
                per = np.repeat(n[lat.order] / a[lat.node + lat.length, 0], lat.length + 1)
                for k in range(1, LONGEST + 1):
                    idx = lat.piece[k][:lat.size - k]
                    use = np.flatnonzero(idx < len(pieces))
                    w = a[use, 0] * p[idx[use], 0] * b[use + k, 0] * per[use]
                    seen += np.bincount(idx[use], w, minlength=len(pieces) + 1)
            seen = seen[:-1] + 0.02 / 4.0 ** (lengths - 1)
            own = np.log(seen / seen.sum())[:, None]
        columns.append(own)
    return Model(langs, pieces, np.hstack(columns) if columns else np.zeros((len(pieces), 0)))


def word_scores(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Scaled log-likelihood of each word under each language."""
    runs, owner = [], []
    for i, w in enumerate(words):
        for r in runs_of(w):
            runs.append(r)
            owner.append(i)
    if not runs:
        return np.zeros((len(words), p.shape[1]))
    lat = Lattice(runs, vocabulary)
    logs = np.log(lat.totals(lat.forward(p)))
    if len(runs) == len(words):
        return logs
    out = np.zeros((len(words), p.shape[1]))
    np.add.at(out, np.array(owner), logs)
    return out


class WordScores:
    """``word_scores`` that remembers words of at most ``RUN`` letters, up to ``most`` of them."""

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray, most: int | None = None):
        self.vocabulary, self.p = vocabulary, p
        self.most = REMEMBERED // max(1, p.shape[1]) if most is None else most
        self.place, self.rows = {}, np.zeros((0, p.shape[1]))

    def __call__(self, words: list[str]) -> np.ndarray:
        at = np.array([self.place.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        fresh = [words[i] for i in new.tolist()]
        out = np.empty((len(words), self.p.shape[1]))
        out[new] = scores = word_scores(fresh, self.vocabulary, self.p)
        known = at >= 0
        out[known] = self.rows[at[known]]
        short = [i for i, w in enumerate(fresh) if len(w) <= RUN]
        if len(self.place) + len(short) > self.most:
            self.place, self.rows = {}, self.rows[:0]
            short = short[:self.most]
        self.place.update(zip([fresh[i] for i in short], range(len(self.place), len(self.place) + len(short))))
        self.rows = np.concatenate([self.rows, scores[short]])
        return out


def _score(shared):
    model = shared.value
    state = {}

    def of_texts(texts: pa.Array, lettered: np.ndarray) -> tuple[list, np.ndarray]:
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = pc.dictionary_encode(words.flatten())
        distinct = pc.utf8_lower(coded.dictionary)
        again = pc.dictionary_encode(distinct)
        logs = state["scores"](again.dictionary.to_pylist())
        of_word = again.indices.to_numpy()[coded.indices.to_numpy(zero_copy_only=False)]
        at = words.offsets.to_numpy(zero_copy_only=False) - words.offsets[0].as_py()
        total = np.zeros((len(of_word) + 1, logs.shape[1]))
        np.cumsum(logs[of_word], axis=0, out=total[1:])
        text = total[at[1:]] - total[at[:-1]]
        text -= text.max(axis=1, keepdims=True)
        post = np.exp(text)
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        pred = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
        return pred, np.where(lettered, post[np.arange(len(best)), best], 0.0)

    def run(batches):
        keep_memory_low()
        if model.langs:
            vocabulary = Vocabulary(model.pieces)
            state["scores"] = WordScores(vocabulary, model.scaled(vocabulary))
        for batch in batches:
            texts, lettered = batch.column("text"), batch.column("lettered").to_numpy(zero_copy_only=False)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_BYTES, side="right")))
                if model.langs:
                    pred, score = of_texts(texts.slice(a, b - a), lettered[a:b].astype(bool))
                else:
                    pred, score = ["und"] * (b - a), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column("held_out").slice(a, b - a),
                     pa.array(pred, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"])
                a = b
            give_back_memory()
        state.clear()
    return run


def fit(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", most_docs: int = MOST_TRAINING_DOCS) -> Model:
    """Learn every language from rows that name it and are not held out, ``most_docs`` in all.

    Where languages are so many that ``LEAST_PER_LANGUAGE`` of each are more, these are taken.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.filter("lang IS NOT NULL")
    ids = bounded_ids_by(known, "_id", "lang", most_docs, LEAST_PER_LANGUAGE)
    words = F.explode(F.split(F.regexp_replace(F.lower("text"), r"^[ \t-\r]+|[ \t-\r]+$", ""), r"[ \t-\r]+"))
    got = (known.join(F.broadcast(ids), ["_id", "lang"]).dropDuplicates(["_id", "lang"]).select("lang", words.alias("w"))
           .filter("w != ''").groupBy("lang", "w").count().toPandas())
    counts: dict[str, dict[str, int]] = {}
    for lang, w, n in zip(got["lang"], got["w"], got["count"]):
        counts.setdefault(lang, {})[w] = int(n)
    return learn(counts, load_pieces(vocabulary_path))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       lettered.alias("lettered"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
