"""Quality rules by line sequence labelling (operator 8).

A linear-chain conditional random field labels each line of a text content or boilerplate; Viterbi decoding finds the most
probable labels of all lines together. The share of a text's characters in content lines decides: at least ``SHARE`` keeps.

The field is trained on at most ``SAMPLE`` labelled documents, those with the lowest hash of doc_id and at most
``SAMPLE_LINES`` lines. Their labels are a document's, so training starts from lines labelled as their document; lines of
poor documents that a first model then finds content are relabelled before the second, which is used.

Null text: no words, no lines; it fails the base rules as any text of under 50 words. Lines without a word have no label.
Without labelled documents of both kinds the base rules alone decide. A share of exactly ``SHARE`` keeps, and of equally
probable labellings the one with more boilerplate at the end counts. Very long texts are labelled whole, line by line.
One row a row of input, repeated rows alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch, bounded_batches, cache_of, documents, map_arrow

SAMPLE, SAMPLE_LINES, SHARE = 1000, 2000, 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_word = re.compile(r"[^\x20\x09-\x0D]")
_marks = re.compile(r"[^\w\s]+")


def line_features(line: str, earlier: bool) -> list[float]:
    """What the field sees of a line; the first is always 1."""
    words = line.split()
    n, chars = max(1, len(words)), max(1, len(line))
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    symbols = sum(map(line.count, SYMBOLS))
    marks = _marks.findall(line)
    short = sum(len(w) <= 3 for w in words)
    runs = sum(len(m) > 1 for m in marks)
    return [
        1.0,
        min(n, 60) / 20,
        float(n <= 2),
        min(1.0, 5 * symbols / chars),
        min(1.0, symbols / n),
        min(1.0, 1.5 * upper / max(1, letters)),
        min(1.0, 5 * sum(map(str.isdigit, line)) / chars),
        min(1.0, 2 * runs / n),
        short / n,
        float(line[-1:] in ".!?"),
        min(1.0, line.count("|") / n * 2),
        len(set(words)) / n,
        letters / chars,
        float(earlier),
    ]


FEATURES = len(line_features("a", False))


def lines_of(text: str) -> tuple[list[str], np.ndarray, int]:
    """Lines with a word, their features, and how many of them equal an earlier one."""
    lines, seen, rows, again = [], set(), [], 0
    for line in text.split("\n"):
        if _word.search(line):
            earlier = line in seen
            again += earlier
            seen.add(line)
            lines.append(line)
            rows.append(line_features(line, earlier))
    return lines, np.array(rows, float).reshape(-1, FEATURES), again


def viterbi(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels: emit[t] is the content score of line t against 0 for boilerplate, move[from, to], start[label]."""
    n = len(emit)
    if not n:
        return np.empty(0, int)
    e = emit.tolist()
    (m00, m01), (m10, m11) = move.tolist()
    a, b = float(start[0]), float(start[1]) + e[0]
    back = []
    for x in e[1:]:
        from0, from1 = a + m00 < b + m10, a + m01 < b + m11
        back.append((from0, from1))
        a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + x
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return np.array(out[::-1])


class Field:
    """A linear-chain conditional random field of two labels."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.weights, self.move, self.start = weights, move, start

    def labels(self, x: np.ndarray) -> np.ndarray:
        return viterbi(x @ self.weights, self.move, self.start)

    @staticmethod
    def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
        """Maximum likelihood by Adam; forward-backward runs over all sequences at once, longest first."""
        sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
        lengths = np.array([len(y) for _, y in sequences])
        longest, m = int(lengths[0]), len(sequences)
        active = [int((lengths > t).sum()) for t in range(longest)]
        x = np.concatenate([np.stack([sequences[i][0][t] for i in range(active[t])]) for t in range(longest)])
        y = np.concatenate([np.array([sequences[i][1][t] for i in range(active[t])]) for t in range(longest)])
        at = np.concatenate([[0], np.cumsum(active)])
        seen_move, seen_start = np.zeros((2, 2)), np.bincount(y[: active[0]], minlength=2).astype(float)
        for t in range(1, longest):
            k = active[t]
            np.add.at(seen_move, (y[at[t - 1] : at[t - 1] + k], y[at[t] : at[t] + k]), 1)
        params, moment, second = np.zeros(FEATURES + 6), np.zeros(FEATURES + 6), np.zeros(FEATURES + 6)
        for step in range(1, steps + 1):
            w, move, start = params[:FEATURES], params[FEATURES : FEATURES + 4].reshape(2, 2), params[FEATURES + 4 :]
            e = np.stack([np.zeros(len(x)), x @ w], 1)
            forward, backward = np.empty_like(e), np.zeros_like(e)
            forward[: at[1]] = e[: at[1]] + start
            for t in range(1, longest):
                k = active[t]
                before = forward[at[t - 1] : at[t - 1] + k]
                forward[at[t] : at[t + 1]] = e[at[t] : at[t + 1]] + np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
            for t in range(longest - 1, 0, -1):
                k = active[t]
                ahead = backward[at[t] : at[t + 1]] + e[at[t] : at[t + 1]]
                backward[at[t - 1] : at[t - 1] + k] = np.stack([np.logaddexp(ahead[:, 0] + move[j, 0], ahead[:, 1] + move[j, 1]) for j in (0, 1)], 1)
            both = forward + backward
            total = np.logaddexp(both[:, 0], both[:, 1])
            p = np.exp(both - total[:, None])
            g_move = seen_move.copy()
            for t in range(1, longest):
                k = active[t]
                b = forward[at[t - 1] : at[t - 1] + k, :, None] + move + (backward[at[t] : at[t + 1]] + e[at[t] : at[t + 1]])[:, None, :] - total[at[t] : at[t + 1], None, None]
                g_move -= np.exp(b).sum(0)
            g = np.concatenate([x.T @ (y - p[:, 1]), g_move.ravel(), seen_start - p[: at[1]].sum(0)]) / len(x) - ridge * params
            moment, second = 0.9 * moment + 0.1 * g, 0.99 * second + 0.01 * g * g
            params = params + rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return Field(params[:FEATURES], params[FEATURES : FEATURES + 4].reshape(2, 2), params[FEATURES + 4 :])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field, from documents that ``labels`` (doc_id, quality) has."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(d, q, lines_of(x or "")[1]) for d, q, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            got = [g for g in got if 0 < len(g[2]) <= SAMPLE_LINES]
            yield batch(("doc_id", "quality", "x"), ([g[0] for g in got], [g[1] for g in got], [g[2].tobytes() for g in got]), (pa.int64(), pa.int32(), pa.binary()))

    # The sample is bounded, so it is the side to broadcast; no text is shuffled.
    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text"), features, "doc_id long, quality int, x binary")
    # At most SAMPLE * SAMPLE_LINES lines of FEATURES doubles, as packed bytes.
    found = sorted(((r.doc_id, bytes(r.x), r.quality) for r in rows.collect()), key=lambda r: r[:2])
    sequences = [(x := np.frombuffer(b).reshape(-1, FEATURES), np.full(len(x), int(q > 0))) for _, b, q in found]
    if len({int(y[0]) for _, y in sequences}) < 2:
        return None
    first = Field.fit([(x[k : k + 1], y[k : k + 1]) for x, y in sequences for k in range(len(y))])
    return Field.fit([(x, y if y[0] else (x @ first.weights + first.start[1] - first.start[0] > 0).astype(int)) for x, y in sequences])


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more."""
    if len(words) < 3:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(number)
    if n >= 1 << 21:
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        code = pair[:-1] * n + ids[2:]
    else:
        code = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    order = code.argsort(kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure(text: str, field: Field | None) -> tuple:
    words = text.encode().split()
    lines, x, again = lines_of(text)
    n, repeats = len(words), repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    share = 1.0
    if field is not None and len(lines):
        sizes = np.array([len(s) for s in lines])
        share = float(sizes[field.labels(x) == 1].sum() / sizes.sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeats, failed, not failed and share >= SHARE, share


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
TYPES = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())


def kept(text: Column, field: Field | None) -> Column:
    """Whether a text is kept; only the text goes to Python, whatever else its row has."""
    bounded_batches(SparkSession.active())

    @F.arrow_udf("boolean")
    def verdict(t: pa.Array) -> pa.Array:
        cache_of(__name__)
        return pa.array([measure(x or "", field)[6] for k in range(0, len(t), 64) for x in t.slice(k, 64).to_pylist()], pa.bool_())

    return verdict(text.cast("string"))


def label(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_words, word_chars, ..., kept, content_share) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*(measure(x or "", field) for x in b.column(1).to_pylist()), strict=True)) or [[]] * len(NAMES)
            yield batch(["doc_id", *NAMES], [b.column(0), *got], [pa.int64(), *TYPES])

    return map_arrow(documents(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
