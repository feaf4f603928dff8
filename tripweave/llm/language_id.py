"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed letter
3-grams tells the languages whose codeword has a 1 there from the others. A text's bits are
decoded by loss: each codeword costs the logistic loss of every classifier's margin against
its bit, weighted by how reliable that classifier was on the training texts; the cheapest
codeword wins, and a text whose two cheapest are close is flagged ambiguous.

The classifiers are fitted on a bounded sample: about ``per_language`` texts of each language
chosen by a hash of the row (a parameter; whole texts are used). Spark adds up n-gram counts
of the sample; the driver gets languages x buckets counts. Prediction reads every whole text.

Null texts and texts without a letter are ``und`` with score 0. With no labelled texts all
are ``und``; with one language every other text gets it. Rows with null language are never
learnt from. Repeated rows are predicted each; extra columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, free, in_batches, nothing_kept

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")

_rng = np.random.default_rng(20)
# A random 32-bit word for each byte in each of the three places of an n-gram.
_WORDS = _rng.integers(0, 1 << 32, (3, 256), dtype=np.uint32)
# Lower case for A-Z; digits, marks and controls become spaces.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
                  for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None
                           or any(c.isalpha() for c in text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every 3-gram of all texts, where each text's 3-grams begin).

    A text stands between spaces; the two 3-grams that run into the next text get the bucket
    after the last, which weighs nothing.
    """
    raw = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    a = _FOLD[np.frombuffer(b"".join(raw) + b"  ", np.uint8)]
    h = _WORDS[0][a[:-2]] + _WORDS[1][a[1:-1]] + _WORDS[2][a[2:]]
    buckets = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    for k in (1, 2):
        buckets[starts[1:] - k] = BUCKETS
    return buckets, starts[:-1]


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: every split of the languages in two for up to 6, else random
    ones of 10 log2 n bits, the draw with the largest least distance of 50."""
    if n <= 6:
        splits = range(1, max(2, 1 << (n - 1)))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits]
                         for i in range(n)], np.int8)
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))

    def spread(code):
        far = (bits - code.astype(int) @ code.T) // 2
        return far[~np.eye(n, dtype=bool)].min()

    return max((rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(50)), key=spread)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray       # languages x bits, -1 or 1
    weights: np.ndarray     # (buckets + 1) x bits; the last row weighs nothing
    trust: np.ndarray       # bits

    def margins(self, texts: list[str]) -> np.ndarray:
        """texts x bits: log odds of a bit, grown with the root of the text's length."""
        buckets, starts = grams(texts)
        sums = np.zeros((len(texts), self.weights.shape[1]))
        step = max(1 << 14, (4 << 20) // max(1, self.weights.shape[1]))
        for at in range(0, len(buckets), step):
            part = self.weights[buckets[at:at + step]]
            first = np.searchsorted(starts, at, "right") - 1
            last = np.searchsorted(starts, at + len(part), "left")
            cuts = np.maximum(starts[first:last] - at, 0)
            sums[first:last] += np.add.reduceat(part, cuts, axis=0)
        n = np.diff(np.append(starts, len(buckets))) - 2
        return sums / np.sqrt(np.maximum(n, 1))[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """texts x languages: the weighted loss of each codeword."""
        against = np.logaddexp(0, margins)         # cost of a -1
        for_ = np.logaddexp(0, -margins)           # cost of a 1
        up = (self.codes == 1) * self.trust
        return for_ @ up.T + against @ ((self.codes == -1) * self.trust).T

    def predict(self, texts: list[str | None], close: float):
        """(language, score, ambiguous) lists."""
        lang, score, flag = ([UNDETERMINED] * len(texts), [0.0] * len(texts),
                             [True] * len(texts))
        real = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if real:
            loss = self.losses(self.margins([texts[i] for i in real]))
            odds = np.exp(loss.min(1, keepdims=True) - loss)
            share = odds / odds.sum(1, keepdims=True)
            two = np.sort(loss, 1)
            gap = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(real), np.inf)
            for i, best, s, g in zip(real, loss.argmin(1), share.max(1), gap):
                lang[i], score[i], flag[i] = self.languages[best], float(s), bool(g < close)
        return lang, score, flag


TICKETS = 1 << 62


def last_ticket(per_language: int, rows: int) -> int:
    """The last of ``TICKETS`` tickets that about ``per_language`` of ``rows`` rows hold."""
    return TICKETS * min(per_language, rows) // rows - 1


def _sampled(docs: DataFrame, per_language: int, text: str,
             lang: str) -> tuple[DataFrame, set[str]]:
    """(text, lang) of about ``per_language`` labelled rows of each language; equal rows are in
    or out together."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang)).count().collect()}
    chosen = known.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    if not counts:
        return chosen, set()
    last = F.create_map(*(x for k, v in counts.items() for x in (
        F.lit(k), F.lit(last_ticket(per_language, v)).cast("long"))))
    ticket = F.xxhash64(*(F.col(c) for c, t in docs.dtypes if not t.startswith("map")))
    drawn = F.shiftrightunsigned(ticket, 2) <= last[F.col(lang)]
    return (known.filter(drawn).select(F.col(text).alias("text"), F.col(lang).alias("lang")),
            set(counts))


def fit(docs: DataFrame, per_language: int = 2000, text: str = "text",
        lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Fits on a bounded sample of labelled rows. A labelled language of which no row is drawn
    is an error."""
    sample, labelled = _sampled(docs, per_language, text, lang)

    def count(batches):
        nothing_kept()
        held: dict[str, np.ndarray] = {}
        for b in by_bytes(batches, "text", 1 << 20):
            for t, k in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if k not in held:
                    held[k] = np.zeros(BUCKETS + 1, np.int64)
                held[k] += np.bincount(grams([t])[0], minlength=BUCKETS + 1)
                held[k][BUCKETS] = 1        # that the language was drawn at all
        for k, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    got = (in_batches(sample, count, "lang string, bucket int, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    if missed := labelled - set(got["lang"]):
        raise RuntimeError(f"no rows drawn of {sorted(missed)}")
    got = got[got["bucket"] < BUCKETS]
    languages = sorted(got["lang"].unique())
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS + 1, 0), np.float32),
                     np.zeros(0))
    freq = np.zeros((len(languages), BUCKETS))
    freq[got["lang"].map(languages.index).to_numpy(), got["bucket"].to_numpy()] = got["n"]
    total = freq.sum(1, keepdims=True)
    freq = (freq + smoothing) / (total + smoothing * BUCKETS)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS + 1, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        up = codes[:, b] == 1
        if up.all():
            continue
        weights[:BUCKETS, b] = np.log(freq[up].mean(0)) - np.log(freq[~up].mean(0))
    model = Model(languages, codes, weights, np.ones(codes.shape[1]))

    def judge(batches):
        nothing_kept()
        for b in by_bytes(batches, "text", 1 << 20):
            texts, names = b.column("text").to_pylist(), b.column("lang").to_pylist()
            right = (np.sign(model.margins(texts))
                     == model.codes[[model.languages.index(k) for k in names]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(right.shape[1]), pa.int32()),
                 pa.array(right.sum(0), pa.int64()),
                 pa.array([len(texts)] * right.shape[1], pa.int64())], ["bit", "ok", "n"])

    bits = (in_batches(sample, judge, "bit int, ok long, n long")
            .groupBy("bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).toPandas())
    ok = (bits["ok"] / bits["n"]).to_numpy()
    model.trust[bits["bit"].to_numpy()] = np.maximum(2 * ok - 1, 0.01)
    return model


def predict(docs: DataFrame, model: Model, carry: dict[str, Column], text: str = "text",
            close: float = 1.0, slice_bytes: int = 1 << 20) -> DataFrame:
    """``carry`` columns and (lang_pred, score, ambiguous) for every row of ``docs``; a name that
    ``carry`` has already gets an underscore."""
    asked = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(carry.values())),
                        F.col(text).alias("text"))
    kept = [f"k{i}" for i in range(len(carry))]
    kinds = "".join(f"{n} {k}, " for n, k in asked.select(kept).dtypes)

    def name(batches):
        nothing_kept()
        for b in by_bytes(batches, "text", slice_bytes):
            lang, score, flag = model.predict(b.column("text").to_pylist(), close)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in kept), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64()), pa.array(flag, pa.bool_())],
                [*kept, "lang_pred", "score", "ambiguous"])

    told = in_batches(asked, name,
                      kinds + "lang_pred string, score double, ambiguous boolean")
    return told.select(*(F.col(k).alias(n) for k, n in zip(kept, carry)), *(
        F.col(n).alias(free(n, carry)) for n in ("lang_pred", "score", "ambiguous")))
