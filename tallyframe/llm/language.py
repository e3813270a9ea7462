"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams by language in Spark and keeps a bounded matrix of log
probabilities; ``predict`` broadcasts it and scores the sparse n-gram rows of a whole
batch of texts at once.

Defined cases: a null text, an empty one or one without letters is ``und`` with score 0;
with no training rows every text is ``und``. Equal texts get equal results. Extra
columns pass through; ``lang_pred`` and ``score`` replace columns of these names.

The posterior only tells the learned languages apart and is near 1 for any longer text. Whether
a text is in the predicted language at all is told by ``familiar``, which a model with bounds
adds: the mean log probability of its n-grams lies above a bound fitted for each language.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 14  # per order
MAX_TRAIN_ROWS = 20_000  # bound of the labelled sample
MAX_LANGUAGES = 4096  # the commonest are learned
MAX_MODEL_BYTES = 64 << 20  # bound of what is broadcast
MIN_BOUND_ROWS = 30  # a language needs as many rows for a bound
DEVIATIONS = 5.0  # of the mean log probability, below which a text is not familiar
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8).astype(bool))
    return _letters[0]


def _grams(texts: list[str | None], bits: int = BUCKET_BITS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, the bucket numbers of all n-grams, text after text, and their number by text;
    each text's number of letters. A text stands between blanks of its own, so that no n-gram
    reaches into the next text; runs of other characters count as one blank."""
    joined = "".join(f"\x00{(t or '').lower()}\x00" for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    isletter = _letter_table()[chars]
    lengths = np.fromiter((len((t or "").lower()) + 2 for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(lengths)])
    letters = np.add.reduceat(isletter.astype(np.int64), at[:-1]) if len(texts) else np.empty(0, np.int64)
    keep = isletter.copy()
    keep[1:] |= isletter[:-1]
    keep[at[:-1]] = keep[at[1:] - 1] = True
    code = np.where(isletter, chars, np.uint32(32))[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    end = np.repeat(at[1:], np.diff(at))
    grams = []
    for n in ORDERS:
        h = np.full(max(0, len(code) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ code[j:j + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = np.arange(len(h)) + n <= end[:len(h)]
        grams.append((h[inside] >> np.uint32(32 - bits), np.maximum(np.diff(at) - n + 1, 0)))
    return grams, letters


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # (orders * buckets, languages), float32
    bits: int = BUCKET_BITS  # of a bucket; fewer where very many languages share the matrix
    bounds: np.ndarray | None = None  # (languages, 3): mean log probability of an n-gram, its deviations between texts and in one


def _split(batches):
    for part in X.slices(batches):
        yield part, part.column(part.schema.get_field_index("text")).to_pylist()


def _quota(sizes: list[int], rows: int) -> float:
    """The number q for which at most q rows of each size are `rows` rows together."""
    left = float(rows)
    for i, n in enumerate(sorted(sizes)):
        if n > left / (len(sizes) - i):
            return left / (len(sizes) - i)
        left -= n
    return float("inf")


def _sample(labelled: DataFrame, max_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """Rows (text, lang) and the number of all rows by language. Languages share `max_rows` evenly,
    and what a small one leaves goes to the others, so a rare language keeps all its rows."""
    rows = labelled.where(F.col("lang").isNotNull()).select(
        "text", F.col("lang").cast("string").alias("lang"), F.xxhash64(*labelled.columns).alias("draw"))
    commonest = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in commonest.collect()}
    quota = _quota(list(sizes.values()), max_rows)
    draws = [(x, int(np.ceil((1 << 40) * min(1.0, quota / n)))) for x, n in sizes.items()]
    # a row for each language, MAX_LANGUAGES at most
    drawn = F.broadcast(rows.sparkSession.createDataFrame(draws, "lang string, below long"))
    return rows.join(drawn, "lang").where(F.pmod("draw", F.lit(1 << 40)) < F.col("below")).select("text", "lang"), sizes


def fit(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS, alpha: float = 0.5) -> Model:
    """Learns from columns text and lang (rows with a null lang are left out).

    Counts come from a sample of about `max_rows` rows, drawn for each language by a hash of
    all columns (give doc_id along, so that copies are drawn one by one); all rows where there
    are no more. The matrix has one column for each of the MAX_LANGUAGES commonest languages
    and fewer buckets where it would grow over MAX_MODEL_BYTES."""
    rows, sizes = _sample(labelled, max_rows)
    languages, bits = sorted(sizes), BUCKET_BITS
    while len(languages) * (len(ORDERS) << bits) * 4 > MAX_MODEL_BYTES:
        bits -= 1
    width = len(ORDERS) << bits
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for part, texts in _split(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            for lang in set(langs):
                grams, _ = _grams([t for t, x in zip(texts, langs) if x == lang], bits)
                found = np.concatenate([g.astype(np.int64) + (k << bits) for k, (g, _) in enumerate(grams)])
                own = sums.setdefault(index[lang], np.zeros(width, np.int64))
                own += np.bincount(found, minlength=width)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])],
                names=["lang", "bucket", "n"])

    counts = np.zeros((width, len(languages)))
    if languages:
        summed = (rows.mapInArrow(count, "lang int, bucket int, n long")
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
        counts[summed["bucket"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
    log_prob = np.zeros((width, len(languages)), np.float32)
    for k in range(len(ORDERS)):
        part = counts[k << bits:(k + 1) << bits] + alpha
        log_prob[k << bits:(k + 1) << bits] = np.log(part / part.sum(axis=0))
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(prior / prior.sum()) if len(prior) else prior, log_prob, bits)


def with_bounds(model: Model, labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """The model with a bound for each language, from a sample of rows that it did not learn from.

    A text's mean log probability in its own language spreads around that of the language by a
    part that all texts have and one that shrinks with the root of its n-grams. A language with
    fewer than MIN_BOUND_ROWS rows in the sample has no bound, and all its texts are familiar."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    rows, _ = _sample(labelled, max_rows)
    index = {x: i for i, x in enumerate(model.languages)}

    def measure(batches):
        for part, texts in _split(batches):
            lang = np.array([index.get(x, -1) for x in part.column(part.schema.get_field_index("lang")).to_pylist()], np.int64)
            sums, n, letters = _log_sums(shared.value, texts)
            keep = np.flatnonzero((lang >= 0) & (letters > 0))
            yield pa.RecordBatch.from_arrays([pa.array(lang[keep]), pa.array(n[keep]), pa.array(sums[keep, lang[keep]])],
                                             names=["lang", "grams", "total"])

    found = np.full((len(model.languages), 3), [-np.inf, 0.0, 0.0])
    if model.languages:
        # three numbers for each row of the sample
        seen = rows.mapInArrow(measure, "lang long, grams long, total double").toPandas()
        for lang, own in seen.groupby("lang"):
            n, mean = own["grams"].to_numpy(float), own["total"].sum() / own["grams"].sum()
            off = n * (own["total"].to_numpy() / n - mean) ** 2
            if len(own) >= MIN_BOUND_ROWS:
                found[lang] = mean, np.sqrt(off.sum() / n.sum()), np.sqrt(off.mean())
    return replace(model, bounds=found)


def _log_sums(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the log probabilities of a text's n-grams by language, their number, its letters."""
    grams, letters = _grams(texts, model.bits)
    total, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for k, (found, count) in enumerate(grams):
        table = model.log_prob[k << model.bits:(k + 1) << model.bits]
        some = np.flatnonzero(count)
        if len(some):
            # one sparse entry for each n-gram, summed over the n-grams of a text
            total[some] += np.add.reduceat(table[found], (np.cumsum(count) - count)[some], axis=0, dtype=np.float64)
        n += count
    return total, n, letters


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and posterior probability of each text, and whether it is familiar."""
    if not texts:
        return [], np.empty(0), np.empty(0, bool)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    sums, n, letters = _log_sums(model, texts)
    total = sums + model.log_prior
    total -= total.max(axis=1, keepdims=True)
    odds = np.exp(total)
    best = odds.argmax(axis=1)
    score = 1.0 / odds.sum(axis=1)
    none = letters == 0
    score[none] = 0.0
    familiar = ~none
    if model.bounds is not None:
        mean, between, within = model.bounds[best].T
        familiar &= sums[np.arange(len(texts)), best] / n >= mean - DEVIATIONS * (between + within / np.sqrt(n))
    return [UNDETERMINED if z else model.languages[b] for b, z in zip(best, none)], score, familiar


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to all rows, from `text` alone, and familiar where the model has bounds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if model.bounds is not None:
        added.append(T.StructField("familiar", T.BooleanType()))
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        model = shared.value
        for part, texts in _split(batches):
            langs, score, familiar = score_texts(model, texts)
            columns = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(familiar)][:len(added)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)
