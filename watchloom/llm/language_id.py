"""Language identification by multilingual mixture inference.

A model holds, for each language, the likelihood of every hashed byte 4-gram, from labelled documents. A document
is taken as a mixture: each of its n-grams comes from one of the languages, in unknown proportions, which
expectation-maximisation estimates. Languages are added in the order of their proportion as long as the
log-likelihood grows by more than the penalty, so a document has the fewest languages that explain it. The
prediction is the language with the largest proportion in the selected set, the score that proportion.

Defined results: a null text or one without a letter (Unicode category L) is und with score 0, as is every text if nothing was learnt;
ties of proportions go to the first language by name; repeated rows and null ids are predicted each by itself (ids are whole
numbers or texts of such); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, unit_hash

BUCKET_BITS = 16
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't lower-case letters become spaces.
PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def ngrams(text: str) -> np.ndarray:
    """Bucket of each byte 4-gram of the lower-cased letters; runs of other characters are one space."""
    data = PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    gap = data == 32
    keep = ~gap
    keep[0] = True
    keep[1:] |= ~gap[:-1]
    x = data[keep].astype(np.uint32)
    if len(x) < 4:
        x = np.concatenate((x, np.full(4 - len(x), 32, dtype=np.uint32)))
    grams = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    """languages by name, and P(bucket | language) as [bucket, language]."""

    languages: list[str]
    likelihood: np.ndarray


def train(docs: DataFrame, per_language: int = 20_000, most_languages: int = 128, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", smoothing: float = 0.5) -> Model:
    """Learns from about per_language documents of each language, chosen by a hash of the id.

    The model is one table of 65536 floats for each language, which every task gets; most_languages bounds it. A corpus with more labels than that needs a larger
    value (a thousand languages take 260 MB): a label that isn't learnt is never predicted. Of more labels than most_languages the most frequent are learnt, so a dirty label column can't fill the driver. What reaches
    the driver is a count for each language and bucket, 65536 buckets at most.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), unit_hash(F.lit("language"), F.col(id_col)).alias("u"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"])))) if sizes else F.create_map().cast("map<string,double>")
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if LETTER.search(text):
                    sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, dtype=np.int64))
                    sums[lang] += np.bincount(ngrams(text), minlength=1 << BUCKET_BITS)
        for lang, counts in sums.items():
            at = np.nonzero(counts)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    counts = rows.filter(F.col("u") < share).select("lang", "text").mapInPandas(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    table = np.full((1 << BUCKET_BITS, len(languages)), smoothing)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(np.int64), k] += own["n"].to_numpy(np.float64)
    return Model(languages, (table / table.sum(axis=0)).astype(np.float32) if languages else table)


def proportions(likelihood: np.ndarray, counts: np.ndarray, tolerance: float = 1e-4, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of the columns by expectation-maximisation; rows are n-grams, counts how often.

    It runs until no proportion changes by the tolerance; rounds is only a safeguard.
    """
    n, k = float(counts.sum()), likelihood.shape[1]
    share = np.full(k, 1.0 / k, dtype=np.float32)
    if k == 1:
        return share, float(counts @ np.log(likelihood[:, 0]))
    for _ in range(rounds):
        weighed = counts / (likelihood @ share)
        new = share * (weighed @ likelihood) / np.float32(n)
        done = np.abs(new - share).max() < tolerance
        share = new
        if done:
            break
    return share / share.sum(), float(counts @ np.log(likelihood @ share))


def infer(model: Model, text: str | None, penalty: float = 3.0) -> tuple[str, float, dict[str, float]]:
    """(language, score, proportion of each selected language) of a text. penalty: times log(n-grams) for each language more."""
    if not text or not model.languages or not LETTER.search(text):
        return UNKNOWN, 0.0, {}
    buckets, counts = np.unique(ngrams(text), return_counts=True)
    counts = counts.astype(np.float32)
    likelihood = model.likelihood[buckets]
    everything, _ = proportions(likelihood, counts)
    order = np.argsort(-everything, kind="stable")
    price = penalty * np.log(counts.sum() + 1)
    # the single language is the likeliest one, which need not have the largest share of the full mixture
    single = counts @ np.log(likelihood)
    chosen, share, best = [int(np.argmax(single))], np.ones(1), float(single.max())
    for k in range(2, len(order) + 1):
        own, fit = proportions(np.ascontiguousarray(likelihood[:, order[:k]]), counts)
        if fit - price * (k - 1) <= best:
            break
        chosen, share, best = order[:k].tolist(), own, fit - price * (k - 1)
    found = {model.languages[i]: float(p) for i, p in zip(chosen, share, strict=True)}
    lang = min(found, key=lambda x: (-found[x], x))
    return lang, min(1.0, found[lang]), found


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", penalty: float = 3.0) -> DataFrame:
    """doc_id, lang_pred, score, languages (proportion of each selected language) of every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65536 floats for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            rows = [infer(own, text, penalty) for text in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "languages": [r[2] for r in rows]})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, lang_pred string, score double, languages map<string,double>").withColumn("doc_id", F.col("id").cast("bigint")).select("doc_id", "lang_pred", "score", "languages")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Learns from the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score, languages."""
    model = train(docs.filter(~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col)
    out = predict(docs, model, text_col, id_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The input's rows in an identified language whose share is at least least, with all their columns."""
    model = train(docs.filter(~held_out(id_col)), text_col=text_col, lang_col=lang_col, id_col=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(text: pd.Series) -> pd.Series:
        found = [infer(shared.value, t) for t in text]
        return pd.Series([lang != UNKNOWN and score >= least for lang, score, _ in found])

    return docs.filter(keeps(F.col(text_col)))
