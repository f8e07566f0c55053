"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is trained on a bounded, hash-chosen sample of labelled documents (``max_train``); its matrix
of log-probabilities (``buckets`` x languages) has a fixed size and is broadcast. Texts are scored in batches: the
counts of a batch form a sparse matrix (text, n-gram bucket), whose product with the log-probabilities is summed in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import groups, read_documents, tidy

UND = "und"
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Multipliers of the n-gram hash.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Bytes of texts scored together, and n-gram places handled at once; results do not depend on them.
_TOGETHER, _PLACES = 2_000_000, 1 << 18


def _counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of n-gram counts in parts: (text, bucket, count), repeated entries adding up.

    Character n-grams, n in ORDERS, of each lower-cased text framed by blanks. A part covers a stretch of the texts laid
    one after the other, and n-grams that begin in it are read to their end in the next one.
    """
    codes = np.frombuffer(b"".join(f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts), np.uint32)
    ends = np.cumsum(np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts)))
    for at in range(0, len(codes), _PLACES):
        part = codes[at : at + _PLACES + max(ORDERS) - 1]
        text = np.searchsorted(ends, np.arange(at, at + len(part)), "right")
        entries = []
        for n in ORDERS:
            count = min(len(part) - n + 1, _PLACES)
            if count <= 0:
                continue
            h = np.full(count, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ part[j : j + count]) * _FACTORS[j]
                h ^= h >> np.uint32(15)
            keep = text[:count] == text[n - 1 : n - 1 + count]
            entries.append((text[:count][keep] << BUCKET_BITS) | (h >> np.uint32(32 - BUCKET_BITS))[keep])
        entry, times = np.unique(np.concatenate(entries), return_counts=True)
        yield entry >> BUCKET_BITS, entry & ((1 << BUCKET_BITS) - 1), times


@dataclass(frozen=True)
class Model:
    """``languages`` in ascending order; ``log_prob[bucket, language]``; ``log_prior[language]``; ``usual[language]``,
    the mean log-probability of an n-gram of that language."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    usual: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities of each text in each language, number of its n-grams)."""
        out, sizes = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts))
        for text, bucket, times in _counts(texts):
            sizes += np.bincount(text, times, len(texts))
            for i in range(len(self.languages)):
                out[:, i] += np.bincount(text, self.log_prob[bucket, i] * times, len(texts))
        return out, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, posterior probability, fit) of each text; ties go to the first language in ascending order.

        The fit is the mean log-probability of the text's n-grams less what is usual in that language: about 0 for its own texts.
        """
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        scores, sizes = self.scores(texts)
        best = scores.argmax(axis=1)
        top = scores[np.arange(len(texts)), best]
        fit = (top - self.log_prior[best]) / np.maximum(sizes, 1) - self.usual[best]
        return [self.languages[i] for i in best.tolist()], 1.0 / np.exp(np.minimum(scores - top[:, None], 0.0)).sum(axis=1), fit


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            docs[lang] = docs.get(lang, 0) + len(texts)
            total = totals.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for part in groups(pa.array(texts, pa.string()), _TOGETHER):
                for _, bucket, times in _counts(part.to_pylist()):
                    total += np.bincount(bucket, times, 1 << BUCKET_BITS).astype(np.int64)
    for lang, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": used.astype("int32"), "n": counts[used], "docs": 0})
        yield pd.DataFrame({"lang": [lang], "bucket": np.array([-1], "int32"), "n": [0], "docs": [docs[lang]]})


def train(labelled: DataFrame, max_train: int = 20_000, smoothing: float = 0.5) -> Model:
    """Fit on at most ``max_train`` rows of ``labelled(doc_id, text, lang)``, chosen by a hash of doc_id.

    Rows without text or lang are not used. n-grams are counted inside the tasks; what reaches the
    driver is at most one number per bucket and language.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = known.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_train).distinct()
    sample = known.join(F.broadcast(chosen), known["doc_id"] == chosen["_id"], "left_semi").select("lang", "text")
    counts = sample.mapInPandas(_count_batches, "lang string, bucket int, n long, docs long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.full((1 << BUCKET_BITS, len(languages)), smoothing)
    prior = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        table[grams["bucket"].to_numpy(), i] += grams["n"].to_numpy()
        prior[i] = own["docs"].sum()
    if not languages:
        return Model(languages, table, prior, prior)
    share = table / table.sum(axis=0)
    return Model(languages, np.log(share), np.log(prior / prior.sum()), (share * np.log(share)).sum(axis=0))


def predicted(docs: DataFrame, model: Model) -> Column:
    """A column struct(lang_pred, score, fit) for ``docs["text"]``; ``und`` and 0 for null texts and texts without a letter.

    Only the text goes to the Python workers, and only the struct comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, fit double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.predict(g.to_pylist()) for g in groups(texts.fill_null(""), _TOGETHER)]
            names, *numbers = ([x for f in found for x in f[k]] for k in range(3))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], ["lang_pred", "score", "fit"])
        tidy()

    nothing = F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("fit"))
    return F.when(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)), scored(docs["text"])).otherwise(nothing)


def held_out(doc_id: str = "doc_id"):
    """True for documents whose crc32 of the decimal doc_id leaves 1 modulo 3; they are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, max_train: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row; the score is the posterior.

    Learns from text and lang of rows that are not held out; doc_id, source and lang are no inputs of a
    prediction. ``und`` with score 0: null text, no letter, or nothing to learn from. A null doc_id
    counts as not held out and is not learned from. Repeated rows give repeated, equal rows; very long
    texts are scored whole; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out()), max_train)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return slim.select("doc_id", "held_out", predicted(slim, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def drop_unidentified(docs: DataFrame, min_score: float = 0.5, min_fit: float = -6.0, max_train: int = 20_000) -> DataFrame:
    """``docs`` without the rows whose language is undetermined, scored below ``min_score``, or whose n-grams fit the
    language found worse than ``min_fit``; columns unchanged.

    The posterior alone only tells the learned languages apart. The fit, the mean log-probability of a text's n-grams less what is usual,
    also finds texts of languages that were not learned. Where no row has a label there is nothing to learn from: then only rows
    without a letter go.
    """
    model = train(docs.where(~held_out()), max_train)
    if not model.languages:
        return docs.where(F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    found = predicted(docs, model)
    return docs.where((found["lang_pred"] != UND) & (found["score"] >= min_score) & (found["fit"] >= min_fit))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_documents(spark, sf_dir))
