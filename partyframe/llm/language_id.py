"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the hashed n-grams (1 to 3 characters), added count, characters taken at a time, languages at most:
#: the matrix that is broadcast has MAX_LANGUAGES * BUCKETS float32 at most.
BUCKETS, SMOOTHING, WINDOW, MAX_LANGUAGES = 1 << 16, 0.5, 1 << 18, 512
UNKNOWN = "und"
letter = regex.compile(r"\p{L}").search


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """The bucket of each 1-, 2- and 3-gram of the lower-cased text with a space on both sides, WINDOW places at a time."""
    whole = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(whole), WINDOW):
            code = whole[start : start + WINDOW + 2]
            one = code * np.uint32(2654435761)
            two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + code[1:] * np.uint32(3266489917)
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(668265263) + code[2:] * np.uint32(374761393)
            yield np.concatenate([((h ^ (h >> np.uint32(16))) * np.uint32(2246822519)) >> np.uint32(16) for h in (one[:WINDOW], two[:WINDOW], three[:WINDOW])])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray  # languages
    log_prob: np.ndarray  # buckets x languages, float32

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """texts x languages: a sparse row of buckets for each text times the matrix, then normalised. Memory is bounded
        by WINDOW x languages, however long a text is."""
        scores = np.stack([sum(self.log_prob[b].sum(axis=0, dtype=np.float64) for b in ngram_buckets(t)) for t in texts]) + self.log_prior
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def fit_language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts of n-gram buckets by language over all rows with text and language: a task sends one row for each
    language and bucket that it met, so the shuffle has tasks x languages x BUCKETS rows at most."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS + 1, np.int64)
                for buckets in ngram_buckets(text.as_py()):
                    held[lang] += np.bincount(buckets, minlength=BUCKETS + 1)
                held[lang][BUCKETS] += 1
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("bucket") == BUCKETS).select("lang", "n").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    languages = tuple(r.lang for r in found)
    matrix = np.zeros((BUCKETS, len(languages)))
    table = counted.where(F.col("bucket") < BUCKETS).toArrow()
    column = {lang: k for k, lang in enumerate(languages)}
    matrix[table["bucket"].to_numpy(), [column[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    matrix += SMOOTHING
    prior = np.log(np.array([r.n for r in found], float) / max(1, sum(r.n for r in found))) if found else np.zeros(0)
    return LanguageModel(languages, prior, np.log(matrix / matrix.sum(axis=0, keepdims=True)).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row; no shuffle, the matrix is broadcast.

    Texts that are null or have no letter, and all texts if nothing could be learned, get `und` with score 0.
    score is the posterior of the predicted language; of equals the first by name wins. Texts count whole, in windows;
    repeated rows are predicted each; an empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(1)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            group: list[int] = []
            size = 0
            for k in range(len(texts)):
                text = texts[k].as_py()
                if model.languages and text and letter(text):
                    group.append(k)
                    size += len(text)
                if group and (size > WINDOW or k + 1 == len(texts)):
                    posterior = model.posteriors([texts[g].as_py() for g in group])
                    best = posterior.argmax(axis=1)
                    score[group] = posterior.max(axis=1)
                    for g, b in zip(group, best.tolist(), strict=True):
                        lang[g] = model.languages[b]
                    group, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(predict, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the fold that is kept from learning: crc32 of the id as text, modulo folds, is 0. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score): learned from the rows outside the held-out fold, predicted for all rows."""
    model = fit_language_id(docs.where(~held_out(id_col)), text_col, lang_col)
    return predict_language(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
