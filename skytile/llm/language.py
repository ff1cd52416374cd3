"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed 1- to 3-grams are counted over all learnable documents. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (at most ``SAMPLE`` documents of
each language, those of smallest hash of id and text), and a temperature is then fitted on every seventh document
of the sample, which the weights have not seen. Predictions read the text alone.

Null texts and texts without a letter (``str.isalpha`` of some character) are ``und`` with score 0; so is everything
if nothing can be learned. Rows with a null language or text teach nothing; null ids are ids like others. Repeated
rows teach once and are predicted each; rows of one id and different texts are told apart. Ties go to the first
language in order. Long texts are read whole. The list of languages is taken to be bounded. Other columns pass
through; one named like the result column is replaced by it. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skytile.session import ship

FEATURES = 1 << 16
#: Most documents of one language that the weights and the temperature are fitted on.
SAMPLE = 1500
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
EPOCHS = 3
#: Expected share by which more rows than ``SAMPLE`` are drawn of a language before they are ranked.
MARGIN = 1.25
UNKNOWN = "und"

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of the lower-cased text: features (ascending) and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    one = c * _MIX[0]
    one ^= one >> np.uint32(15)
    parts = [one >> np.uint32(16)]
    if len(c) > 1:
        two = (one[:-1] * _MIX[1]) ^ one[1:]
        two ^= two >> np.uint32(13)
        two *= _MIX[2]
        parts.append(two >> np.uint32(16))
        if len(c) > 2:
            three = (two[:-1] * _MIX[1]) ^ one[2:]
            three ^= three >> np.uint32(13)
            three *= _MIX[2]
            parts.append(three >> np.uint32(16))
    f = np.sort(np.concatenate(parts).astype(np.uint16))
    edge = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
    return f[edge].astype(np.int64), np.diff(np.append(edge, len(f)))


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f, n = grams(text)
    v = (1 + np.log(n)) * idf[f]
    return f, v / max(np.sqrt(v @ v), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Languages, inverse document frequencies, weights (language by feature) and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def logits(self, text: str) -> np.ndarray:
        f, v = tfidf(text, self.idf)
        return self.weights[:, f] @ v

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Follow-the-regularised-leader with per-coordinate rates, then the temperature of least log loss."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rows = [tfidf(t, idf) for t in texts]
    held = np.arange(len(rows)) % 7 == 6
    z, n = np.zeros((len(langs), FEATURES)), np.zeros((len(langs), FEATURES))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(np.flatnonzero(~held)):
            f, v = rows[i]
            zf, nf = z[:, f], n[:, f]
            w = weights(zf, nf)
            p = softmax(w @ v)
            p[y[i]] -= 1
            g = p[:, None] * v
            grown = nf + g * g
            z[:, f] = zf + g - (np.sqrt(grown) - np.sqrt(nf)) / ALPHA * w
            n[:, f] = grown
    model = Model(langs, idf, weights(z, n))
    if held.any():
        logits = [model.weights[:, f] @ v for f, v in (rows[i] for i in np.flatnonzero(held))]

        def loss(t):
            return -sum(np.log(max(softmax(l / t)[k], 1e-12)) for l, k in zip(logits, y[held]))

        model.temperature = float(min(np.exp(np.linspace(np.log(0.02), np.log(5), 60)), key=loss))
    return model


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """k, text and lang of at most ``sample`` different rows (doc_id, text, lang) of each language.

    Hashes below a share of their range that the language's size gives are few, however large the language
    or often a row is, and only they are ranked. Equal rows have equal hashes and count once.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    place = key / F.lit(float(1 << 64)) + 0.5
    sizes = rows.groupBy("lang").agg((F.lit(MARGIN * sample) / F.count("*")).alias("share"))
    drawn = rows.select("lang", key.alias("k"), place.alias("place")).join(F.broadcast(sizes), "lang").where("place < share").select("lang", "k").distinct()
    bounds = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).where(F.col("r") <= sample).groupBy("lang").agg(F.max("k").alias("last"))
    # A row per language, so broadcast: texts stay where they are.
    return rows.withColumn("k", key).join(F.broadcast(bounds), "lang").where("k <= last").dropDuplicates(["lang", "k"]).select("k", "text", "lang")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on ``docs``: frequencies from all of its rows with text and language, weights from the bounded sample."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[grams(text)[0]] += 1
                n += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(hit, -1), pa.int64()), "n": pa.array(np.append(df[hit], n), pa.int64())})

    counts = rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # FEATURES + 1 rows at most
    df, total = np.zeros(FEATURES), 0
    if len(counts):
        total = int(counts.loc[counts.feature == -1, "n"].sum())
        known = counts[counts.feature >= 0]
        df[known.feature.to_numpy()] = known.n.to_numpy()
    idf = np.log((1 + total) / (1 + df)) + 1

    chosen = sampled(rows, sample)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "lang", "text"])
        m = fit(pdf["text"].tolist(), pdf["lang"].tolist(), idf)
        return pd.DataFrame({"langs": [m.langs], "weights": [m.weights.astype("<f4").tobytes()], "temperature": [m.temperature]})

    # One task, as the sample is bounded; the model is one row.
    fitted = chosen.select("k", "text", "lang", F.lit(1).alias("one")).groupBy("one").applyInPandas(learn, "langs array<string>, weights binary, temperature double").collect()
    if not fitted:
        return Model([], idf, np.zeros((0, FEATURES)))
    m = fitted[0]
    return Model(list(m["langs"]), idf, np.frombuffer(bytes(m["weights"]), "<f4").reshape(-1, FEATURES).astype(float), m["temperature"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "lang_id") -> DataFrame:
    """``docs`` with lang_pred and score in one struct column ``out_col``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.weights, model.temperature))  # FEATURES x languages

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        m = Model(*shared.value)
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out_col, identify(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_id.lang_pred", "lang_id.score")
