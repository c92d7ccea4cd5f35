"""Language identification in two steps: the family first, then one-versus-one support vector machines within it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within
from passageway.llm.linear import Rows, fit
from passageway.llm.ngrams import gram_counts

SIZES = (1, 2, 3)
BITS = 13
UNKNOWN = "und"
#: Families of languages by code (a fixed table); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "celtic": ["ga", "gd", "cy", "br"],
    "turkic": ["tr", "az", "uz", "kk", "ky", "tk"],
    "indo-aryan": ["hi", "ur", "bn", "pa", "mr", "gu", "ne", "si"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["ar", "he", "mt", "am"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "austronesian": ["id", "ms", "tl", "jv", "mg", "mi"],
    "sinitic": ["zh", "yue"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"={lang}")


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text, each size's share under a square root; length 1."""
    x = np.sqrt(gram_counts(text, SIZES, BITS))
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass
class Model:
    """Separators (weights, bias) of families, one against the rest, and of pairs of languages within a family."""

    languages: dict[str, list[str]]
    family: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    pair: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, text: str) -> tuple[str, float]:
        """The language and how sure that is: the family's share times the mean share of the pairs it wins in."""
        if not self.languages:
            return UNKNOWN, 0.0
        x = features(text)
        share = lambda margin: 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
        sure = {f: share(x @ w + b) for f, (w, b) in self.family.items()}
        family = max(self.languages, key=lambda f: (sure.get(f, 1.0), f))
        score = sure[family] / sum(sure.values()) if sure else 1.0
        codes = self.languages[family]
        votes, shares = dict.fromkeys(codes, 0), dict.fromkeys(codes, 0.0)
        for a, b in combinations(codes, 2):
            w, bias = self.pair[a, b]
            first = share(x @ w + bias)
            votes[a if first >= 0.5 else b] += 1
            shares[a] += first
            shares[b] += 1 - first
        best = max(codes, key=lambda c: (votes[c], shares[c], c))
        if len(codes) > 1:
            score *= shares[best] / (len(codes) - 1)
        return best, float(score)


def train(texts: DataFrame, rows_each: int = 800, most_rows: int = 12_000, cost: float = 30.0) -> Model:
    """Fit on rows (id, text, lang), texts with a letter.

    Classifiers are fitted on a bounded sample: of each language about ``rows_each`` rows by a hash of the id, of all
    at most ``most_rows``. Every language value found in the rows can be predicted if it is in the sample.
    """
    counts = texts.groupBy("lang").count()
    chance = counts.select("lang", (F.lit(float(rows_each)) / F.col("count")).alias("_chance"))
    draw = (F.xxhash64("id", F.lit(3)) / F.lit(float(1 << 63)) + 1) / 2
    drawn = texts.withColumn("_draw", draw).join(broadcast_within(chance), "lang").filter("_draw <= _chance")
    ids = drawn.select("id", (F.col("_draw") / F.col("_chance")).alias("_order")).orderBy("_order", "id").limit(most_rows).select("id").distinct()

    def sparse(batches):
        for batch in batches:
            columns, values = [], []
            for text in batch.column(0):
                x = features(text.as_py())
                at = np.flatnonzero(x)
                columns.append(at.astype(np.int16).tobytes())
                values.append(x[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(columns, pa.binary()), pa.array(values, pa.binary()), batch.column(1)], names=["columns", "values", "lang"])

    rows = drawn.join(F.broadcast(ids), "id").select("text", "lang").mapInArrow(sparse, "columns binary, values binary, lang string").collect()
    rows.sort(key=lambda r: (r["lang"], r["columns"], r["values"]))
    lang = np.array([r["lang"] for r in rows])
    family = np.array([family_of(x) for x in lang])
    model = Model({f: sorted(set(lang[family == f].tolist())) for f in sorted(set(family.tolist()))})
    if not rows:
        return model
    columns = [np.frombuffer(r["columns"], dtype=np.int16) for r in rows]
    x = Rows(
        np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns]),
        np.concatenate(columns),
        np.concatenate([np.frombuffer(r["values"], dtype=np.float32) for r in rows]),
        (len(rows), 1 << BITS),
    )
    if len(model.languages) > 1:
        model.family = {f: fit(x, family == f, "hinge", cost) for f in model.languages}
    for codes in model.languages.values():
        for a, b in combinations(codes, 2):
            of = (lang == a) | (lang == b)
            model.pair[a, b] = fit(x.take(of), lang[of] == a, "hinge", cost)
    return model


def has_letter(text: str = "text"):
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (0 to 1), from the whole text alone.

    Texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing was learnt.
    Repeated rows have equal predictions; an empty table gives no rows; columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB for each family and pair

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        found = [sent.value.predict(t) if ok else (UNKNOWN, 0.0) for t, ok in zip(texts, letters)]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    found = predict(F.coalesce(F.col(text).cast("string"), F.lit("")), has_letter(text))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")]
    return docs.withColumn("_found", found).select(*kept, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("lang_score"))


def training_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, text, lang) of documents with a language and a letter."""
    rows = docs.filter(F.col(lang).isNotNull() & has_letter(text))
    return rows.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
