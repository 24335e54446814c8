"""Hierarchical language identification.

A text is a bag of hashed byte 3- and 4-grams of its lower-cased letters.  A
linear model first predicts the language family; inside the family, a linear
support vector machine for each pair of languages votes.  The learning rows
are a bounded sample; its features, not its texts, reach the driver.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
without any learning rows every text is ``und``; families with one language
need no pairs; repeated rows get equal results; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bound_batches
from gleaner.llm.textcols import slices

# Families of ISO 639-1 codes.
FAMILY = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "indic": "hi bn mr ne pa gu".split(),
    "semitic": "ar he mt am".split(),
    "turkic": "tr az kk uz ky tt".split(),
    "uralic": "fi et hu".split(),
}
_OF = {code: family for family, codes in FAMILY.items() for code in codes}
DIM = 4096
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True


def family(lang: str) -> str:
    return _OF.get(lang.split("-")[0].lower(), lang)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows x DIM relative frequencies, has a letter) for parts of a column."""
    for at, rows, data, off in slices(column):
        b = _FOLD[data]
        # upper case of the two-byte Latin letters
        upper = np.zeros(len(b), dtype=bool)
        upper[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
        b[upper] += 0x20
        doc = np.repeat(np.arange(rows), np.diff(off)).astype(np.int64) * DIM
        x = np.zeros((rows, DIM), dtype=np.float32)
        c = b.astype(np.uint32)
        for width in (3, 4):
            n = len(c) - width + 1
            if n <= 0:
                continue
            h = np.zeros(n, dtype=np.uint32)
            for k in range(width):
                h = h * np.uint32(0x01000193) ^ c[k : k + n]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            good = (doc[:n] == doc[width - 1 :]) & ((c[:n] != 32) | (c[1 : n + 1] != 32))
            x += np.bincount((doc[:n] + h)[good], minlength=rows * DIM).reshape(rows, DIM)
        total = x.sum(axis=1, keepdims=True)
        x /= np.maximum(total, 1)
        letters = np.diff(np.concatenate(([0], np.cumsum(_ASCII[data])))[off]) > 0
        for i in np.flatnonzero(~letters):
            text = column[at + int(i)].as_py()
            letters[i] = bool(text) and any(ch.isalpha() for ch in text)
        yield x, letters


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, penalty: float = 1e-4) -> np.ndarray:
    """Linear support vector machine (squared hinge), last weight the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = np.zeros(x.shape[1], dtype=np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (2 * float((weight * (x**2).sum(axis=1)).sum()) + penalty)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        g = -2 * ((weight * slack * y) @ x) + penalty * v
        new = v - step * g
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


class Model:
    """Weights of the family models and of the pairs within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        z = np.sqrt(x)
        of = np.array([family(v) for v in langs])
        self.first = np.stack([_svm(z, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in self.families], axis=1)
        self.pairs = {}
        for members in self.members.values():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    pick = (names == a) | (names == b)
                    y = np.where(names[pick] == a, 1.0, -1.0).astype(np.float32)
                    self.pairs[a, b] = _svm(z[pick], y)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        z = np.sqrt(x)
        margin = z @ self.first[:-1] + self.first[-1]
        best = margin.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * margin.max(axis=1))) if len(self.families) > 1 else np.ones(len(x))
        out = np.empty(len(x), dtype=object)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(best == k), self.members[f]
            if len(members) == 1:
                out[rows] = members[0]
                continue
            votes = np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    w = self.pairs[a, members[j]]
                    p = 1 / (1 + np.exp(-4 * (z[rows] @ w[:-1] + w[-1])))
                    # a vote each; how sure it is only breaks ties
                    votes[:, i] += (p >= 0.5) + p / (4 * len(members))
                    votes[:, j] += (p < 0.5) + (1 - p) / (4 * len(members))
            top = votes.argmax(axis=1)
            out[rows] = np.array(members, dtype=object)[top]
            sure[rows] *= np.minimum(1, votes.max(axis=1) / (len(members) - 1 + 0.25))
        return out.tolist(), np.clip(sure, 0, 1)


def sample(docs: DataFrame, lang_col: str, order_col: str, most: int, most_langs: int) -> DataFrame:
    """About ``most`` rows at most, about as many of each language, chosen by
    hash, of the ``most_langs`` languages with most rows (ties by name)."""
    counts = docs.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col)
    sizes = {r[0]: r[1] for r in counts.limit(min(most_langs, most)).collect()}
    if not sizes:
        return docs.where(F.lit(False))
    each = max(1, most // len(sizes))
    h = F.pmod(F.xxhash64(F.lit("sample"), order_col), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, int((1 << 30) * min(1.0, each / n)))])
    return docs.where(h < F.get(F.array(F.element_at(share, F.col(lang_col))), F.lit(0)))


def train(docs: DataFrame, id_col: str, lang_col: str, text_col: str, most: int, most_langs: int = 200) -> Model | None:
    """Model of the labelled rows ``docs``, learned from about ``most``
    in the ``most_langs`` commonest languages."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    few = sample(known.select(id_col, lang_col, text_col), lang_col, id_col, most, most_langs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (x, _) in _parts(b.column(2)):
                packed = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
                part = b.slice(at, len(x))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), packed], ["id", "lang", "x"])

    got = few.mapInArrow(rows, "id string, lang string, x binary").toPandas().sort_values(["id", "lang"])
    if got.empty:
        return None
    x = np.stack([np.frombuffer(v, dtype=np.float16) for v in got["x"]]).astype(np.float32)
    return Model(x, got["lang"].tolist())


def _parts(column: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    at = 0
    for part in features(column):
        yield at, part
        at += len(part[0])


def predict_language(
    docs: DataFrame,
    learn: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 3000,
    sample_langs: int = 200,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (0 to 1).

    ``learn``: labelled rows, of which about ``sample_rows`` are used,
    of the ``sample_langs`` languages with most rows; a rarer value of the column
    is not learned, so that a dirty one costs the driver no more.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(train(learn, id_col, lang_col, text_col, sample_rows, sample_langs))
    result = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(result)
    def predict(text: pa.Array) -> pa.Array:
        model, langs, scores = shared.value, [], []
        for x, letters in features(text):
            got, sure = model.predict(x) if model else ([], [])
            for i, ok in enumerate(letters):
                langs.append(got[i] if ok and model else "und")
                scores.append(float(sure[i]) if ok and model else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    out = docs.select(F.col(id_col), predict(F.col(text_col)).alias("_p"))
    return out.select(id_col, F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
