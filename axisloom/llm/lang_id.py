"""Language identification in two steps: family first, then one-versus-one inside the family.

Texts become hashed counts of letter 1- to 3-grams, square-rooted and scaled to unit length. A
linear support vector machine for each family (against the rest) picks the family; inside it,
one machine for each pair of languages votes. All are trained here, on the driver, from the
features of a bounded sample: about ``PER_LANGUAGE`` rows of each label, taken by a hash of their id.
Prediction reads whole texts, in pieces of bounded size, and nothing but the text.

The machines always name one of the trained languages. Whether a text is like that language at all
is a question of its own: the mean log-likelihood of its n-grams and its share of letters must not
be further off than those of nearly all sample rows of the language, with some slack.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.llm._worker import state

DIMENSIONS = 2048
PER_LANGUAGE = 600
PIECE = 1 << 18
UNKNOWN = "und"
#: A text is unlike a language beyond this quantile of the sample's distances times SLACK (LEAST_LIMIT at least).
QUANTILE = 0.995
SLACK = 1.5
LEAST_LIMIT = 8.0
#: Letters beyond which the distance of a text no longer becomes surer; smoothing of n-gram shares.
LETTERS = 400
SMOOTHING = 1e-5

# Families of languages; a label that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur pa mr gu ne",
    "semitic": "ar he am mt",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _LETTERS[0]


def features(text: str | None) -> np.ndarray | None:
    """Unit-length features of a whole text; None where it is null or has no letter."""
    return measured(text)[0]


def measured(text: str | None) -> tuple[np.ndarray | None, int, float]:
    """Features as above, the number of letters, and their share of all characters but white space and controls."""
    if not text:
        return None, 0, 0.0
    table = _letters()
    counts = np.zeros(DIMENSIONS)
    seen = shown = 0
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = c >= 0x10000
        alpha = table[np.where(wide, 0, c)]
        if wide.any():
            alpha[wide] = [chr(x).isalpha() for x in c[wide].tolist()]
        seen += int(alpha.sum())
        shown += int((c > 0x20).sum())
        c = np.concatenate([[np.uint32(0)], np.where(alpha, c, np.uint32(0)), [np.uint32(0)]]).astype(np.uint32)
        code = c.copy()
        for n in range(3):
            if n:
                code = code[:-1] * np.uint32(0x01000193) + c[n:]
            h = (code ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            whole = c[: len(code)] != 0 if n == 0 else (c[: len(code)] != 0) | (c[n:] != 0)
            counts += np.bincount((h >> np.uint32(21))[whole], minlength=DIMENSIONS)
    if not seen:
        return None, 0, 0.0
    x = np.sqrt(counts)
    return x / np.linalg.norm(x), seen, seen / shown


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, classes weighted alike; x ends in a column of ones, y is +-1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1.0 / (4.0 + penalty)  # rows have length sqrt(2), so the gradient's slope is at most 4
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (penalty * z - 2 * x.T @ (weight * slack * y))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))


@dataclass
class Likeness:
    """What texts of a language look like: log shares of n-grams, their mean, and limits of the distance and the share of letters."""

    logs: np.ndarray
    mean: float
    most: float = np.inf
    least_share: float = 0.0

    def distance(self, x: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """How far texts (rows of features) fall short of the mean log-likelihood, in units that fit their lengths."""
        return (self.mean - x * x @ self.logs) / np.sqrt(1 / letters + 1 / LETTERS)


def likeness(x: np.ndarray, letters: np.ndarray, share: np.ndarray) -> Likeness:
    """The likeness of a language, from the features, letters and shares of its sample."""
    q = (x * x).mean(axis=0) + SMOOTHING
    q /= q.sum()
    out = Likeness(np.log(q), float(q @ np.log(q)))
    out.most = max(LEAST_LIMIT, SLACK * float(np.quantile(out.distance(x, letters), QUANTILE)))
    out.least_share = float(np.quantile(share, 1 - QUANTILE)) / SLACK
    return out


@dataclass
class LanguageModel:
    """Family machines, the pairwise machines inside each family, and what texts of each language look like."""

    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[str, str, np.ndarray]]]
    likeness: dict[str, Likeness] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores, _ = self.judge(texts)
        return langs, scores

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether it looks like the sample of that language."""
        rows = [measured(t) for t in texts]
        langs, scores, alike = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        known = [k for k, r in enumerate(rows) if r[0] is not None]
        if not known or not self.families:
            return langs, scores, alike
        x = np.hstack([np.array([rows[k][0] for k in known]), np.ones((len(known), 1))])
        letters, share = (np.array([rows[k][n] for k in known], float) for n in (1, 2))
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        sure = _chance(margins[np.arange(len(known)), best]) if len(self.families) > 1 else np.ones(len(known))
        for f, family in enumerate(self.families):
            at = np.flatnonzero(best == f)
            if not len(at):
                continue
            names = self.languages[family]
            votes, least = np.zeros((len(at), len(names))), np.ones((len(at), len(names)))
            for a, b, w in self.pairs[family]:
                p = _chance(x[at] @ w)
                ia, ib = names.index(a), names.index(b)
                votes[:, ia] += (p >= 0.5) + 1e-3 * p
                votes[:, ib] += (p < 0.5) + 1e-3 * (1 - p)
                least[:, ia], least[:, ib] = np.minimum(least[:, ia], p), np.minimum(least[:, ib], 1 - p)
            win = votes.argmax(axis=1)
            for k, i, w in zip(at.tolist(), range(len(at)), win.tolist(), strict=True):
                langs[known[k]], scores[known[k]] = names[w], float(min(sure[k], least[i, w]))
        named = np.array([langs[k] for k in known])
        for lang, like in self.likeness.items():
            at = np.flatnonzero(named == lang)
            for k, ok in zip(at.tolist(), (like.distance(x[at, :-1], letters[at]) <= like.most) & (share[at] >= like.least_share), strict=True):
                alike[known[k]] = bool(ok)
        return langs, scores, alike


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit the model on rows that aren't held out and have a label.

    ``per_language`` bounds the sample of each label. One row of counts for each label and the
    sample's features (8 KB a row) come to the driver. Texts without letters are passed over. Without labelled rows the model
    predicts ``und`` for everything.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = slim.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel([], {}, np.zeros((0, DIMENSIONS + 1)), {})
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 1.2 * per_language / r["count"]) * (1 << 30))) for r in counts], "lang string, share long")
    sample = usable.join(F.broadcast(shares), "lang").withColumn("place", place).filter("place < share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("language")
        for batch in batches:
            rows = [(a, p, v[0].astype(np.float32).tobytes(), v[1], v[2]) for a, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (v := measured(t))[0] is not None]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=["lang", "place", "x", "letters", "share"])

    rows = sample.select("lang", "place", "text").mapInArrow(run, "lang string, place long, x binary, letters long, share double").orderBy("lang", "place").collect()
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, list[tuple[int, float]]] = {}
    for r in rows:
        if len(held.setdefault(r["lang"], [])) < per_language:
            held[r["lang"]].append(r["x"])
            sizes.setdefault(r["lang"], []).append((r["letters"], r["share"]))
    del rows
    languages: dict[str, list[str]] = {}
    for lang in sorted(held):
        languages.setdefault(FAMILY.get(lang, lang), []).append(lang)
    families = sorted(languages)
    order = [lang for f in families for lang in languages[f]]
    of = np.repeat(np.array(order), [len(held[k]) for k in order]) if order else np.zeros(0, str)
    x = np.ones((len(of), DIMENSIONS + 1))
    x[:, :-1] = np.frombuffer(b"".join(v for k in order for v in held.pop(k)), np.float32).reshape(-1, DIMENSIONS)
    weights = np.array([train_machine(x, np.where(np.isin(of, languages[f]), 1.0, -1.0)) if len(families) > 1 else np.zeros(DIMENSIONS + 1) for f in families]).reshape(-1, DIMENSIONS + 1)
    pairs = {f: [(a, b, train_machine(x[(of == a) | (of == b)], np.where(of[(of == a) | (of == b)] == a, 1.0, -1.0))) for a, b in combinations(languages[f], 2)] for f in families}
    alike = {k: likeness(x[of == k, :-1], *np.array(sizes[k], float).T) for k in order}
    return LanguageModel(families, languages, weights, pairs, alike)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the id, ``held_out``, ``lang_pred`` and ``score``.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or without a letter. A
    null id stays null and is not held out; repeated rows each give a row; very long texts are read whole, piece by piece; a tie goes to the
    language that comes first in its family; an empty table gives an
    empty one; other columns are ignored, whatever their names. Ids must be whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("language")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                langs, scores = model.predict(few.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is not identified; columns as they are.

    A row stays where its text has letters, its score is ``least`` at least, and the text looks
    like the sample of the language that was found. So null and empty texts go, and all rows where the model was
    trained on nothing. Ids may be null or repeat, rows are judged one by one; very long texts are read whole; an empty
    table gives an empty one.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("language")
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                few = batch.slice(k, 256)
                langs, scores, alike = model.judge(few.column(at).to_pylist())
                yield few.filter(pa.array([lang != UNKNOWN and s >= least and ok for lang, s, ok in zip(langs, scores, alike, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
