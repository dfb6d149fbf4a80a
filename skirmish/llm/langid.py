"""Language identification: scripts narrow the candidates, a Viterbi pass over per-word scores labels spans of mixed text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows that the model is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: The byte trigrams of words are hashed to so many bits.
BITS = 16
#: Log-probability that a change of language costs.
SWITCH = 12.0
#: Share of a language's letters above which it counts as written in a script.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

# First and last code points of letters, by script.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = sorted({s for s, _, _ in SCRIPTS})
_BLANK = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_NON_LATIN = 0xCE  # lead bytes from here on stand for code points above Latin and its marks


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def _grams(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text's words between single spaces, the trigrams' hashes at each byte, and where the words start and how long they are."""
    words = text.lower().encode("utf-8", "replace").translate(_BLANK).split()
    flat = b" " + b" ".join(words) + b" "
    raw = np.frombuffer(flat, np.uint8).astype(np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    h = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    return flat, h, starts, lens


def _scripts(flat: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each word, how many of its letters are of each script."""
    out = np.zeros((len(starts), len(SCRIPT_NAMES)), np.int32)
    for i, w in enumerate(flat.decode("utf-8", "replace").split()[: len(starts)]):
        for c in w:
            o = ord(c)
            for s, a, z in SCRIPTS:
                if a <= o <= z:
                    out[i, SCRIPT_NAMES.index(s)] += 1
                    break
    return out


class Model:
    """Log-probabilities of byte trigrams by language, and the scripts that each language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts.astype(np.float64) + 0.2
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))  # hash x language
        self.written = scripts > SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))  # language x script

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages, lengths in bytes). Languages not written in a word's script are out, where any is."""
        flat, h, starts, lens = _grams(text)
        if not len(lens):
            return np.zeros((0, len(self.langs)), np.float32), lens
        score = np.add.reduceat(self.table[h], starts, axis=0)
        # where all letters are Latin and all languages are written so, nothing can be out
        if max(flat) >= _NON_LATIN or not self.written[:, SCRIPT_NAMES.index("latin")].all():
            counts = _scripts(flat, starts, lens)
            fits = counts @ self.written.T.astype(np.int32) > 0
            some = fits.any(axis=1)
            score[some[:, None] & ~fits] = -1e4
            score[(counts.sum(axis=1) > 0) & ~some] = 0.0  # a script that no language has: no vote
        return score, lens

    def path(self, score: np.ndarray) -> np.ndarray:
        """The best language of every word, changes costing SWITCH each."""
        total = score.sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        gain = np.cumsum(score - score[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(score.shape[1]), gain[:-1]]), axis=0), 0.0)
        if ((gain - low).max(axis=0) <= SWITCH).all():  # no run of words gains what one change costs: one language it is
            return np.full(len(score), best, np.int64)
        back = np.empty(score.shape, np.int64)
        state = score[0].astype(np.float64)
        stay = np.arange(score.shape[1])
        for i in range(1, len(score)):
            top = int(state.argmax())
            change = state[top] - SWITCH > state
            back[i] = np.where(change, top, stay)
            state = np.where(change, state[top] - SWITCH, state) + score[i]
        out = np.empty(len(score), np.int64)
        out[-1] = int(state.argmax())
        for i in range(len(score) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of each span."""
        if not text or not has_letter(text):
            return []
        score, _ = self.word_scores(text)
        if not len(score):
            return []
        path = self.path(score)
        cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(a, b, self.langs[path[a]]) for a, b in zip(cut, cut[1:])]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the most letters on the path; score: its share of them times its posterior over the whole text."""
        if not text or not has_letter(text) or not self.langs:
            return UNKNOWN, 0.0
        score, lens = self.word_scores(text)
        if not len(score):
            return UNKNOWN, 0.0
        path = self.path(score)
        share = np.bincount(path, lens, len(self.langs))
        k = int(share.argmax())
        mine = score[path == k].sum(axis=0, dtype=np.float64)
        posterior = 1.0 / np.exp(np.minimum(mine - mine[k], 50)).sum()
        return self.langs[k], float(share[k] / share.sum() * posterior)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Fits on the labelled rows of ``docs`` with the smallest hashes of their ids, ``rows`` of them at most.

    Texts are counted on the executors; the driver gets one table of 2^16 counts per language and task, 16 tasks at most.
    Rows without text or language don't count; without any the model knows no language and predicts ``und``.
    """
    have = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = have.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    part = have.join(F.broadcast(ids), F.col(id_col) == F.col("__id"), "left_semi")  # bounded by ``rows``
    common.small_batches(docs.sparkSession)

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat, h, starts, lens = _grams(text)
                if not len(lens):
                    continue
                if lang not in grams:
                    grams[lang], scripts[lang] = np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
                grams[lang] += np.bincount(h, minlength=1 << BITS)
                if max(flat) >= _NON_LATIN:
                    scripts[lang] += _scripts(flat, starts, lens).sum(axis=0)
                else:
                    scripts[lang][SCRIPT_NAMES.index("latin")] += int(lens.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in grams.values()], pa.binary()), pa.array([x.tobytes() for x in scripts.values()], pa.binary())], ["lang", "grams", "scripts"])

    got = part.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).repartition(16).mapInArrow(count, "lang string, grams binary, scripts binary").collect()
    langs = sorted({r.lang for r in got})
    counts, scripts = np.zeros((len(langs), 1 << BITS), np.int64), np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
    for r in got:
        counts[langs.index(r.lang)] += np.frombuffer(r.grams, np.uint32)
        scripts[langs.index(r.lang)] += np.frombuffer(r.scripts, np.int64)
    return Model(langs, counts, scripts)


def _apply(docs: DataFrame, model: Model, keep: list, schema: str, each) -> DataFrame:
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language
    n = len(keep)

    def run(batches):
        m = shared.value
        for b in batches:
            seen: dict[str | None, tuple] = {}
            out = []
            for t in b.column(n).to_pylist():
                if t not in seen:
                    seen[t] = each(m, t)
                out.append(seen[t])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *each.arrays(out)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(*keep, F.col("text")).mapInArrow(run, schema)


class _Predict:
    def __call__(self, model, text):
        return model.predict(text)

    def arrays(self, out):
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]


class _Spans:
    def __call__(self, model, text):
        return model.spans(text)

    def arrays(self, out):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())]))
        return [pa.array([[{"first": a, "after": b, "lang": c} for a, b, c in x] for x in out], kind)]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): one row per row of ``docs``.

    Null, empty and letterless texts give ``und`` and 0. Texts are read whole at any length; repeated rows give equal rows;
    ties go to the language first in code-point order; other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _apply(rows, model, ["id"], f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double", _Predict())


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<first, after, lang>>): the spans of words of one language each; nothing for letterless texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n, kind = ["id"], rows.schema["id"].dataType.simpleString()
    return _apply(rows, model, n, f"id {kind}, spans array<struct<first:int,after:int,lang:string>>", _Spans())


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: not ``und``, and a score of at least ``least``."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            seen: dict[str | None, bool] = {}
            for t in (values := b.column(at).to_pylist()):
                if t not in seen:
                    lang, score = shared.value.predict(t)
                    seen[t] = lang != UNKNOWN and score >= least
            yield b.filter(pa.array([seen[t] for t in values], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """The rows that the model of the query and of the pipeline never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predict(docs, fitted(docs))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
