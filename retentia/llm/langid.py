"""Language identification by word-first backoff.

A known word is scored by its smoothed log frequency in each language.  An
unseen word falls back to its character n-grams (with word edges), first the
longest; wherever none of that length is known, the next shorter length is
tried.  A text's language has the highest sum; ``score`` is its share of the
probability after dividing the sums by the root of the word count, which keeps
long texts from all saturating.

Every language of the training fold is learnt.  The model is fitted on a bounded
sample of rows: about ``FIT_DOCS`` whole documents per language (all, if fewer),
or ``FIT_ROWS`` over the number of languages if that is less, and one document of
each language in any case.  Only the languages of a name are stored with it, so
the model grows with the sample and not with names times languages.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing was learnt; ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import letters
from .frames import hold, release

FIT_DOCS, FIT_ROWS = 2000, 128_000
MAX_GRAM = 5
#: Words that a worker remembers, and numbers (words times languages) in that memory.
MEMO_WORDS, MEMO_CELLS = 200_000, 12_800_000
#: Words that are looked up and summed at once.
STEP_WORDS = 50_000
UNKNOWN = "und"


def _name(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Logs:
    """Log frequencies: name r has ``gains[starts[r]:starts[r + 1]]`` over ``base`` in the languages ``columns``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, n: np.ndarray, totals: np.ndarray):
        self.starts, self.columns = starts, columns.astype(np.int32)
        # log((n + 0.5) / total) is log(0.5 / total), which names unseen in a language have, and log(2 n + 1).
        self.gains = np.log(2.0 * n + 1).astype(np.float32)
        self.base = np.log(0.5 / (totals + 0.5 * len(starts)))

    def means(self, owners: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Mean log frequency, in each language, of the names ``rows`` of each owner in 0 .. ``count`` - 1."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cells = np.repeat(owners, sizes) * len(self.base) + self.columns[at]
        sums = np.bincount(cells, self.gains[at], count * len(self.base)).reshape(count, len(self.base))
        return self.base + sums / np.maximum(np.bincount(owners, minlength=count), 1)[:, None]


class Model:
    """Sorted names of words and n-grams, and their log frequencies in each language."""

    def __init__(self, languages, word_names, word_logs, gram_names, gram_logs):
        self.languages = languages
        self.tables = {0: (word_names[0], word_logs[0])} | {n: (gram_names[n], gram_logs[n]) for n in gram_names}

    def index(self) -> dict[int, dict[int, int]]:
        """Row of each name, by table; built in each worker, since the arrays are smaller to send."""
        return {kind: dict(zip(names.tolist(), range(len(names)))) for kind, (names, _) in self.tables.items()}


def _logs(keys: pa.Array, columns: np.ndarray, n: np.ndarray, totals: np.ndarray):
    """Sorted names and their ``Logs``, of counts by (key, language)."""
    keys = keys.dictionary_encode()
    names = np.array([_name(k) for k in keys.dictionary.to_pylist()], np.uint64)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row = rank[keys.indices.to_numpy()]
    by_row = np.lexsort((columns, row))
    return names[order], Logs(np.searchsorted(row[by_row], np.arange(len(order) + 1)), columns[by_row], n[by_row], totals)


def _table(counts: dict[str, np.ndarray], totals: np.ndarray):
    values = np.array(list(counts.values()), np.float64).reshape(len(counts), len(totals))
    row, column = values.nonzero()
    return _logs(pa.array(list(counts), pa.string()).take(pa.array(row)), column, values[row, column], totals)


def docs_each(languages: int) -> int:
    """About how many documents of each language are learnt from."""
    return max(1, min(FIT_DOCS, FIT_ROWS // max(1, languages)))


def fit(docs: DataFrame) -> Model:
    """A model from the rows of ``docs`` that are not held out and have a language."""
    usable = docs.select("doc_id", "text", "lang").where(
        ~letters.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.withColumn("chance", letters.chance("doc_id", "text"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("chance").alias("least")).orderBy("lang").collect()
    if not sizes:
        return Model([], {0: np.empty(0, np.uint64)}, {0: None}, {}, {})
    # By code points, as ties go to the alphabetically first.
    sizes = sorted(sizes, key=lambda r: r["lang"])
    languages = [r["lang"] for r in sizes]
    wanted = docs_each(len(sizes))
    cuts = docs.sparkSession.createDataFrame(
        [(r["lang"], i, max(letters.cut(r["n"], wanted), r["least"] + 1)) for i, r in enumerate(sizes)],
        "lang string, id int, cut long")
    chosen = usable.join(F.broadcast(cuts), "lang").where("chance < cut").select("text", "id")

    def count(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0), batch.column(1)):
                counts.update((lang.as_py(), w) for w in letters.words(text.as_py()))
            if counts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts]),
                    pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    def split(batches):
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in range(1, MAX_GRAM + 1):
                    for g in grams(word, size):
                        counts[lang, size, g] += n
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()),
                pa.array([k[2] for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["lang", "size", "gram", "n"])

    words = chosen.mapInArrow(count, "lang int, word string, n long")
    words = hold(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))  # both tables start from these counts
    pieces = words.mapInArrow(split, "lang int, size int, gram string, n long").groupBy("lang", "size", "gram").agg(
        F.sum("n").alias("n"))

    def gathered(t: pa.Table, key: str):
        columns, n = t["lang"].to_numpy(), t["n"].to_numpy()
        return _logs(t[key].combine_chunks(), columns, n, np.bincount(columns, n, len(languages)))

    word_table = gathered(words.toArrow(), "word")
    # Grams seen once say little and are most of the table.
    found = pieces.where("n > 1").toArrow()
    release(words)
    gram_tables = {n: gathered(found.filter(pc.equal(found["size"], n)), "gram") for n in range(1, MAX_GRAM + 1)}
    return Model(languages, {0: word_table[0]}, {0: word_table[1]},
                 {n: t[0] for n, t in gram_tables.items()}, {n: t[1] for n, t in gram_tables.items()})


class Scorer:
    """Predictions for texts; remembers the scores of words met so far."""

    def __init__(self, model: Model):
        self.model, self.index = model, model.index()
        self.room = max(1, min(MEMO_WORDS, MEMO_CELLS // max(1, len(model.languages))))
        self.rows = np.zeros((self.room, max(1, len(model.languages))), np.float32)
        self.at: dict[str, int] = {}

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of distinct words per language; 0 for a word of which nothing is known."""
        out = np.zeros((len(words), len(self.model.languages)))
        left = list(enumerate(words))
        for kind in (0, *range(MAX_GRAM, 0, -1)):
            if kind not in self.index or not left:
                continue
            known, owners, rows, unseen = self.index[kind], [], [], []
            for i, word in left:
                before = len(rows)
                for name in (word,) if kind == 0 else grams(word, kind):
                    row = known.get(_name(name))
                    if row is not None:
                        rows.append(row)
                if len(rows) > before:
                    owners += [i] * (len(rows) - before)
                else:
                    unseen.append((i, word))
            if rows:
                owner = np.array(owners)
                seen, place = np.unique(owner, return_inverse=True)
                out[seen] = self.model.tables[kind][1].means(place, np.array(rows), len(seen))
            left = unseen
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        """Places in ``rows`` of at most ``room`` words."""
        new = {w for w in words if w not in self.at}
        if len(self.at) + len(new) > self.room:  # so that no row is dropped while it is used
            self.at.clear()
            new = set(words)
        if new:
            fresh, first = list(new), len(self.at)
            self.rows[first : first + len(fresh)] = self.score(fresh)
            self.at.update(zip(fresh, range(first, first + len(fresh))))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text.  Words of many texts are scored at once, those of a long text in steps."""
        step = min(STEP_WORDS, self.room)
        totals, lengths = [], []
        words: list[str] = []
        starts, owners = [], []

        def flush():
            if words:
                sums = np.add.reduceat(self.rows[self._rows(words)], starts, axis=0, dtype=np.float64)
                for owner, row in zip(owners, sums):
                    totals[owner] = totals[owner] + row
                words.clear(), starts.clear(), owners.clear()

        for text in texts:
            found = letters.words(text) if self.model.languages else []
            lengths.append(len(found))
            totals.append(0.0)
            at = 0
            while at < len(found):
                part = found[at : at + step - len(words)]
                starts.append(len(words))
                owners.append(len(totals) - 1)
                words += part
                at += len(part)
                if len(words) == step:
                    flush()
        flush()
        out = []
        for total, length in zip(totals, lengths):
            if not length:
                out.append((UNKNOWN, 0.0))
                continue
            share = np.exp((total - total.max()) / np.sqrt(length))
            best = int(total.argmax())
            out.append((self.model.languages[best], float(share[best] / share.sum())))
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            found = scorer.predict_all(t.as_py() for t in batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), letters.held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
