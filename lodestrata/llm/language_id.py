"""Language identification by interpolated Kneser-Ney character language models.

A text is read as its words (runs of letters, in lower case), each between a start and an end mark; a
language's model gives each character its chance after the up to ORDER - 1 characters before it in the word.
The chances of the n-grams that a language has seen are worked out beforehand and stored in one sorted array of
hashes per order, each hash with the languages that have it, beside the interpolation weights of the contexts; scoring is
binary search from the longest n-gram down. The language of lowest cross-entropy per character wins; the
score is a softmax of the cross-entropies whose temperature is calibrated on documents that were not
trained on. `rejected` marks texts that their best model fits worse than all but REJECTED of such documents of
the language: so much is the rate at which documents of the language are rejected wrongly.

The models are fitted on a bounded sample: TRAIN_DOCS documents a language and CALIBRATION_DOCS more for the
calibration, chosen by a hash of the id, of TRAIN_CHARS characters a language and ALL_CHARS in all at most (but one document
at least; texts longer than the bound come last). Every language has a document to train on before any is kept for
calibration. A language with fewer than LEAST_CALIBRATED of these takes the limit of all languages together, and
without any documents for calibration nothing but texts without letters is rejected. All documents are scored, whole.

Defined results: `und` with score 0 for null texts, texts without a letter, and all texts when there is no labelled
text to learn from; documents of null id are never held out and never learned from; ties go to the language
first in order, of texts of one place in the sample to the smaller hash. A labelled text without letters teaches its
language nothing; a language that has no others isn't learned. An empty table gives no rows. Very long texts are read whole, word
by word. Repeated rows and extra columns need no special case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage, release

ORDER = 5
TRAIN_DOCS, CALIBRATION_DOCS = 300, 100
#: Most characters that are learned from, of a language and of all.
TRAIN_CHARS, ALL_CHARS = 1_000_000, 16_000_000
#: The part of a language's own documents that its limit rejects, and the fewest documents to find a limit by.
REJECTED, LEAST_CALIBRATED = 0.01, 20
UNKNOWN = "und"
#: Numbers (words times languages) that a worker remembers, and works out at once.
SCORES_HELD, SCORES_AT_ONCE = 2_000_000, 80_000
#: Most languages for which what an n-gram scores in a language that hasn't seen it is worked out beforehand as well.
FILLED_LANGS = 8

_B = np.uint64(0x9E3779B97F4A7C15)
_letters = regex.compile(r"\p{L}+").findall


def words(text: str | None) -> list[str]:
    return _letters(text.lower()) if text else []


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with their marks, each code's place in its word, and its word."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer(("\x01" + "\x02\x01".join(texts) + "\x02").encode("utf-32-le"), np.uint32).astype(np.uint64) if texts else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(texts)), sizes)
    return codes, np.arange(len(codes)) - starts[word], word


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """[k]: the hash of the k codes that end at each place (k = 0 unused)."""
    out, power, total = [np.zeros(len(codes), np.uint64)], np.uint64(1), np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[k:] = codes[: max(len(codes) - k, 0)]
            total = total + (shifted + np.uint64(7)) * power
            power = power * _B
            x = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(x ^ (x >> np.uint64(32)))
    return out


class Rows:
    """A sorted array of hashes, each with the languages that have it and a number for each of them."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]]):
        """found: for each language its sorted hashes and their numbers."""
        h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        lang = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found])
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.starts = np.append(first, len(h)).astype(np.int64)
        self.langs = lang[order]
        self.values = (np.concatenate([f[1] for f in found])[order] if found else np.zeros(0)).astype(np.float32)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position among hashes, language and number of each entry of those that are there."""
        at, row = _find(self.keys, hashes)
        at = np.flatnonzero(at)
        row = row[at]
        n = self.starts[row + 1] - self.starts[row]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[row], n)
        return np.repeat(at, n), self.langs[entry], self.values[entry]


class Model:
    """grams[k]: log2 of the chances of n-grams of k characters; contexts[k]: log2 of the weights that what is below
    an n-gram of k characters has after a context of k - 1."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.langs, self.order = sorted(lang for lang, own in counts.items() if own), order
        self.temperature, self.limits = 20.0, {}
        codes = {lang: _codes(sorted(counts[lang])) for lang in self.langs}
        # What may come next: the letters that any language has seen, the end of the word, and one place for all others.
        alphabet = set().union(*(np.unique(c[0]).tolist() for c in codes.values())) - {1} if codes else set()
        uniform = 1.0 / (len(alphabet) + 1)
        made = [_estimated(codes[lang], np.array([counts[lang][t] for t in sorted(counts[lang])], float), order, uniform) for lang in self.langs]
        self.grams = [None, *(Rows([m[k][0] for m in made]) for k in range(order))]
        self.contexts = [None, *(Rows([m[k][1] for m in made]) for k in range(order))]
        self.floor = np.float32(np.log2(uniform))
        self.filled = self._filled(list(codes.values())) if 0 < len(self.langs) <= FILLED_LANGS else None

    def _filled(self, coded: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple]:
        """For each order, the sorted n-grams of all languages with what each scores in each language, and the sorted contexts with their
        weights: what score_words() would find, so that most characters need one search."""
        codes, place = np.concatenate([c[0] for c in coded]), np.concatenate([c[1] for c in coded])
        h, out = _hashes(codes, self.order), [()]
        for k in range(1, self.order + 1):
            ok = np.flatnonzero(place >= max(1, k - 1))
            keys, first = np.unique(h[k][ok], return_index=True)
            ends = ok[first]
            scores = self._scores([x[ends] for x in h], [x[ends - 1] for x in h], np.minimum(place[ends], k - 1), k)
            contexts = self.contexts[k]
            weights = np.zeros((len(contexts.keys), len(self.langs)), np.float32)
            weights[np.repeat(np.arange(len(contexts.keys)), np.diff(contexts.starts)), contexts.langs] = contexts.values
            out.append((keys, scores, contexts.keys, weights))
        return out

    def _scores(self, h: list[np.ndarray], before: list[np.ndarray], place: np.ndarray, order: int) -> np.ndarray:
        """The log2 chance of each character by each language; h, before: hashes of the n-grams that end at it and before it."""
        total = np.zeros((len(place), len(self.langs)), np.float32)
        open_ = np.ones(total.shape, bool)
        for k in range(order, 0, -1):
            mine = np.flatnonzero((place >= k - 1) & open_.any(axis=1))
            at, lang, value = self.grams[k].look_up(h[k][mine])
            at = mine[at]
            fits = open_[at, lang]
            total[at[fits], lang[fits]] += value[fits]
            open_[at[fits], lang[fits]] = False
            at, lang, value = self.contexts[k].look_up(before[k - 1][mine] if k > 1 else np.zeros(len(mine), np.uint64))
            at = mine[at]
            missed = open_[at, lang]
            total[at[missed], lang[missed]] += value[missed]
        return total + np.where(open_, self.floor, np.float32(0))

    def _filled_scores(self, h: list[np.ndarray], before: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        total, todo = np.zeros((len(place), len(self.langs)), np.float32), np.arange(len(place))
        for k in range(self.order, 0, -1):
            keys, scores, context_keys, weights = self.filled[k]
            short = place[todo] < k - 1
            mine = todo[~short]
            found, i = _find(keys, h[k][mine])
            total[mine[found]] += scores[i[found]]
            missed = mine[~found]
            known, j = _find(context_keys, before[k - 1][missed] if k > 1 else np.zeros(len(missed), np.uint64))
            total[missed[known]] += weights[j[known]]
            todo = np.concatenate([missed, todo[short]])
        total[todo] += self.floor
        return total

    def score_words(self, texts: list[str]) -> np.ndarray:
        """The log2 chance of each word (its end mark included) by each language."""
        codes, place, word = _codes(texts)
        h, ends = _hashes(codes, self.order), np.flatnonzero(place >= 1)
        at, before = [x[ends] for x in h], [x[ends - 1] for x in h]
        total = self._scores(at, before, place[ends], self.order) if self.filled is None else self._filled_scores(at, before, place[ends])
        out = np.zeros((len(texts), len(self.langs)))
        for lang in range(len(self.langs)):
            out[:, lang] = np.bincount(word[ends], weights=total[:, lang], minlength=len(texts))
        return out


def _estimated(coded: tuple[np.ndarray, np.ndarray, np.ndarray], times: np.ndarray, order: int, uniform: float) -> list[tuple]:
    """For each order of one language, ((hashes, log2 chances) of its n-grams, (hashes, log2 weights) of their contexts)."""
    codes, place, word = coded
    h, out, lower = _hashes(codes, order), [], None
    for k in range(1, order + 1):
        ok = np.flatnonzero(place >= max(1, k - 1))
        grams, first, of = np.unique(h[k][ok], return_index=True, return_inverse=True)
        before = h[k - 1][ok - 1] if k > 1 else np.zeros(len(ok), np.uint64)
        contexts, context_of = np.unique(before[first], return_inverse=True)
        raw = np.bincount(of, weights=times[word[ok]], minlength=len(grams))
        count = raw
        if k < order:  # how many different characters come before; n-grams that begin a word have none
            _, longer = np.unique(h[k + 1][np.flatnonzero(place >= k)], return_index=True)
            ends = h[k][np.flatnonzero(place >= k)][longer]
            count = np.bincount(np.searchsorted(grams, ends), minlength=len(grams)).astype(float)
            starting = place[ok[first]] == k - 1
            count = np.where(starting, raw, count)
        once, twice = float((count == 1).sum()), float((count == 2).sum())
        off = once / (once + 2 * twice) if once and twice else 0.5
        total = np.bincount(context_of, weights=count, minlength=len(contexts))
        weights = off * np.bincount(context_of, minlength=len(contexts)) / total
        below = uniform if k == 1 else lower[1][np.searchsorted(lower[0], h[k - 1][ok[first]])]
        chance = (count - off) / total[context_of] + weights[context_of] * below
        lower = (grams, chance)
        out.append(((grams, np.log2(chance)), (contexts, np.log2(weights))))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[i] == wanted, i


class Scorer:
    """Cross-entropies of texts, with the scores of words remembered in bounded memory."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        counted = [Counter(words(t)) for t in texts]
        new = list(dict.fromkeys(w for c in counted for w in c if w not in self.index))
        langs = max(1, len(self.model.langs))
        if len(self.index) + len(new) > SCORES_HELD // langs:
            self.index, self.table = {}, self.table[:0]
            new = list(dict.fromkeys(w for c in counted for w in c))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            step = max(64, SCORES_AT_ONCE // langs)
            self.table = np.concatenate([self.table, *(self.model.score_words(new[i : i + step]) for i in range(0, len(new), step))])
        return [self._one(c) for c in counted]

    def _one(self, counted: Counter) -> np.ndarray | None:
        if not counted:
            return None
        n = np.fromiter(counted.values(), float, len(counted))
        at = np.fromiter(map(self.index.__getitem__, counted), np.int64, len(counted))
        sizes = np.fromiter(map(len, counted), float, len(counted)) + 1
        return -(n @ self.table[at]) / (n @ sizes)


def softmax(entropies: np.ndarray, temperature: float) -> np.ndarray:
    x = np.exp(-temperature * (entropies - entropies.min()))
    return x / x.sum()


def _batches(batch: pa.RecordBatch, column: int, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts are bounded in sum, or single rows."""
    low, held = 0, 0
    for i, value in enumerate(batch.column(column)):
        size = len(value.as_py() or "")
        if held and held + size > chars:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < batch.num_rows:
        yield batch.slice(low)


def sampled(docs: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> tuple[DataFrame, list[str]]:
    """lang, text, training (boolean) of the sample to fit on, and the languages in it; docs as of fit()."""
    usable = docs.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted, chars = train_docs + calibration_docs, max(1, min(TRAIN_CHARS, ALL_CHARS // max(1, len(sizes))))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rate = F.element_at(F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, 1.5 * wanted / n)))]), F.col("lang")) if sizes else F.lit(0.0)
    drawn = cut_lineage(usable.select("lang", "text", place.alias("place"), "doc_id").filter(F.col("place") < rate))
    order = [F.length("text") > chars, "place", "doc_id", F.xxhash64("text")]
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= wanted)
    # The first document of a language trains it; calibration takes its share of the others, evenly among them.
    training = (F.col("rank") - 1) * calibration_docs % wanted < train_docs
    through = F.sum(F.length("text")).over(Window.partitionBy("lang", "training").orderBy("rank"))
    ranked = ranked.withColumn("training", (F.col("rank") == 1) | training).withColumn("through", through)
    first = F.row_number().over(Window.partitionBy("lang", "training").orderBy("rank")) == 1
    kept = cut_lineage(ranked.withColumn("first", first).filter(F.col("first") | (F.col("through") <= chars)).select("lang", "text", "training"))
    release(drawn)
    return kept, sorted(sizes)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Models of the languages of docs (doc_id, text, lang), from a bounded sample of rows that aren't held out."""
    sample, langs = sampled(docs, train_docs, calibration_docs)
    if not langs:
        return Model({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 1):
                found: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for w, n in Counter(words(text)).items():
                        found[lang, w] += n
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "word", "n"])

    table = sample.filter("training").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in table.toArrow().columns), strict=True):
        counts.setdefault(lang, {})[word] = n
    model = Model(counts)
    if model.langs:
        _calibrate(model, sample.filter("NOT training"))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """The temperature of highest likelihood, and each language's cross-entropy that all but REJECTED of its documents keep below."""
    known = [(r["lang"], np.array(r["entropies"])) for r in entropies(rows.select("lang", "text"), model, "lang").collect() if r["entropies"] and r["lang"] in model.langs]
    if not known:
        return
    at = [model.langs.index(lang) for lang, _ in known]
    loss = lambda t: -sum(np.log(max(softmax(e, t)[i], 1e-12)) for i, (_, e) in zip(at, known, strict=True))
    model.temperature = min([2.0**x for x in range(0, 8)], key=loss)
    own = {lang: [float(e[i]) for i, (name, e) in zip(at, known, strict=True) if name == lang] for lang in model.langs}
    limit = lambda values: float(np.quantile(values, 1 - REJECTED))
    whole = limit([x for values in own.values() for x in values])
    model.limits = {lang: limit(values) if len(values) >= LEAST_CALIBRATED else whole for lang, values in own.items()}


def entropies(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """key, entropies (bits a character by language, null without letters) of each row of (key, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in _batches(batch, 1):
                made = [None if e is None else e.tolist() for e in scorer.entropies(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.float64()))], names=[key, "entropies"])

    return rows.select(key, "text").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, entropies array<double>")


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score, cross_entropy, rejected of each row of (key, text)."""
    e = F.col("entropies")
    if not model.langs:
        return docs.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    found = entropies(docs, model, key)
    best = F.array_min(e)
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position(e, best).cast("int"))
    limit = F.element_at(F.array(*[F.lit(model.limits.get(x, float("inf"))) for x in model.langs]), F.array_position(e, best).cast("int"))
    spread = F.aggregate(F.transform(e, lambda x: F.exp((best - x) * model.temperature)), F.lit(0.0), lambda a, x: a + x)
    return found.select(
        key,
        # The planner takes a literal array's element to be never null, so that coalesce() would be left out.
        F.when(e.isNotNull(), lang).otherwise(UNKNOWN).alias("lang_pred"),
        F.coalesce(1.0 / spread, F.lit(0.0)).alias("score"),
        best.alias("cross_entropy"),
        F.coalesce(best > limit, F.lit(True)).alias("rejected"),
    )


def op1(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang")
    out = predict(rows.select("doc_id", "text"), fit(rows))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
