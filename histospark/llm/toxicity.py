"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms, accents, look-alike letters and digits that stand for letters. An Aho-Corasick
automaton finds the lexicon's entries, which are beginnings of words; what an exception phrase covers does not count. The
weights found, divided by the number of words, give the score through a logistic curve.

The lexicon is learned: beginnings of words, and whole words, that labelled documents of label 1 have, or have often for their length, and
others hardly ever do. An entry's weight is the logarithm of how much more of their words it makes up in the former. So are the
exception phrases: an entry's word with the word before or after it, where documents of label 0 have that and others hardly ever do. Training
reads at most SAMPLE labelled documents, chosen by a hash of the id; what is collected or broadcast on the way is of these alone. Of
them copies and near copies count as one document.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .worker_memory import tidied

SAMPLE = 20_000
#: Lengths of the beginnings that are features; shorter and longer words are features whole.
SHORTEST, LONGEST = 4, 12
#: A document has a feature often if that is one in so many of its words or more, and twice at least.
RATE = 200
#: Near copies share a pair of smallest hashes in one of BANDS bands.
BANDS = 6
OFTEN = "\t"
#: Features that a task holds before it sends them on.
HELD = 50_000
#: So many words are added to the length of every text, so that one word of a very short one is not all of it.
SMOOTH = 20

#: Letters of other scripts by the Latin letters that they look like, and signs by the letters that they stand for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ӏ": "l",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l"}
_WORD = re.compile(r"[^\W_]+")
_TABLE = {ord(k): v.replace("i", "l") for k, v in (LOOKALIKES | SIGNS | {"i": "i"}).items()}


def fold(text: str) -> str:
    """The words of a text, folded, each after a space. i, l, 1 and | become one letter, as each stands for the others."""
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return " " + " ".join(_WORD.findall(low.translate(_TABLE))) + " "


@dataclass
class Lexicon:
    """Weights by folded beginning of a word (with the space before it), and the curve from density to score."""

    weights: dict[str, float]
    slope: float
    middle: float
    exceptions: tuple[str, ...] = ()
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                entry = fold(phrase).rstrip()
                made.add_word(entry, (len(entry), None))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def density(self, text: str) -> float:
        """Weight found, by word; entries within an exception phrase don't count."""
        folded = fold(text)
        if not len(self.automaton):
            return 0.0
        hits = list(self.automaton.iter(folded))
        spared = [(end - n, end) for end, (n, w) in hits if w is None]
        total = sum(w for end, (n, w) in hits if w is not None and not any(a <= end - n and end <= b for a, b in spared))
        return total / (folded.count(" ") + SMOOTH)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * (_scale(density) - self.middle)))))


def _scale(density: float) -> float:
    return math.log1p(1000 * max(0.0, density))


def held_out(id_col: str):
    """Whether crc32 of the id's decimal text is divisible by five; labels of such rows are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def _parts(word: str) -> list[str]:
    """The beginnings of a word that are features; of a short or long one also the whole word, with the space after it."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + " "] * (not SHORTEST <= len(word) <= LONGEST)


def _features(text: str) -> set[str]:
    """The features of a text, and once more with OFTEN behind them those that it has often."""
    words = fold(text).split()
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for f in _parts(word):
            counts[f] += n
    return set(counts) | {f + OFTEN for f, n in counts.items() if n > 1 and n * RATE >= len(words) + SMOOTH}


_MIX = np.random.default_rng(20240503).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(text: str) -> list[int]:
    """For each band a hash of the two smallest hashes, by two orders, of the text's pairs of words."""
    words = fold(text).split()
    pairs = [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)] or [zlib.crc32(" ".join(words).encode())]
    least = ((np.array(pairs, np.uint64)[:, None] + np.uint64(1)) * _MIX >> np.uint64(24)).min(axis=0).tolist()
    return [zlib.crc32(f"{k} {least[2 * k]} {least[2 * k + 1]}".encode()) << 8 | k for k in range(BANDS)]


def _with_bands(batches):
    for batch in batches:
        bands = [_bands(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands, pa.list_(pa.int64()))], ["_i", "_text", "_toxic", "_bands"])


def _families(rows: list[tuple[int, list[int]]]) -> dict[int, int]:
    """The smallest number of those that shared bands connect, by number."""
    parent = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[int, int] = {}
    for i, bands in rows:
        for band in bands:
            a, b = root(i), root(first.setdefault(band, i))
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def _with_family(rows: DataFrame) -> DataFrame:
    """``rows`` (_i, _text, _toxic) as (_text, _toxic, _family). Bands of the rows, SAMPLE at most, are brought to the driver."""
    banded = stored(rows.mapInArrow(_with_bands, "_i long, _text string, _toxic int, _bands array<long>"), "toxicity-bands")
    shared = rows.sparkSession.sparkContext.broadcast(_families(sorted((r["_i"], r["_bands"]) for r in banded.select("_i", "_bands").collect())))

    def named(batches):
        for batch in batches:
            own = [shared.value[i] for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.int64())], ["_text", "_toxic", "_family"])

    return stored(banded.select("_i", "_text", "_toxic").mapInArrow(named, "_text string, _toxic int, _family long"), "toxicity-sample")


def _having(rows: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(f, families): the features of ``rows`` (_text, _family), and the families that have each. With ``most`` only its
    features, each of which needs no more families than one above its number."""
    shared = rows.sparkSession.sparkContext.broadcast(most)

    def rows_of(having):
        return pa.RecordBatch.from_arrays([pa.array(having, pa.string()), pa.array(map(list, having.values()), pa.list_(pa.int64()))], ["f", "families"])

    def found(batches):
        """Families by feature, HELD features at a time, so that a task's memory doesn't follow its texts."""
        most, having = shared.value, {}
        for batch in batches:
            for text, family in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = _features(text.as_py())
                for f in own if most is None else own & most.keys():
                    families = having.setdefault(f, set())
                    if most is None or len(families) <= most[f]:
                        families.add(family)
                if len(having) > HELD:
                    yield rows_of(having)
                    having = {}
        yield rows_of(having)

    parts = rows.select("_text", "_family").mapInArrow(tidied(found), "f string, families array<long>")
    return parts.groupBy("f").agg(F.array_distinct(F.flatten(F.collect_list("families"))).alias("families"))


def _entries(having: dict[str, set[int]], neg: dict[str, int], least: int, ratio: float) -> list[str]:
    """The features to keep, of those that families of label 1 have (``having``) and how many of label 0 (``neg``; ``ratio`` is how many families of
    label 1 there are for one of label 0). First those that each are in ``least`` families of label 1 without any taken before, so that
    words that only come along with harsh ones are not taken; then those that are in twice as many, hardly ever in label 0, and no beginning
    or continuation of one taken."""
    by_family: dict[int, list[str]] = {}
    for f, families in having.items():
        for d in families:
            by_family.setdefault(d, []).append(f)
    names = sorted(having, key=lambda x: (len(x), x), reverse=True)
    left, chosen = {f: len(having[f]) for f in names}, []
    heap = [(10 * ratio * neg[f] - left[f], i) for i, f in enumerate(names)]
    heapq.heapify(heap)
    while heap:
        key, i = heapq.heappop(heap)
        f = names[i]
        if left[f] < least:
            continue
        if key != 10 * ratio * neg[f] - left[f]:
            heapq.heappush(heap, (10 * ratio * neg[f] - left[f], i))
            continue
        chosen.append(f.rstrip(OFTEN))
        for d in having[f]:
            for g in by_family.pop(d, ()):
                left[g] -= 1
    starts = {f[:k] for f in chosen for k in range(1, len(f) + 1)}
    taken = set(chosen)
    for f in sorted(having, key=lambda x: (-len(having[x]), -len(x), x)):
        own = {f[:k] for k in range(1, len(f) + 1)}
        if len(having[f]) >= 2 * least and neg[f] * 50 <= len(having[f]) and not f.endswith(OFTEN) and f not in starts and not own & taken:
            chosen.append(f)
            taken.add(f)
            starts |= own
    return list(dict.fromkeys(chosen))


def _weights(sample: DataFrame, entries: list[str], n_pos: int, n_neg: int) -> dict[str, float]:
    """The logarithm of the entries' mean share of the words in families of label 1 over that in families of label 0."""
    plain = Lexicon(dict.fromkeys((" " + e for e in entries), 1.0), 1.0, 1.0)

    def shares(batches):
        for batch in batches:
            out = []
            for text, toxic, family in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                folded = fold(text.as_py())
                found = Counter(folded[end - n + 2 : end + 1] for end, (n, _) in plain.automaton.iter(folded))
                out += [(e, toxic, family, n / (folded.count(" ") + SMOOTH)) for e, n in found.items()] or [("", toxic, family, 0.0)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["e", "toxic", "family", "share"])

    by_family = sample.mapInArrow(shares, "e string, toxic int, family long, share double").groupBy("e", "toxic", "family").agg(F.max("share").alias("share"))
    total = {(r["e"], r["toxic"]): r["share"] for r in by_family.groupBy("e", "toxic").agg(F.sum("share").alias("share")).collect()}
    mean = lambda e, k, n: total.get((e, k), 0.0) / n + 1e-5
    return {" " + e: math.log(mean(e, 1, n_pos) / mean(e, 0, n_neg)) for e in entries}


def _exceptions(sample: DataFrame, lexicon: Lexicon, least: int) -> tuple[str, ...]:
    """Phrases of two words, one of which has an entry, that three times ``least`` families of label 0 or more have, and ten times as many as of label 1."""
    entries = tuple(e[1:] for e in lexicon.weights)

    def found(batches):
        for batch in batches:
            phrases: set[tuple] = set()
            for text, toxic, family in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                words = ["", *fold(text.as_py()).split(), ""]
                for k, word in enumerate(words):
                    if word and (word + " ").startswith(entries):
                        phrases |= {(f"{a} {b}", toxic, family) for a, b in ((words[k - 1], word), (word, words[k + 1])) if a and b}
            columns = list(zip(*phrases, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["phrase", "toxic", "family"])

    if not entries:
        return ()
    seen = sample.mapInArrow(found, "phrase string, toxic int, family long").distinct()
    counts = seen.groupBy("phrase").agg(F.count_if(F.col("toxic") == 0).alias("neg"), F.count_if(F.col("toxic") == 1).alias("pos"))
    return tuple(sorted(r["phrase"] for r in counts.where(f"neg >= {3 * least} AND pos * 10 <= neg").select("phrase").collect()))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from the labelled documents that are not held out; phrases of ``exceptions`` count as no harsh words besides those learned.

    Rows without id, text or label are passed over, and with no label 1 or no label 0 among the rest (as with empty tables), the lexicon is empty
    and every score is below one half. An id with several labels has the largest, an id with several texts the smallest of them. Ties are
    broken by the entries' own order, so that the result depends on the rows alone. Texts count whole; other columns are not read.
    """
    labelled = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_toxic")).where("_toxic IS NOT NULL AND _i IS NOT NULL")
    chosen = labelled.where(~held_out("_i")).groupBy("_i").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_i"), "_i").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), texts["_d"] == chosen["_i"]).groupBy("_i").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    sample = _with_family(rows.select(F.col("_i").cast("long").alias("_i"), "_text", "_toxic"))
    n_pos, n_neg = sample.agg(*(F.count_distinct(F.when(F.col("_toxic") == k, F.col("_family"))) for k in (1, 0))).first()
    if not n_pos or not n_neg:
        return Lexicon({}, 1.0, 1.0)
    base = n_pos / (n_pos + n_neg)
    # So many families with label 1 don't come by chance, and a feature is in ten times the share of them or more.
    least = max(3, math.ceil(math.log(1e-4) / math.log(base)), n_pos // 500)
    pos = stored(_having(sample.where("_toxic = 1")).where(F.size("families") >= least), "toxicity-features")
    most = {r["f"]: int(r["n"] * n_neg / (10 * n_pos)) for r in pos.select("f", F.size("families").alias("n")).collect()}
    others = {r["f"]: r["neg"] for r in _having(sample.where("_toxic = 0"), most).select("f", F.size("families").alias("neg")).collect()}
    neg = {f: others.get(f, 0) for f, n in most.items() if others.get(f, 0) <= n}
    having = {r["f"]: set(r["families"]) for r in pos.collect() if r["f"] in neg}
    entries = _entries(having, neg, least, n_pos / n_neg)
    if not entries:
        return Lexicon({}, 1.0, 1.0)
    weights = {e: w for e, w in _weights(sample, entries, n_pos, n_neg).items() if w > 0}
    phrases = tuple(exceptions) + _exceptions(sample, Lexicon(weights, 1.0, 1.0), least)
    lexicon = Lexicon(weights, 1.0, 1.0, phrases)

    def binned(batches):
        for batch in batches:
            bins = [int(_scale(lexicon.density(text.as_py())) * 40) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), batch.column(1), batch.column(2)], ["bin", "toxic", "family"])

    bins = sample.mapInArrow(binned, "bin int, toxic int, family long").distinct().groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n_bins = 1 + max(r["bin"] for r in bins)
    pos, neg = [0] * n_bins, [0] * n_bins
    for r in bins:
        (pos if r["toxic"] else neg)[r["bin"]] += r["n"]
    # The curve's middle is between the bins that part the labels with the fewest errors; with several such places, the first run of them. Texts
    # without any entry are below it.
    errors, best = sum(neg), []
    for k in range(n_bins + 1):  # errors when bins from k on are called toxic
        best.append(errors)
        if k < n_bins:
            errors += pos[k] - neg[k]
    first = best.index(min(best[1:]), 1)
    last = first
    while last < n_bins and best[last + 1] == best[first]:
        last += 1
    return Lexicon(weights, 4.0, (first + last) / 2 / 40, phrases)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, predicted of every whole text; null texts count as empty. No shuffle. Rows that repeat an id are
    rows like any other; an empty table gives an empty result. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scored(batches):
        own = shared.value
        for batch in batches:
            scores = [own.score(own.density(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInArrow(scored, "_id long, score double")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that score below one half, with all their columns, whatever their names; null texts count as empty, rows that repeat
    an id are rows like any other, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def clean(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([own.score(own.density(t.as_py() or "")) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(tidied(clean), docs.schema)
