"""Problem 6: the language of each record and of each passage, with a confidence.

Hierarchical discrimination: a linear support vector machine tells the family (Germanic or Romance), then machines for each
pair of the family's languages vote, weighted by margin. Features are a word and its character n-grams, so the score of a
passage is the sum of the scores of its words, which each task looks up once per distinct word.

The machines are fitted on a bounded sample of labelled records: ``SAMPLE`` per language, chosen by hash of the id, and
``PASSAGES`` lines of ``LONG`` characters or more of each, chosen by hash of the line, as long as the language has less than
``SAMPLE_CHARS`` characters so far. Labels may be wrong in part: what machines fitted on the other half of the sample
contradict is left out of the fit. The same halves say how sure a margin is (confidence is a logistic function of margin and
number of words, fitted on pieces of held-out passages) and how many of a passage's words a language should know: a passage
whose words are mostly unknown to the language it is nearest to, or that is mostly in another script, is of none of the
languages at hand (``OTHER``). Everything else covers all rows.

Defined results: null and blank texts have no language. A passage is a line that has a word; ``passages`` gives every one.
A line that is too short or has too many marks to be judged by itself is judged together with the rest of its record, of
which it then mostly has the language. A record's languages are those of its lines of prose, or of the whole text where it has none;
foreign sentences do not make a passage foreign: a passage has its language in full only if all but a few of its words stand
in sentences of it. A record of a language that is not at hand has none, and is no case whatever its label. Ties go to the
language first in order of code. Other spellings of a label (region, case, three letters, name) are the same label; a label
that names a language not at hand is a label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt")}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
#: Names and three-letter codes of the languages at hand.
NAMES = {
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "alemão", "duits"),
    "en": ("eng", "english", "englisch", "anglais", "inglés", "inglese", "inglês", "engels"),
    "es": ("spa", "spanish", "spanisch", "espagnol", "español", "espanol", "castellano", "spagnolo", "espanhol", "spaans"),
    "fr": ("fra", "fre", "french", "französisch", "français", "francais", "francés", "francese", "francês", "frans"),
    "it": ("ita", "italian", "italienisch", "italien", "italiano", "italiaans"),
    "nl": ("nld", "dut", "dutch", "niederländisch", "néerlandais", "neerlandés", "olandese", "holandês", "nederlands", "neerlandês"),
    "pt": ("por", "portuguese", "portugiesisch", "portugais", "portugués", "portoghese", "português", "portugues", "portugees"),
}
#: Two-letter codes of languages (ISO 639-1), and other forms of some.
CODES = frozenset(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
ELSEWHERE = {
    "ar": ("ara", "arabic"), "ca": ("cat", "catalan"), "cs": ("ces", "cze", "czech"), "da": ("dan", "danish"), "el": ("ell", "gre", "greek"), "fi": ("fin", "finnish"), "hu": ("hun", "hungarian"), "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "no": ("nor", "norwegian"),
    "pl": ("pol", "polish"), "ro": ("ron", "rum", "romanian"), "ru": ("rus", "russian"), "sv": ("swe", "swedish"), "tr": ("tur", "turkish"), "uk": ("ukr", "ukrainian"), "zh": ("zho", "chi", "chinese"),
}
#: Labelled records per language in the fit, passages taken of each, least length of one, and characters from which on a language takes no more.
SAMPLE, PASSAGES, LONG, SAMPLE_CHARS = 150, 4, 110, 2_000_000
#: Language of a passage that is of none at hand.
OTHER = "und"
#: A passage of so many words is of its language if that knows this share of what it knows of held-out passages (the median). It is
#: low, since texts may have other words than the sample; mostly the common ones are shared.
KNOWN_WORDS, KNOWN = 5, 0.2
#: Words of its record that a line of one word is judged with if it cannot be judged by itself; two less for each further word.
CONTEXT = 8
BITS = 15
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…:;])[”“»\"’]*\s+")
#: A line of less is judged with its record.
LEAST_WORDS, LEAST_CHARS = 11, 55
#: Share of a passage's words in sentences of its language, and margin, from which on it has that language in full.
WHOLE, SURE = 0.8, 0.18
_FOREIGN = re.compile(r"[\u0370-\u1dff\u2c00-\U0010ffff]")


def normal_label(label: Column) -> Column:
    """Two-letter code of a label in any of its forms; null where it names no language."""
    base = F.lower(F.trim(F.regexp_extract(label, r"^\s*([^\s\-_;,(]+)", 1)))
    known = {name: code for table in (NAMES, ELSEWHERE) for code, names in table.items() for name in names} | {code: code for code in CODES}
    return F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), base)


def _features(word: str) -> list[int]:
    """Hashed n-grams of a word in lower case, and the word itself."""
    w = f" {word} "
    grams = {w}
    for n in (2, 3, 4):
        grams.update(w[i : i + n] for i in range(len(w) - n + 1))
    out = []
    for g in grams:
        h = 2166136261
        for b in g.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        out.append((h ^ h >> 15) & ((1 << BITS) - 1))
    return out


def words_of(text: str) -> list[str]:
    """Words in lower case. Capitalised words of ordinary text are left out: most are names, which say nothing."""
    found = _WORDS.findall(text)
    small = [w for w in found if w[0].islower()]
    if len(small) * 4 >= len(found):
        return [w.lower() for w in small]
    return [w.lower() for w in found]


def prose(line: str) -> bool:
    """Whether a line is long and wordy enough to be judged by itself; encoded data without spaces is not."""
    if len(line) < LEAST_CHARS or line.count(" ") * 15 < len(line) or "\t" in line or line.count(" | ") > 1 or line.count("(") + line.count("{") + line.count("=") > len(line) / 40:
        return False
    words = _WORDS.findall(line)
    small = sum(w[0].islower() for w in words)
    return small >= LEAST_WORDS or small * 4 < len(words) >= 2 * LEAST_WORDS


def foreign_script(text: str) -> bool:
    """Whether more than half of the letters are not Latin."""
    return not text.isascii() and bool(_FOREIGN.search(text)) and 2 * len(_FOREIGN.findall(text)) > sum(map(str.isalpha, text))


def fit_machine(rows: list[np.ndarray], signs: np.ndarray, epochs: int = 4, c: float = 1.0) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; rows are index arrays of equal weight, normalised."""
    w, alpha = np.zeros(1 << BITS, np.float64), np.zeros(len(rows))
    order = np.random.default_rng(7)
    unit = [1 / np.sqrt(max(1, len(r))) for r in rows]
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, s = rows[i], signs[i]
            gradient = s * unit[i] * w[r].sum() - 1
            new = min(max(alpha[i] - gradient, 0.0), c)
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * s * unit[i]
                alpha[i] = new
    return w


class Model:
    """Weights of the family machine and of the machines of each pair, side by side; words of each language; sureness of a margin."""

    def __init__(self, passages: list[tuple[str, str]]):
        """passages: (language, text)."""
        words = [words_of(t) for _, t in passages]
        rows = [np.unique(np.array([f for w in ws for f in _features(w)], np.int64)) for ws in words]
        labels = [x for x, _ in passages]
        self.pairs = [("germanic", "romance")] + [p for f in FAMILIES.values() for p in combinations(f, 2)]
        self.sureness, self.cuts = np.array([0.0, 1.0, 0.0, 0.0]), np.zeros(len(LANGUAGES))
        # Each half of the sample is judged by machines fitted on the other: labels of the sample may be wrong.
        even, odd = range(0, len(rows), 2), range(1, len(rows), 2)
        odd = self._agreed(rows, labels, even, odd)
        even = self._agreed(rows, labels, odd, even)
        self._calibrate([words[i] for i in even], [labels[i] for i in even], self._vocabulary([words[i] for i in odd], [labels[i] for i in odd]))
        kept = sorted([*even, *odd])
        self.weights = self._fit([rows[i] for i in kept], [labels[i] for i in kept])
        self.weights /= self._typical([rows[i] for i in kept])  # a typical margin is 1
        self.vocabulary = self._vocabulary([words[i] for i in kept], [labels[i] for i in kept])

    def _agreed(self, rows: list[np.ndarray], labels: list[str], fit: Sequence[int], judged: Sequence[int]) -> list[int]:
        """Those judged whose label machines fitted on the others confirm."""
        self.weights = self._fit([rows[i] for i in fit], [labels[i] for i in fit])
        self.weights /= self._typical([rows[i] for i in fit])
        return [i for i, x in zip(judged, self.decide(self._means([rows[i] for i in judged]))[0]) if LANGUAGES[x] == labels[i]]

    def _means(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(0) / max(1, len(r)) for r in rows]) if rows else np.zeros((0, len(self.pairs)))

    def _typical(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.maximum(np.median(abs(self._means(rows)), 0), 1e-9) if rows else np.ones(len(self.pairs))

    @staticmethod
    def _vocabulary(texts: list[list[str]], labels: list[str]) -> dict[str, int]:
        """Word -> bits of the languages that have it in two passages or more."""
        seen: dict[tuple[str, int], int] = {}
        for ws, label in zip(texts, labels):
            for w in set(ws):
                seen[w, LANGUAGES.index(label)] = seen.get((w, LANGUAGES.index(label)), 0) + 1
        out: dict[str, int] = {}
        for (w, k), n in seen.items():
            if n > 1:
                out[w] = out.get(w, 0) | 1 << k
        return out

    def _calibrate(self, texts: list[list[str]], labels: list[str], known: dict[str, int]) -> None:
        """Held-out passages, whole and in pieces: share of known words, and how often a margin at a number of words is right."""
        shares: dict[int, list[float]] = {}
        rows, right, counts = [], [], []
        for ws, label in zip(texts, labels):
            k = LANGUAGES.index(label)
            if ws:
                shares.setdefault(k, []).append(sum(known.get(w, 0) >> k & 1 for w in ws) / len(ws))
            for n in (1, 2, 4, 8, 16):
                if len(ws) >= n:
                    piece = ws[:n]
                    rows.append(np.array([f for w in piece for f in _features(w)], np.int64))
                    right.append(k)
                    counts.append(n)
        for k, values in shares.items():
            self.cuts[k] = KNOWN * float(np.median(values))
        if not rows:
            return
        best, margin = self.decide(self._means(rows))
        x, y = self._inputs(margin, np.array(counts)), (best == np.array(right)).astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(15):  # logistic regression by Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        self.sureness = w

    @staticmethod
    def _inputs(margin: np.ndarray, words: np.ndarray) -> np.ndarray:
        n = np.log1p(words)
        return np.stack([np.ones(len(margin)), np.minimum(margin, 3), n, np.minimum(margin, 3) * n], 1)

    def confidence(self, margin: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(margin, words) @ self.sureness, -30, 30)))

    def _fit(self, rows: list[np.ndarray], labels: list[str]) -> np.ndarray:
        family = {x: f for f, xs in FAMILIES.items() for x in xs}
        out = np.zeros((1 << BITS, len(self.pairs)))
        for k, (a, b) in enumerate(self.pairs):
            names = [family[x] for x in labels] if k == 0 else labels
            use = [i for i, x in enumerate(names) if x in (a, b)]
            if use:
                out[:, k] = fit_machine([rows[i] for i in use], np.array([1.0 if names[i] == a else -1.0 for i in use]))
        return out

    def decide(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into LANGUAGES, margins) of rows of mean scores of the machines."""
        margins = np.full((len(scores), len(LANGUAGES)), -np.inf)
        for family, sign in (("germanic", 1), ("romance", -1)):
            own = np.flatnonzero(sign * scores[:, 0] >= 0) if sign > 0 else np.flatnonzero(scores[:, 0] < 0)
            margins[np.ix_(own, [LANGUAGES.index(x) for x in FAMILIES[family]])] = np.inf
        for (a, b), s in zip(self.pairs[1:], scores.T[1:]):
            for x, value in ((LANGUAGES.index(a), s), (LANGUAGES.index(b), -s)):
                margins[:, x] = np.where(np.isinf(margins[:, x]) & (margins[:, x] < 0), -np.inf, np.minimum(margins[:, x], value))
        best = margins.argmax(1)
        sure = np.minimum(np.abs(scores[:, 0]), np.maximum(margins[np.arange(len(best)), best], 0))
        return best, sure


class Judge:
    """Looks words up once; judges passages and records."""

    def __init__(self, model: Model):
        self.model, self.known, self.k = model, {}, len(model.pairs)
        self.table = np.zeros((1024, self.k + 2 + len(LANGUAGES)))  # scores, number of features, 1, languages that know the word

    def _add(self, word: str) -> int:
        k = len(self.known)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        f = _features(word)
        bits = self.model.vocabulary.get(word, 0)
        self.known[word] = k
        self.table[k] = [*self.model.weights[f].sum(0), len(f), 1, *(bits >> i & 1 for i in range(len(LANGUAGES)))]
        return k

    def _sums(self, texts: list[str]) -> np.ndarray:
        """A row for each text: sums over its words."""
        if len(self.known) > 280_000:
            self.known.clear()  # between lookups only, so that places stay valid within one
        known, at, ends = self.known, [], [0]
        for text in texts:
            for w in words_of(text):
                k = known.get(w)
                at.append(self._add(w) if k is None else k)
            ends.append(len(at))
        sums = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(self.table[np.array(at, np.int64)], 0)])
        return np.diff(sums[ends], axis=0)

    def _decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.model.decide(sums[:, : self.k] / np.maximum(sums[:, self.k], 1)[:, None])

    def _strange(self, texts: list[str], sums: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text is of none of the languages, and the share of its words that its language knows."""
        words = sums[:, self.k + 1]
        share = sums[np.arange(len(sums)), self.k + 2 + language] / np.maximum(words, 1)
        return (words >= KNOWN_WORDS) & (share < self.model.cuts[language]) | np.array([foreign_script(t) for t in texts], bool), share

    def passages(self, lines: list[str]) -> list[tuple[str, float, bool]]:
        """(language, confidence, whole) of each; whole if all but a few of its words stand in sentences of the language."""
        if not lines:
            return []
        parts, starts = [], []
        for line in lines:
            starts.append(len(parts))
            parts += _SENTENCE.split(line)
        sums = self._sums(parts)
        each, _ = self._decide(sums)
        sizes, totals = sums[:, self.k], np.add.reduceat(sums, starts)
        language, margin = self._decide(totals)
        total = np.maximum(totals[:, self.k], 1)
        owner = np.repeat(np.arange(len(lines)), np.diff([*starts, len(parts)]))
        own = np.add.reduceat(np.where(each == language[owner], sizes, 0), starts)
        strange, share = self._strange(lines, totals, language)
        whole = (own >= WHOLE * total) & (margin >= SURE) & ~strange
        sure = np.where(strange, 1 - share, self.model.confidence(margin, totals[:, self.k + 1]))
        return [(OTHER if o else LANGUAGES[x], float(y), bool(z)) for x, y, z, o in zip(language, sure, whole, strange)]

    def every(self, text: str) -> list[tuple[int, str, float]]:
        """(line_no, language, confidence) of every line with a word; lines that say little by themselves with their record's words."""
        lines = [(no, line) for no, line in enumerate(text.split("\n")) if _WORDS.search(line)]
        if not lines:
            return []
        long = [prose(line) for _, line in lines]
        judged = iter(self.passages([line for (_, line), x in zip(lines, long) if x]))
        short = [line for (_, line), x in zip(lines, long) if not x]
        if short:
            own, record = self._sums(short), self._sums([text])[0]
            weight = np.maximum(0, CONTEXT + 2 - 2 * own[:, self.k + 1]) / max(1.0, record[self.k + 1])
            language, margin = self._decide(own + weight[:, None] * record)
            strange, share = self._strange(short, own, language)
            sure = np.where(strange, 1 - share, self.model.confidence(margin, own[:, self.k + 1]))
            brief = iter([(OTHER if o else LANGUAGES[x], float(y)) for x, y, o in zip(language, sure, strange)])
        return [(no, *(next(judged)[:2] if x else next(brief))) for (no, _), x in zip(lines, long)]

    def record(self, text: str) -> tuple[str | None, float, list[str]]:
        """(main language, confidence, languages of whole passages in order of size); no language where it is none at hand."""
        lines = [x for x in text.split("\n") if prose(x)]
        if not lines:
            sums = self._sums([text])
            if not sums[0, self.k]:
                return None, 0.0, []
            language, margin = self._decide(sums)
            if self._strange([text], sums, language)[0][0]:
                return None, 0.0, []
            name = LANGUAGES[language[0]]
            return name, float(self.model.confidence(margin, sums[:, self.k + 1])[0]), [name]
        size: dict[str, int] = {}
        whole: dict[str, int] = {}
        best = 0.0
        for line, (language, sure, full) in zip(lines, self.passages(lines)):
            if language == OTHER:
                continue
            size[language] = size.get(language, 0) + len(line)
            best += sure * len(line)
            if full:
                whole[language] = whole.get(language, 0) + len(line)
        if 2 * sum(size.values()) < sum(map(len, lines)):
            return None, 0.0, []
        main = max(sorted(size), key=size.get)
        return main, best / sum(size.values()), sorted(whole, key=lambda x: (-whole[x], x)) or [main]


def sample(records: DataFrame, sample_rows: int = SAMPLE, passages: int = PASSAGES) -> list[tuple[str, str]]:
    """(language, passage) of at most sample_rows labelled records per language; bounded in rows and characters, so it may come to the driver."""
    label = normal_label(F.col("label"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= LONG)
    chosen = F.transform(F.slice(F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, passages), lambda s: s["x"])
    rows = records.select("id", label.alias("label"), chosen.alias("lines")).where(F.col("label").isin(*LANGUAGES) & (F.size("lines") > 0))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_rows)
    size = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("label").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).select("label", "lines")
    return sorted((r["label"], x) for r in kept.collect() for x in r["lines"] if prose(x))


def fit(records: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """records: (id, label, text)."""
    return Model(sample(records, sample_rows))


def languages(records: DataFrame, model: Model) -> DataFrame:
    """(id, main, confidence, languages) of (id, text)."""
    shared = records.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights for each machine, whatever the data
    schema = f"id {records.schema['id'].dataType.simpleString()}, main string, confidence double, languages array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for batch in batches:
            out = [(key, *judge.record(text)) for key, text in zip(batch["id"], batch["text"])]
            yield pd.DataFrame(out, columns=["id", "main", "confidence", "languages"])

    return records.select("id", "text").where(F.length(F.trim("text")) > 0).mapInPandas(run, schema)


def passages(records: DataFrame, model: Model) -> DataFrame:
    """(id, line_no, lang, confidence) of every line with a word."""
    shared = records.sparkSession.sparkContext.broadcast(model)
    schema = f"id {records.schema['id'].dataType.simpleString()}, line_no int, lang string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value)
        for batch in batches:
            out = [(key, *x) for key, text in zip(batch["id"], batch["text"]) for x in judge.every(text)]
            yield pd.DataFrame(out, columns=["id", "line_no", "lang", "confidence"])

    return records.select("id", "text").where("text is not null").mapInPandas(run, schema)


def found(records: DataFrame, left_out: DataFrame) -> DataFrame:
    """(scrape_id, lang) of the records with a missing or wrong label or with several languages; left_out: (scrape_id)."""
    rows = records.select(F.col("scrape_id").alias("id"), F.col("metadata.language").alias("label"), "text").where("id is not null")
    judged = languages(rows, fit(rows)).join(rows.select("id", normal_label(F.col("label")).alias("label")), "id")
    case = (F.size("languages") > 1) | F.col("label").isNull() | (F.col("label") != F.col("main"))
    named = F.when(F.size("languages") > 1, F.col("languages")).otherwise(F.array("main"))
    out = judged.where(F.col("main").isNotNull() & case).select(F.col("id").alias("scrape_id"), F.explode(named).alias("lang"))
    return out.join(left_out.select("scrape_id"), "scrape_id", "left_anti").distinct()
