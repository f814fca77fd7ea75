"""Problem 10: the subject areas of each document.

Labelling functions vote on each paragraph: a lexicon of words, a lexicon of word pairs (both learned from the sample),
the section (title or heading) the paragraph stands under, the address (words of the url's path) and the source. A latent
model learns how accurate each function is from how they agree, and gives every paragraph a posterior over subjects; a
document has the subjects of at least a quarter of its paragraphs.

The lexicons are fitted, by one task of an executor, on a bounded sample chosen by hash of the id: ``LABELLED`` documents
for each language and subject, ``UNLABELLED`` for each language, ``MOST`` in all and as long as they hold less than
``SAMPLE_CHARS`` characters. Hand labels may be wrong or lack a subject: they are one more noisy function in the fit, whose
accuracy is learned there. Everything else covers all documents: votes are written once, the subject of a source is that of
most paragraphs of all its documents, and the latent model's prior and its accuracies, one for each function and subject,
come from the counts of all patterns of votes.

Defined results: null and blank texts, and texts without a paragraph that a lexicon knows, have no subject. The title line
(a first line that is a heading or equals the title) is no paragraph. A document may have up to four subjects; ties all
count. Repeated rows give one row for each id and subject; without labels there is no lexicon and no result.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import meet, written

LABELLED, UNLABELLED = 150, 200
#: The whole sample is at most so large, whatever languages the table names and however long texts are; each language and subject has its turn.
MOST, SAMPLE_CHARS = 12_000, 30_000_000
#: A term is of the lexicon if this share of its weight is of one subject, from this many paragraphs on.
PURE, SEEN = 0.6, 3
#: In the first rounds, over hand labels alone, a term need only lean to a subject: else a subject that mostly shares its
#: documents with others would have no lexicon.
LEANING, EARLY = 0.4, 2
QUARTER = 0.25
ROUNDS = 6
#: Trust in a hand label before anything is known, and bounds of what is learned.
LABEL, LEAST_LABEL, MOST_LABEL = 0.8, 0.6, 0.95
#: Paragraphs of a source from which on it votes.
OF_SOURCE = 20
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
FUNCTIONS = ("words", "pairs", "section", "address", "source")


def paragraphs(text: str, title: str | None) -> tuple[list[str], list[str]]:
    """(paragraphs, the heading each stands under). A first line that is a heading or the title is the title line."""
    out, over, heading = [], [], title or ""
    first = True
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        bare = line.lstrip("# ").strip()
        if line.startswith("#") or first and title and bare == title.strip():
            heading = bare
        else:
            out.append(line)
            over.append(heading)
        first = False
    return out, over


def terms(text: str) -> tuple[list[str], list[str]]:
    words = _WORDS.findall(text.lower())
    return words, [f"{a} {b}" for a, b in zip(words, words[1:])]


class Model:
    """Lexicons."""

    def __init__(self, subjects: list[str], docs: list[tuple]):
        """docs: (text, title, url, source, subjects by hand)."""
        self.subjects = sorted(subjects)
        self.place = {s: i for i, s in enumerate(self.subjects)}
        self.words: dict[str, np.ndarray] = {}
        self.pairs: dict[str, dict[str, np.ndarray]] = {}
        self._fit(docs)

    def _fit(self, docs: list[tuple]) -> None:
        k = len(self.subjects)
        given, vocabulary, rows, owner = [], {}, [], []
        for d, (text, title, labels) in enumerate(docs):
            known = np.zeros(k)
            known[[self.place[s] for s in labels if s in self.place]] = 1
            for p in paragraphs(text, title)[0]:
                words, pairs = terms(p)
                rows.append(np.unique(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in (*words, *pairs)), np.int64)))
                given.append(known)
                owner.append(d)
        if not rows or not k or not any(x[2] for x in docs):
            return
        flat, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        starts = np.concatenate([[0], ends[:-1]])
        row = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
        n, given, owner = len(vocabulary), np.array(given), np.array(owner)
        named, trust = given.sum(1, keepdims=True), LABEL
        labelled = named[:, 0] > 0

        def believed() -> np.ndarray:
            """Subjects of each paragraph by its document's hand labels, at the trust they have so far."""
            told = np.where(given > 0, trust / np.maximum(named, 1), (1 - trust) / np.maximum(k - named, 1))
            return np.where(named > 0, told, 1.0 / k)

        hand = believed()
        seen = np.bincount(flat, minlength=n)
        posterior = hand.copy()
        use = labelled.copy()  # the first lexicon comes from hand labels alone
        for turn in range(ROUNDS):
            count = np.stack([np.bincount(flat, weights=(posterior[:, s] * use)[row], minlength=n) for s in range(k)], 1)
            prior = (posterior * use[:, None]).sum(0) + 1
            prior /= prior.sum()
            share = (count + 2 * prior) / (count.sum(1, keepdims=True) + 2)
            lift = np.log(share / prior)
            # At first every term may lean to a subject, so that one that shares its documents with others is not lost.
            keep = (share.max(1) >= (LEANING if turn < EARLY else PURE)) & (seen >= SEEN)
            weight = np.where(keep[:, None], np.clip(lift, -2, 3), 0.0)
            score = np.add.reduceat(weight[flat], starts, axis=0)
            hits = np.add.reduceat(keep[flat].astype(float), starts)
            # A document's paragraphs share few subjects: its mean speaks for each of them, as do hand labels.
            z = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0)) * np.where(hits[:, None] > 0, 1, 1.0 / k)
            z /= z.sum(1, keepdims=True)
            whole = np.stack([np.bincount(owner, weights=z[:, s]) for s in range(k)], 1) + 0.5
            posterior = z * (whole[owner] / whole[owner].sum(1, keepdims=True))
            alone = posterior / posterior.sum(1, keepdims=True)
            if turn >= EARLY and (spoke := labelled & (hits > 1)).any():
                trust = float(np.clip((alone * given)[spoke].sum() / spoke.sum(), LEAST_LABEL, MOST_LABEL))
                hand = believed()
            posterior = posterior * hand
            posterior /= posterior.sum(1, keepdims=True)
            use = labelled | (hits > 1) if turn >= EARLY else labelled
        names = np.array(list(vocabulary), dtype=object)
        for t in np.flatnonzero(keep):
            first, _, second = names[t].partition(" ")
            if second:
                self.pairs.setdefault(first, {})[second] = weight[t].astype(np.float32)
            else:
                self.words[first] = weight[t].astype(np.float32)

    def _best(self, hits: list[np.ndarray]) -> int:
        if not hits:
            return -1
        total = sum(hits)
        best = int(total.argmax())
        return best if total[best] > 0 else -1

    def _single(self, words: list[str]) -> int:
        known = self.words
        return self._best([x for w in words if (x := known.get(w)) is not None])

    def _double(self, words: list[str]) -> int:
        known = self.pairs
        return self._best([x for a, b in zip(words, words[1:]) if (d := known.get(a)) and (x := d.get(b)) is not None])

    def votes(self, text: str, title: str | None, url: str | None) -> np.ndarray:
        """Votes of each function but the source on each paragraph; -1 where it abstains."""
        parts, over = paragraphs(text, title)
        address = self._single(_WORDS.findall((url or "").split("://")[-1].partition("/")[2].lower()))
        headings: dict[str, int] = {}
        out = np.full((len(parts), len(FUNCTIONS) - 1), -1, np.int16)
        for i, (p, h) in enumerate(zip(parts, over)):
            words = _WORDS.findall(p.lower())
            if h not in headings:
                head = _WORDS.findall(h.lower())
                headings[h] = x if (x := self._double(head)) >= 0 else self._single(head)
            out[i] = self._single(words), self._double(words), headings[h], address
        return out


class Latent:
    """The latent model: prior of the subjects, accuracy of each function on each subject, learned from counts of vote patterns."""

    def __init__(self, k: int, votes: np.ndarray, counts: np.ndarray):
        """votes: a row per pattern; counts: paragraphs that have it. Expectation and maximisation; who abstains says nothing."""
        self.k, self.prior, self.accuracy = k, np.full(k, 1.0 / max(1, k)), np.full((len(FUNCTIONS), k), 0.7)
        spoken = (votes >= 0).any(1)
        votes, counts = votes[spoken], counts[spoken].astype(float)
        for _ in range(20 if len(votes) else 0):
            p = self.posterior(votes) * counts[:, None]
            self.prior = (p.sum(0) + 1) / (p.sum() + k)
            for f in range(len(FUNCTIONS)):
                on = np.flatnonzero(votes[:, f] >= 0)
                said = votes[on, f]
                right = np.bincount(said, weights=p[on, said], minlength=k)
                times = np.bincount(said, weights=counts[on], minlength=k)
                self.accuracy[f] = np.clip((right + 7) / (times + 10), 0.05, 0.98)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log(self.prior), (len(votes), 1))
        weight = np.log(self.accuracy * max(1, self.k - 1) / (1 - self.accuracy))
        for f in range(len(FUNCTIONS)):
            on = np.flatnonzero(votes[:, f] >= 0)
            log[on, votes[on, f]] += weight[f, votes[on, f]]
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def document(self, votes: np.ndarray) -> list[tuple[int, float, float]]:
        """(subject, share of the paragraphs, mean posterior) of the subjects of a document."""
        if not self.k:
            return []
        p = self.posterior(votes)
        about = np.where((votes[:, :2] >= 0).any(1), p.argmax(1), -1)
        found = ((s, about == s) for s in np.unique(about[about >= 0]))
        return [(int(s), float(own.mean()), float(p[own, s].mean())) for s, own in found if own.sum() >= QUARTER * len(votes)]


def _table(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.int16).reshape(-1, columns)


def sample(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """(doc_id, text, title, subjects): at most labelled documents per language and subject and unlabelled ones per language, each with its hand labels."""
    chosen = F.xxhash64("doc_id")
    texts = documents.where(F.length("text") > 0).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    hand = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    known = texts.join(hand, "doc_id")
    by_subject = F.row_number().over(Window.partitionBy("lang", "subject").orderBy(chosen, "doc_id"))
    by_language = F.row_number().over(Window.partitionBy("lang").orderBy(chosen, "doc_id"))
    ids = known.withColumn("rank", by_subject).where(F.col("rank") <= labelled).select("doc_id", "rank")
    ids = ids.union(texts.withColumn("rank", by_language).where(F.col("rank") <= unlabelled).select("doc_id", "rank"))
    ids = ids.groupBy("doc_id").agg(F.min("rank").alias("rank")).orderBy("rank", chosen, "doc_id").limit(MOST).select("doc_id")
    hand = hand.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    rows = documents.join(F.broadcast(ids), "doc_id").join(hand, "doc_id", "left")  # at most MOST ids
    size = F.sum(F.length("text").cast("long")).over(Window.orderBy(chosen, "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # over at most MOST rows
    return rows.withColumn("before", F.coalesce(size, F.lit(0))).where(F.col("before") < SAMPLE_CHARS).select("doc_id", "text", "title", "subjects")


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[list[str], bytes]:
    """Names of the subjects and the lexicons, made by one task from the sample; only they come to the driver."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().limit(1001).collect())
    if len(names) > 1000:
        raise ValueError("a table of subjects holds at most 1,000 rows")

    def one(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        docs = [(text, title, [] if labels is None else list(labels)) for text, title, labels in zip(group["text"], group["title"], group["subjects"])]
        return pd.DataFrame({"model": [pickle.dumps(Model(names, docs))]})

    made = sample(documents, labels, labelled, unlabelled).withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(one, "model binary").first()  # the sample is bounded
    return names, bytes(made[0]) if made else pickle.dumps(Model(names, []))


def votes_of(documents: DataFrame, lexicons: bytes) -> DataFrame:
    """(doc_id, source, votes) of every document with a paragraph."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicons)  # lexicons of the bounded sample
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(shared.value)
        for batch in batches:
            out = ((key, source, model.votes(*doc).tobytes()) for key, source, *doc in zip(*(batch[c] for c in ("doc_id", "source", "text", "title", "url"))))
            yield pd.DataFrame([x for x in out if x[2]], columns=["doc_id", "source", "votes"])

    rows = documents.select("doc_id", "source", "text", "title", "url").where(F.length(F.trim("text")) > 0)
    return rows.mapInPandas(run, f"doc_id {id_type}, source string, votes binary")


def source_votes(votes: DataFrame) -> DataFrame:
    """(source, vote, n): the subject of more than half of a source's paragraphs by the lexicons, over all its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for source, data in zip(batch["source"], batch["votes"]):
                v = _table(data, len(FUNCTIONS) - 1)
                own = np.where(v[:, 0] >= 0, v[:, 0], v[:, 1])
                for s, n in zip(*np.unique(own[own >= 0], return_counts=True)):
                    seen[source, int(s)] += int(n)
            yield pd.DataFrame([(source, s, n) for (source, s), n in seen.items()], columns=["source", "vote", "n"])

    counts = votes.where("source is not null").select("source", "votes").mapInPandas(run, "source string, vote int, n long").groupBy("source", "vote").agg(F.sum("n").alias("n"))
    most = counts.groupBy("source").agg(F.max(F.struct("n", (-F.col("vote")).alias("v"))).alias("m"), F.sum("n").alias("n"))
    return most.where((F.col("n") >= OF_SOURCE) & (2 * F.col("m.n") > F.col("n"))).select("source", (-F.col("m.v")).alias("vote"), "n")


def learn(voted: DataFrame, k: int) -> Latent:
    """The latent model of (votes, vote) of all documents; to the driver come the counts of patterns, at most (k + 1)^functions whatever the data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_votes = _joined(batch)
            if len(all_votes):
                patterns, n = np.unique(np.concatenate(all_votes), axis=0, return_counts=True)
                yield pd.DataFrame({"pattern": [x.tobytes() for x in patterns], "n": n})

    rows = voted.select("votes", "vote").mapInPandas(run, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.concatenate([_table(bytes(r["pattern"]), len(FUNCTIONS)) for r in rows]) if rows else np.zeros((0, len(FUNCTIONS)), np.int16)
    return Latent(k, patterns, np.array([r["n"] for r in rows]))


def _joined(batch: pd.DataFrame) -> list[np.ndarray]:
    """Votes of each document with that of its source as last column."""
    out = []
    for data, vote in zip(batch["votes"], batch["vote"]):
        v = _table(data, len(FUNCTIONS) - 1)
        out.append(np.concatenate([v, np.full((len(v), 1), vote, np.int16)], 1))
    return out


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share, confidence)."""
    names, lexicons = fit(documents, labels, subjects)
    votes = written(votes_of(documents, lexicons))
    voted = meet(votes, written(source_votes(votes)), ["source"], "n", "left").select("doc_id", "votes", F.coalesce("vote", F.lit(-1)).alias("vote"))
    latent = learn(voted, len(names))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, names[s], share, sure) for key, v in zip(batch["doc_id"], _joined(batch)) for s, share, sure in latent.document(v)]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "share", "confidence"])

    return voted.mapInPandas(run, f"doc_id {id_type}, subject string, share double, confidence double")


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    return subjects_of(documents, labels, subjects).select("doc_id", "subject").distinct()
