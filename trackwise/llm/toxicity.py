"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

A voter looks at a text and fires or not. Four voters have written lexicons, eight
have lexicons mined from labelled texts (words and beginnings of words that toxic
texts have far more often, dealt so that each lexicon covers all of those texts),
and four look for patterns. What fires in a document is a mask of 16 bits.

The masks of all documents are counted by Spark: 65,536 rows at most, whatever the
size of the table. On these counts a mixture is fitted by expectation and
maximisation, of clean texts and a few kinds of toxic ones: of each class its share,
of each voter how often it fires there (which is its accuracy), and of voters that
don't err independently the correlation, as a tree of dependent pairs for which the
conditional mutual information is largest. Labelled documents that may be learned
from hold their class.

The model's posterior of each sampled document is the label from which a logistic
regression is trained, on logarithmic counts of words, beginnings of words and
patterns; it scores all documents. Lexicons and regression use a sample bounded by
``rows`` and ``chars`` as in ``labelled_sample``; masks come from all documents.

Defined cases: null text is empty; an empty text has a score like any other; a
document with several labels counts with its smallest; null labels are left out;
without labels of both classes the score is the share of label 1, or 0 without any;
rows without a doc_id are scored, never learned from and not held out; repeated rows
score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, labelled_sample, small_batches

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
# Written lexicons: single lower-case words in four languages.
LEXICONS = (
    "idiot idiots moron morons fool fools dumb dumbass stupid imbecile cretin clown loser losers jerk dummy halfwit dimwit dumm dummkopf trottel depp vollidiot blödmann spinner versager débile crétin abruti imbécile stupide bouffon minable estúpido estúpida imbécil tonto tonta payaso perdedor bobo necio",
    "pathetic worthless useless trash garbage scum vermin lowlife filth subhuman degenerate wertlos nutzlos abschaum müll gesindel ungeziefer erbärmlich inutile ordure racaille vermine pitoyable basura escoria inútil patético patética alimaña",
    "disgusting vile repulsive revolting hideous despicable filthy sickening ekelhaft widerlich abscheulich abstoßend dégoûtant répugnant ignoble asqueroso asquerosa repugnante despreciable",
    "bastard bitch bullshit crap asshole arsehole shit shitty arschloch scheiße scheisse hurensohn salaud connard merde putain cabrón mierda puta pendejo hate kill",
)
MINED, PATTERNS = 8, 4
VOTERS = len(LEXICONS) + MINED + PATTERNS
_WRITTEN = {word: 1 << i for i, line in enumerate(LEXICONS) for word in line.split()}
# Expressions begin with a set of characters, which the engine looks for first.
SHOUT, RUN, LONG, ADDRESS = re.compile(r"[A-ZÄÖÜÉÈÀÑ](?<!\w.)[A-ZÄÖÜÉÈÀÑ]{3,}\b"), re.compile(r"[!?][!?]+"), re.compile(r"([^\W\d_])\1\1\1"), re.compile(r"\b(?:you|your|du|dein|tu|ton|eres|tú)\s+(?:are\s+|bist\s+|es\s+)?(?:a\s+|an\s+|ein\s+|une?\s+)?([^\W\d_]+)", re.IGNORECASE)

_LOG1P = np.log1p(np.arange(1000)).tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stems(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return [f"={word}", *(word[:n] for n in STEMS if len(word) >= n)]


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def drawn_out(text: str | None, words: bool) -> bool:
    """Whether a text may have a drawn-out letter; words: whether a lower-case word of it has one, which but for two letters says it."""
    return words or "İ" in (text or "") or "Σ" in (text or "")


def patterns(text: str | None, words: Iterable[str], drawn: bool = True) -> list[int]:
    """How often: shouted words, runs of marks, drawn-out letters (if there may be any), someone addressed with a word of a written lexicon."""
    text = text or ""
    addressed = sum(m[1].lower() in _WRITTEN for m in ADDRESS.finditer(text)) if not _WRITTEN.keys().isdisjoint(words) else 0
    return [len(SHOUT.findall(text)), len(RUN.findall(text)), len(LONG.findall(text)) if drawn else 0, addressed]


@dataclass
class Voters:
    """The mined lexicons, by entry, as bits."""

    mined: dict[str, int]

    def of_word(self, word: str) -> int:
        bits = _WRITTEN.get(word, 0)
        for stem in stems(word):
            bits |= self.mined.get(stem, 0)
        return bits

    def mask(self, text: str | None, seen: dict[str, int]) -> int:
        words, out = set(WORD.findall((text or "").lower())), 0
        for word in words:
            bits = seen.get(word)
            if bits is None:
                if len(seen) > 200_000:
                    seen.clear()
                # a bit behind the voters says that the word has a drawn-out letter
                bits = seen[word] = self.of_word(word) | (LONG.search(word) is not None) << VOTERS
            out |= bits
        out, drawn = out & ((1 << VOTERS) - 1), drawn_out(text, out >> VOTERS > 0)
        for i, n in enumerate(patterns(text, words, drawn)):
            out |= (n > 0) << (len(LEXICONS) + MINED + i)
        return out


def mine(texts: list[str], labels: list[int], share: float, errors: float = 1.5, most: int = 4000) -> Voters:
    """Lexicons of the stems that by themselves make a text rather toxic than not, at that share of toxic texts.

    The logarithm of a stem's likelihood ratio, less ``errors`` standard errors, must outweigh the share's odds.
    """
    has: dict[str, list[int]] = {}
    clean: Counter = Counter()
    distinct = dict(zip(texts, labels, strict=True))
    toxic = sum(distinct.values())
    for at, (text, label) in enumerate(distinct.items()):
        found = {s for w in words_of(text) for s in stems(w)}
        if label:
            for s in found:
                has.setdefault(s, []).append(at)
        else:
            clean.update(found)
    scored = []
    for s, docs in has.items():
        a, b = len(docs), clean[s]
        ratio = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (len(distinct) - toxic + 1))
        sure = ratio - errors * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if sure >= np.log((1 - share) / share):
            scored.append((-sure, s))
    cover: Counter = Counter()
    mined: dict[str, int] = {}
    for _, s in sorted(scored)[:most]:
        voter = min(range(MINED), key=lambda v: (sum(cover[v, d] for d in has[s]), v))
        cover.update((voter, d) for d in has[s])
        mined[s] = 1 << (len(LEXICONS) + voter)
    return Voters(mined)


@dataclass
class LabelModel:
    """Shares of the clean class and of the kinds of toxic texts; chance to fire of each voter by (class, state of the voter it hangs on); that voter or -1."""

    shares: np.ndarray
    chance: np.ndarray
    parent: list[int]
    correlation: np.ndarray

    def joint(self, bits: np.ndarray) -> np.ndarray:
        """Logarithms of the chance of each row of bits with each class (classes x n)."""
        out = np.log(self.shares)[:, None] + np.zeros((len(self.shares), len(bits)))
        for v, up in enumerate(self.parent):
            state = bits[:, up] if up >= 0 else np.zeros(len(bits), np.int64)
            p = self.chance[:, state, v]
            out += np.log(np.where(bits[:, v] == 1, p, 1 - p))
        return out

    def classes(self, bits: np.ndarray) -> np.ndarray:
        """Chance of each class for each row of bits."""
        joint = self.joint(bits)
        out = np.exp(joint - joint.max(0))
        return out / out.sum(0)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """Chance that a row of bits is of a toxic text of any kind."""
        return self.classes(bits)[1:].sum(0)


def as_bits(masks: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    return (masks[:, None] >> np.arange(voters) & 1).astype(np.int64)


def _tables(bits: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By class: how often each voter, and each pair of voters, fires. weight: classes x n."""
    return np.stack([w @ bits for w in weight]), np.stack([(bits * w[:, None]).T @ bits for w in weight])


def _maximised(bits: np.ndarray, weight: np.ndarray, parent: list[int], smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    total = weight.sum(1)
    single, pair = _tables(bits, weight)
    chance = np.zeros((len(weight), 2, len(parent)))
    for v, up in enumerate(parent):
        if up < 0:
            chance[:, :, v] = ((single[:, v] + smooth) / (total + 2 * smooth))[:, None]
        else:
            chance[:, 1, v] = (pair[:, v, up] + smooth) / (single[:, up] + 2 * smooth)
            chance[:, 0, v] = (single[:, v] - pair[:, v, up] + smooth) / (total - single[:, up] + 2 * smooth)
    return (total + smooth) / (total + smooth).sum(), np.clip(chance, 1e-9, 1 - 1e-9)


def _dependence(bits: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of voters, mutual information and correlation inside the classes."""
    voters = bits.shape[1]
    single, pair = _tables(bits, weight)
    total, information, spread, common = weight.sum(1), np.zeros((voters, voters)), np.zeros(voters), np.zeros((voters, voters))
    for c in range(len(weight)):
        n = total[c] + 1e-9
        p, both = single[c] / n, pair[c] / n
        for x in (0, 1):
            for y in (0, 1):
                px, py = (p if x else 1 - p)[:, None], (p if y else 1 - p)[None, :]
                joint = both if x and y else p[:, None] - both if x else p[None, :] - both if y else 1 - p[:, None] - p[None, :] + both
                joint = np.maximum(joint, 1e-12)
                information += total[c] / total.sum() * joint * np.log(joint / np.maximum(px * py, 1e-12))
        common += total[c] * (both - np.outer(p, p))
        spread += total[c] * p * (1 - p)
    return information, common / np.maximum(np.sqrt(np.outer(spread, spread)), 1e-12)


def _tree(information: np.ndarray, least: float) -> list[int]:
    """For each voter the one it hangs on, in a spanning forest of the most dependent pairs."""
    voters = len(information)
    group, near = list(range(voters)), [[] for _ in range(voters)]
    for _, i, j in sorted((-information[i, j], i, j) for i in range(voters) for j in range(i) if information[i, j] >= least):
        if group[i] != group[j]:
            near[i].append(j)
            near[j].append(i)
            group = [group[i] if g == group[j] else g for g in group]
    parent, done = [-1] * voters, set()
    for root in range(voters):
        todo = [] if root in done else [root]
        done.update(todo)
        while todo:
            at = todo.pop()
            for other in near[at]:
                if other not in done:
                    done.add(other)
                    parent[other] = at
                    todo.append(other)
    return parent


def _first_kinds(bits: np.ndarray, times: np.ndarray, kinds: int) -> np.ndarray:
    """Shares of the kinds (kinds x n) to begin with, by distance to masks that are frequent and far from each other."""
    far, seeds = np.full(len(bits), bits.shape[1] + 1), []
    for _ in range(kinds):
        seeds.append(int(np.argmax(times * far)))
        far = np.minimum(far, (bits != bits[seeds[-1]]).sum(1))
    near = np.exp(-1.0 * np.stack([(bits != bits[s]).sum(1) for s in seeds]))
    return near / near.sum(0)


def fit_label_model(masks: np.ndarray, times: np.ndarray, known: np.ndarray, voters: int = VOTERS, kinds: int = 4, rounds: int = 25, least: float = 1e-3) -> LabelModel:
    """Mixture of clean texts and ``kinds`` of toxic ones by expectation and maximisation.

    masks, times: distinct masks and how many documents have each; known: 2 x n, how many of those are labelled 0 and 1.
    Texts in several languages set off different lexicons; as kinds of their own they don't make voters look unreliable.
    """
    bits, free = as_bits(masks, voters), np.maximum(times - known.sum(0), 0).astype(np.float64)
    parent = [-1] * voters
    weight = np.concatenate([known[:1], known[1] * _first_kinds(bits, known[1], kinds)]).astype(np.float64)
    model = LabelModel(*_maximised(bits, weight, parent), parent, np.eye(voters))
    for turn in range(2 * rounds):
        shares = model.classes(bits)
        weight = free * shares
        weight[0] += known[0]
        weight[1:] += known[1] * shares[1:] / np.maximum(shares[1:].sum(0), 1e-300)
        if turn >= rounds:  # from here on with dependent voters
            information, correlation = _dependence(bits, weight)
            parent, model.correlation = _tree(information, least), correlation
        model = LabelModel(*_maximised(bits, weight, parent), parent, model.correlation)
    return model


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    pattern: np.ndarray
    bias: float
    voters: Voters
    labels: LabelModel | None

    def score(self, text: str | None, seen: dict[str, tuple[str, ...]]) -> float:
        words, total = words_of(text), self.bias
        counts: Counter = Counter()
        for word, n in words.items():
            known = seen.get(word)
            if known is None:
                if len(seen) > 200_000:
                    seen.clear()
                # no stem is empty: that is for a drawn-out letter
                known = seen[word] = (*(s for s in stems(word) if s in self.weights), *([""] if LONG.search(word) else []))
            for s in known:
                counts[s] += n
        drawn = drawn_out(text, counts.pop("", 0) > 0)
        for s in sorted(counts):
            total += self.weights[s] * (_LOG1P[counts[s]] if counts[s] < len(_LOG1P) else float(np.log1p(counts[s])))
        total += float(self.pattern @ np.log1p(patterns(text, words, drawn))) if self.weights or self.bias else 0.0
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def fit_regression(rows: list[dict[int, float]], y: np.ndarray, weight: np.ndarray, width: int, penalty: float = 1.5e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows, with soft labels y, by Adam over the whole batch."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((k for r in rows for k in r), np.int64, len(at))
    value = np.fromiter((v for r in rows for v in r.values()), np.float64, len(at))
    w, bias, weight = np.zeros(width), 0.0, weight / weight.sum()
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, value * w[feature], len(rows)) + bias, -50, 50)))
        d = (p - y) * weight
        g = np.append(np.bincount(feature, value * d[at], width) + penalty * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit_model(texts: list[str], voters: Voters, labels: LabelModel, share: float, most: int = 20_000, least: float = 2.5) -> ToxicityModel:
    """Regression on the label model's posteriors of texts; share: of toxic documents, to which texts are weighted."""
    seen: dict = {}
    soft = labels.posterior(as_bits(np.array([voters.mask(t, seen) for t in texts], np.int64)))
    counted = []
    for text in texts:
        words, counts = words_of(text), Counter()
        for word, n in words.items():
            for s in stems(word):
                counts[s] += n
        counted.append((counts, patterns(text, words)))
    high, every = Counter(), Counter()
    for (counts, _), y in zip(counted, soft, strict=True):
        every.update(counts.keys())
        if y >= 0.5:
            high.update(counts.keys())
    n, toxic = len(texts), int((soft >= 0.5).sum())
    chosen = []
    for s, c in every.items():
        a, b = high[s], c - high[s]
        z = abs(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (n - toxic + 1))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if z >= least and c > 2:
            chosen.append((-z, s))
    names = [s for _, s in sorted(chosen)[:most]]
    place = {s: i + PATTERNS for i, s in enumerate(names)}
    rows = [{**{i: float(np.log1p(p)) for i, p in enumerate(found) if p}, **{place[s]: float(np.log1p(c)) for s, c in counts.items() if s in place}} for counts, found in counted]
    weight = np.where(soft >= 0.5, share / max(1e-9, toxic / n), (1 - share) / max(1e-9, 1 - toxic / n))
    w, bias = fit_regression(rows, soft, weight, len(names) + PATTERNS)
    return ToxicityModel({s: float(w[i]) for s, i in place.items()}, w[:PATTERNS], bias, voters, labels)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _masked(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            masks = [shipped.value.mask(t, seen) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(masks, pa.int32())], ["doc_id", "mask"])

    return run


def vote(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, mask) of all documents."""
    return _texts(docs).mapInArrow(_masked(docs.sparkSession.sparkContext.broadcast(voters)), "doc_id long, mask int")


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 24_000_000) -> ToxicityModel:
    """Lexicons, label model and regression; labels of rows that are held out are never looked at."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("toxic") > 0).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    sample, (clean, toxic) = labelled_sample(_texts(docs), known, scratch, rows, chars)
    share = toxic / max(1, toxic + clean)
    if len({y for _, y in sample}) < 2:
        odds = np.log(share / (1 - share)) if 0 < share < 1 else 50.0 if share else -50.0
        return ToxicityModel({}, np.zeros(PATTERNS), float(odds), Voters({}), None)
    texts, gold = [t for t, _ in sample], [y for _, y in sample]
    voters = mine(texts, gold, share)
    with small_batches(docs.sparkSession):
        # 65,536 masks at most
        votes = scratch.write(vote(docs, voters).join(known, "doc_id", "left").groupBy("mask").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")), "votes")
    found = votes.orderBy("mask").collect()
    scratch.close()
    column = lambda c: np.array([r[c] for r in found], np.int64)
    model = fit_label_model(column("mask"), column("n"), np.stack([column("clean"), column("toxic")]))
    return fit_model(texts, voters, model, share)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([shipped.value.score(t, seen) for t in batch["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double")
