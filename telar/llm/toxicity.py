"""Toxic documents by a string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm._words import WORD, chunks, hash_spans, spans

#: Length of the subsequences that the kernel compares, and the factor by which each character they span weighs less.
LENGTH, DECAY = 3, np.float32(0.6)
#: Characters of a unit that are compared at once; longer units are read in windows that overlap by half.
WINDOW = 24
#: Landmarks at most. Of each set of toxic documents two pieces at most become landmarks; with more kinds of insults than
#: landmarks, those of fewer documents are only seen as far as they have characters in common with the others.
LANDMARKS = 48
#: Of so many clean units one may score as toxic.
CLEAN = 2000
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_SOLID = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: What may be inserted in a word besides letters.
_MARKS = re.compile(r"[^\w^$]|_")
_SENTENCE = re.compile(r"[.!?]+(?=\s)|\n")


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts' numbers of the units of a buffer of texts.

    A unit is what stands between white space, from its first to its last letter or digit: marks around it go, marks
    within it stay. Three or more single letters in a row, as in words spaced out, are one more unit.
    """
    s, e, first = spans(data, offsets, _SOLID)
    ws, we, _ = spans(data, offsets, WORD)
    a, b = np.searchsorted(ws, s), np.searchsorted(we, e, "right") - 1
    keep = b >= a
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[keep]
    s, e = ws[a[keep]], we[b[keep]]
    # a single letter: one byte, or one lead byte with its continuation
    single = (e - s == 1) | ((e - s == 2) & (data[np.minimum(s, max(0, len(data) - 1))] >= 0xC0)) if len(s) else np.zeros(0, bool)
    if single.any():
        same = np.append(False, single[1:] & single[:-1] & (owner[1:] == owner[:-1]))
        starts = np.flatnonzero(single & ~same)
        stops = np.flatnonzero(single & ~np.append(same[1:], False))
        long = stops - starts >= 2
        s = np.concatenate([s, s[starts[long]]])
        e = np.concatenate([e, e[stops[long]]])
        owner = np.concatenate([owner, owner[starts[long]]])
    return s, e, owner


def _text(raw: bytes) -> str:
    return "^" + "".join(raw.decode("utf-8", "replace").lower().split()) + "$"


class Kernel:
    """Gap-weighted subsequence kernel between strings and landmarks, normalised.

    K(s, t) sums, over all common subsequences of LENGTH characters, DECAY to the power of the characters they span in s
    and in t: an insult with characters inserted or left out keeps most of what it has in common with the plain one.
    The landmarks' weights of all subsequences of their characters are laid out in a table, so a string's kernel with
    all of them, or any combination of them, is one sum over its own subsequences.
    """

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.chars = np.array(sorted({ord(c) for x in landmarks for c in x}), np.uint32)
        self.n = len(self.chars) + 1  # 0 stands for all other characters, and weighs nothing
        self.table = np.zeros((self.n**LENGTH, len(landmarks)), np.float32)
        for m, x in enumerate(landmarks):
            codes = self._number(_codes([x], len(x)))
            own = np.sqrt(_self_kernel(_codes([x], len(x))))[0]
            for at, weight in _triples(codes, self.n):
                self.table[at[0], m] += weight / own

    def _number(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.chars, codes)
        return np.where(self.chars[np.minimum(at, len(self.chars) - 1)] == codes, at + 1, 0)

    def __call__(self, strings: list[str], table: np.ndarray | None = None) -> np.ndarray:
        """[strings, landmarks], or [strings] for a table of a combination of landmarks; strings have at most WINDOW characters."""
        table = self.table if table is None else table
        out = np.zeros((len(strings), *table.shape[1:]), np.float32)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(lengths[order]) > 0)).tolist() if len(order) else []
        for a, b in zip(cut, [*cut[1:], len(order)]):
            for c in range(a, b, 4096):
                at = order[c : min(b, c + 4096)]
                codes = _codes([strings[i] for i in at.tolist()], int(lengths[at[0]]))
                total = np.zeros((len(at), *table.shape[1:]), np.float32)
                for code, weight in _triples(self._number(codes), self.n):
                    total += table[code] * weight
                own = np.sqrt(_self_kernel(codes))
                out[at] = total / (own[:, None] if total.ndim > 1 else own)
        return out


def _triples(codes: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.float32]]:
    """Number and weight of each subsequence of three characters, for all rows at once."""
    w = codes.shape[1]
    for i in range(w - 2):
        for j in range(i + 1, w - 1):
            pair = (codes[:, i] * n + codes[:, j]) * n
            for k in range(j + 1, w):
                yield pair + codes[:, k], DECAY ** (k - i + 1)


def _codes(strings: list[str], width: int) -> np.ndarray:
    return np.array(strings, f"<U{max(1, width)}").view(np.uint32).reshape(len(strings), -1)


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(s, s) of each row."""
    n, w = codes.shape
    ages = np.arange(w)
    fade = np.where(ages[:, None] <= ages, DECAY ** (ages - ages[:, None]), 0).astype(np.float32)
    under = [np.zeros((n, w), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(n, np.float32)
    for p in range(w):
        c = codes[:, p]
        hit = ((codes == c[:, None]) & (c != 0)[:, None]).astype(np.float32) * (DECAY * DECAY)
        news = []
        for i in range(LENGTH):
            before = hit
            if i:
                before = np.zeros_like(hit)
                before[:, 1:] = hit[:, 1:] * under[i - 1][:, :-1]
            if i == LENGTH - 1:
                total += before.sum(1)
            else:
                news.append(before @ fade)
        for u, x in zip(under, news):
            u *= DECAY
            u += x
    return np.maximum(total, 1e-12)


class Model:
    """A linear machine over Nyström features of units, and the rule that makes documents of units."""

    def __init__(self, landmarks: list[str]) -> None:
        self.kernel = Kernel(landmarks)
        values, vectors = np.linalg.eigh(self.kernel([x[:WINDOW] for x in landmarks]).astype(np.float64))
        good = values > 1e-4
        self.map = vectors[:, good] / np.sqrt(values[good])
        self.weights, self.bias = np.zeros(int(good.sum())), -1.0
        self.count, self.share = 1, 0.0

    def judge(self) -> Model:
        """The model without what only training needs: the table of the machine itself stays, a number for each triple of characters."""
        self.kernel.table = self.map = None
        return self

    def features(self, strings: list[str]) -> np.ndarray:
        """Nyström features of strings, with a 1 after each."""
        x = np.ones((len(strings), self.map.shape[1] + 1), np.float32)
        project = self.map.astype(np.float32)
        for a in range(0, len(strings), 20_000):
            x[a : a + 20_000, :-1] = self.kernel(strings[a : a + 20_000]) @ project
        return x

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], c: float = 1.0) -> None:
        """Squared hinge loss by Newton steps on the rows within the margin; parts: (features, y, weight)."""
        w = np.zeros(parts[0][0].shape[1])
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            gram, right = ridge.copy(), np.zeros(len(w))
            for x, y, weight in parts:
                rows = np.flatnonzero((y * (x @ w.astype(np.float32)) < 1) & (weight > 0))
                for a in range(0, len(rows), 20_000):
                    part = rows[a : a + 20_000]
                    xa = x[part].astype(np.float64)
                    heavy = xa.T * (c * weight[part])
                    gram += heavy @ xa
                    right += heavy @ y[part]
            new = np.linalg.solve(gram, right)
            if np.allclose(new, w, atol=1e-5):
                break
            w = new
        self.weights, self.bias = w[:-1], w[-1]
        # the weights of the landmarks, folded into one table: the same sums in another order
        self.table = (self.kernel.table @ (self.map @ self.weights)).astype(np.float32)

    def windows(self, raw: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Windows of the units and of their letters alone, and the unit of each."""
        windows, owner = [], []
        for i, r in enumerate(raw):
            t = _text(r)
            texts = [t]
            if _MARKS.search(t):
                texts.append("^" + _MARKS.sub("", t) + "$")
            for x in texts:
                w = _windows(x)
                windows += w
                owner += [i] * len(w)
        return windows, np.array(owner, np.int64)

    def scores(self, raw: list[bytes]) -> np.ndarray:
        """The largest score of each unit's windows."""
        out = np.full(len(raw), -np.inf)
        for a in range(0, len(raw), 50_000):
            windows, owner = self.windows(raw[a : a + 50_000])
            np.maximum.at(out, owner + a, self.kernel(windows, self.table) + self.bias)
        return out


def _windows(text: str) -> list[str]:
    return [text[a : a + WINDOW] for a in range(0, max(1, len(text) - WINDOW // 2), WINDOW // 2)]


def _landmarks(pos: Counter, neg: Counter, n_pos: int, n_neg: int, docs_of: dict[str, int]) -> list[str]:
    """Pieces of units that mark toxic texts best, each adding texts of its own or a variant; docs_of has a bit for each toxic text."""
    def gain(g: str) -> float:
        p, q = pos[g] / n_pos, neg[g] / max(1, n_neg)
        return (p - q) / np.sqrt(p + q + 1 / n_pos)

    share = n_pos / (n_pos + n_neg)

    def surprise(g: str) -> float:
        a, b = pos[g], neg[g]
        return 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0))

    tried = [g for g, k in pos.items() if k >= 2 and k / n_pos > 4 * neg[g] / max(1, n_neg)]
    # among so many pieces, some mark toxic texts by chance
    least = 2 * np.log(max(2, len(tried))) + 3
    ranked = sorted((g for g in tried if surprise(g) >= least), key=lambda g: (-gain(g), -len(g), g))
    chosen: list[str] = []
    covered: list[int] = []
    for g in ranked:
        d = docs_of[g]
        if sum((d & c).bit_count() > 0.8 * (d | c).bit_count() for c in covered) < 2:
            chosen.append(g)
            covered.append(d)
        if len(chosen) == LANDMARKS:
            break
    return chosen


def train(texts: list[str], labels: list[int]) -> Model | None:
    """A model from labelled texts; None where a class is missing or nothing marks toxic texts beyond chance.

    Sentences inherit their text's label. Most sentences of a toxic text are harmless, so each is a bag of units: those of
    clean sentences are negative, and of a toxic text's sentences the units that score as toxic are positive, first by the
    pieces that mark toxic texts, then twice by the machine itself. Units don't reach across sentences; beyond that the
    sentences of a text count together.
    """
    sentences = [(i, x) for i, t in enumerate(texts) for x in _SENTENCE.split(t) if x]
    shared: dict[bytes, bytes] = {}
    occurrences: list[Counter] = [Counter() for _ in texts]
    column = pa.array([x for _, x in sentences], pa.string())
    for a, _, data, offsets in chunks(column):
        s, e, owner = units(data, offsets)
        for i, j, o in zip(s.tolist(), e.tolist(), owner.tolist()):
            t = sentences[a + o][0]
            u = _text(data[i:j].tobytes())[1:-1].encode()
            occurrences[t][shared.setdefault(u, u)] += 1
    del sentences, column, shared
    n_pos = sum(labels)
    n_neg = len(labels) - n_pos
    if not n_pos or not n_neg:
        return None
    in_pos, in_neg = Counter(), Counter()
    for t, us in enumerate(occurrences):
        (in_pos if labels[t] else in_neg).update(us.keys())

    def pieces(us: Counter) -> set[str]:
        out = set()
        for x in map(_text, us):
            for n in (4, 5, 6, 7, 8):
                out.update(x[i : i + n] for i in range(len(x) - n + 1))
        return out

    pos = Counter()
    for t in np.flatnonzero(labels).tolist():
        pos.update(pieces(occurrences[t]))
    pos = Counter({g: k for g, k in pos.items() if k > 1})
    neg, docs_of, bit = Counter(), dict.fromkeys(pos, 0), 1
    for t, us in enumerate(occurrences):
        known = pieces(us) & docs_of.keys()
        if labels[t]:
            for g in known:
                docs_of[g] |= bit
            bit <<= 1
        else:
            neg.update(known)
    chosen = _landmarks(pos, neg, n_pos, n_neg, docs_of)
    del pos, neg, docs_of
    if not chosen:
        return None
    model = Model(chosen)
    every = sorted({*in_pos, *in_neg})
    number = {u: i for i, u in enumerate(every)}
    held = [(np.fromiter((number[u] for u in o), np.int32, len(o)), np.fromiter(o.values(), np.int32, len(o))) for o in occurrences]
    del occurrences, number
    odds = np.array([in_pos[u] / n_pos - 2 * in_neg[u] / n_neg for u in every])
    marked = np.array([any(g in x for g in chosen) for x in map(_text, every)])
    seen_pos, seen_neg = np.array([in_pos[u] for u in every], float), np.array([in_neg[u] for u in every], float)
    usable = (odds > 0) & (seen_pos > 0)
    positive = marked & usable
    windows, owner = model.windows(every)
    x = model.features(windows)
    del windows

    def scored() -> np.ndarray:
        score = np.full(len(every), -np.inf)
        np.maximum.at(score, owner, x[:, :-1] @ model.weights + model.bias)
        return score

    for turn in range(3):
        if turn:
            score = scored()
            positive = (score > 0) & usable
        negative = ~positive & (seen_neg > 0)
        if not positive.any() or not negative.any():
            return None
        heavy = 0.1 * seen_neg[negative].sum() / seen_pos[positive].sum()
        weight = np.where(positive, heavy * seen_pos, np.where(negative, seen_neg, 0))
        # insults written with inserted, doubled or lost characters, a variant or two of each
        bent, of = _bend([every[i] for i in np.flatnonzero(positive)])
        of = np.flatnonzero(positive)[of]
        model.fit([(x, np.where(positive, 1.0, -1.0)[owner], weight[owner]), (model.features(bent), np.ones(len(of)), weight[of] / 20)])
        # at most one clean unit in CLEAN may score as toxic
        score = scored()
        ranks = np.argsort(-score[negative], kind="stable")
        above = np.cumsum(seen_neg[negative][ranks]) > seen_neg[negative].sum() / CLEAN
        model.bias -= max(0.0, float(score[negative][ranks][np.argmax(above)]) + 1e-6)
    del x
    score = model.scores(every)
    # how many toxic units, and what share of units, make a text toxic: the pair with the fewest weighted errors
    toxic = np.array([int(n[score[u] > 0].sum()) for u, n in held])
    share = toxic / np.maximum(1, [int(n.sum()) for _, n in held])
    label = np.array(labels) > 0
    best = None
    for count in (1, 2, 3):
        for least in (0.0, 0.002, 0.004, 0.006, 0.008, 0.01, 0.012, 0.015):
            said = (toxic >= count) & (share >= least)
            lost = (label & ~said).sum() + 2 * (~label & said).sum()
            if best is None or lost < best[0]:
                best = (lost, count, least)
    _, model.count, model.share = best
    return model


def _bend(raw: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Variants of units, the same in every run: a letter inserted, one doubled, one replaced by a mark, one lost."""
    out, of = [], []
    rng = np.random.default_rng(7)
    for i, r in enumerate(raw):
        t = _text(r)
        if len(t) < 6:
            continue
        a, b, c, d = rng.integers(2, len(t) - 2, 4).tolist()
        letter = "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
        for x in (t[:a] + letter + t[a:], t[:b] + t[b - 1] + t[b:], t[:c] + "*" + t[c + 1 :], t[:d] + t[d + 1 :]):
            w = _windows(x)
            out += w
            of += [i] * len(w)
    return out, np.array(of, np.int64)


#: Of the last model a worker process met: the model, and the verdicts on units so far.
_models: dict[str, Model | None] = {}
_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _group(column: pa.Array, size: int) -> Iterator[list]:
    held, n = [], 0
    for a, _, data, offsets in chunks(column):
        held.append((a, _LOWER[data], offsets))
        n += len(data)
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _fit(docs: DataFrame, labels: DataFrame, sample: int) -> bytes:
    """The model, fitted in one task of an executor and packed: some hundred KB."""
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows, so that they may be sent to all; a text for each, so that no more than these are learned from
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in zip(*[c.to_pylist() for c in b.columns]))
        model = train([x[1] for x in rows], [int(x[2] > 0) for x in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model and model.judge())], pa.binary())], names=["model"])

    # a plan found to have no rows runs no task
    row = texts.coalesce(1).mapInArrow(learn, "model binary").first()
    return bytes(row[0]) if row else pickle.dumps(None)


def _judge(model: Model | None, name: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of units and of toxic units of each text, and whether it is toxic."""
    n, toxic = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if model is None:
        return n, toxic, toxic > 0
    if name not in _known:
        _known.clear()
        _known[name] = (np.zeros(0, np.uint64), np.zeros(0, bool))
    for group in _group(texts, 4 << 20):
        hashes, owners, places = [], [], []
        for g, (a, data, offsets) in enumerate(group):
            s, e, owner = units(data, offsets)
            hashes.append(hash_spans(data, s, e))
            owners.append(owner + a)
            places.append(np.column_stack([np.full(len(s), g), s, e]))
        h, owner, place = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        mine, number = h[order][new], np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        known, verdict = _known[name]
        at = np.searchsorted(known, mine)
        have = known[np.minimum(at, len(known) - 1)] == mine if len(known) else np.zeros(len(mine), bool)
        bad = np.zeros(len(mine), bool)
        bad[have] = verdict[at[have]]
        miss = np.flatnonzero(~have)
        if len(miss):
            raw = [group[g][1][i:j].tobytes() for g, i, j in place[order[np.flatnonzero(new)[miss]]].tolist()]
            bad[miss] = model.scores(raw) > 0
            if len(known) > 1_500_000:
                known, verdict = mine, bad
            else:
                at = np.searchsorted(known, mine[miss])
                known, verdict = np.insert(known, at, mine[miss]), np.insert(verdict, at, bad[miss])
            _known[name] = (known, verdict)
        n += np.bincount(owner, minlength=len(n))
        toxic += np.bincount(owner[bad[number]], minlength=len(n))
    return n, toxic, (toxic >= model.count) & (toxic >= model.share * n) & (toxic > 0)


def _loaded(packed: bytes, name: str) -> Model | None:
    if name not in _models:
        _models.clear()
        _models[name] = pickle.loads(packed)
    return _models[name]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """docs' (doc_id, n_units, n_toxic, toxic) for every row: how many units, how many of them score as toxic, verdict 0 or 1.

    The machine is fitted in one task to the texts of at most `sample` labelled documents (doc_id, toxic), those with
    the smallest hashed doc_id; everything else reads all texts whole. Each distinct unit of some megabytes of text is
    scored once, and a document is toxic where the number and the share of its toxic units reach what was learned.
    At most LANDMARKS pieces of units are landmarks.

    Null and empty texts have no unit and are not toxic. Texts of any length are read whole, and so are units: long ones
    in windows. Rows with the same doc_id are judged one by one; the first of their texts in order is learned from. Without
    labels of both classes nothing is toxic. Labels that are null or belong to no document are not used; a doc_id labelled
    twice is toxic if one label says so. An empty table gives an empty result. Other columns are left out.
    """
    packed, name = _fit(docs, labels, sample), uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, toxic, said = _judge(_loaded(packed, name), name, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(toxic), pa.array(said.astype(np.int32))], names=["doc_id", "n_units", "n_toxic", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, n_units long, n_toxic long, toxic int")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """The rows of docs, all their columns, that toxicity does not find toxic; one pass, no shuffle of texts."""
    packed, name = _fit(docs, labels, sample), uuid.uuid4().hex

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~_judge(_loaded(packed, name), name, b.column(at))[2]))

    # by number, as names may have dots
    at, plain = [c.lower() for c in docs.columns].index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
