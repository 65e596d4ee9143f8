"""Language-model scores from subword lattices.

A text is a sequence of words and one end. A word is one piece when training has seen it, or
any concatenation of pieces of an existing vocabulary; its probability sums over all of these
segmentations, by a forward recursion in log space. With N training tokens, V distinct words
and a discount d,

    P(word) = (max(count - d, 0) + (d * V + 1) * Q(word)) / (N + 2),    P(end) = (ends + 1) / (N + 2)

where Q, over pieces, sums to 1 over all words: a first piece that begins words, then inside
pieces until one that ends the word. The vocabulary's own scores order its pieces and start
their weights; expected counts over the distinct training words then re-estimate them.

Words differ by language, so each class k of training texts (their ``lang``) has counts of its
own that fall back on P in the same way,

    P_k(token) = (max(count_k - d, 0) + (d * V_k + 1) * P(token)) / (N_k + 1)

and a text's probability also sums over the classes: sum_k share_k * prod P_k(token). Scoring
sees the text alone. Pieces do not reach over words, so the words' sums multiply to the
document's, and a word is worked out once however often it occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped, whole_texts
from tablewright.session import written

DISCOUNT = 0.75
HEAD = 200_000  # most frequent words, of at most HEAD_BYTES, that every task knows
HEAD_BYTES = 64
CLASSES = 8  # the most frequent values of lang, and one class of all others
ROUNDS = 2  # re-estimations of the pieces' weights
TOGETHER = 60_000  # words whose lattices are summed together
FLUSH = 400_000  # distinct words that a task counts before it passes them on
_MARK = "▁"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes, with natural-log weights: ``first`` begin words, ``inside`` follow.

    The empty string among ``first`` is a bare word mark; ``stop`` is the weight of ending.
    """

    first: dict[bytes, float]
    inside: dict[bytes, float]
    stop: float

    @property
    def longest(self) -> int:
        return max(map(len, [*self.first, *self.inside]))


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces of a SentencePiece model; weights fall as one over the rank of their scores.

    Pieces with A-Z are left out, as words come in lower case; all 256 bytes are inside pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or _MARK in piece[1:]:
            continue
        if not any("A" <= c <= "Z" for c in piece):
            found.append((model.get_score(i), piece))
    found.sort(key=lambda x: (-x[0], x[1]))
    first, inside = {b"": 0.01}, {bytes([b]): 1e-4 for b in range(256)}
    for rank, (_, piece) in enumerate(found):
        if piece.startswith(_MARK):
            first[piece[1:].encode()] = max(first.get(piece[1:].encode(), 0), 1 / (rank + 10))
        else:
            inside[piece.encode()] = 1 / (rank + 10)
    return _weighted(first, inside, 0.3 * sum(inside.values()))


def _weighted(first: dict[bytes, float], inside: dict[bytes, float], stop: float) -> Vocabulary:
    a, b = math.log(sum(first.values())), math.log(sum(inside.values()) + stop)
    return Vocabulary(
        {p: math.log(v) - a for p, v in first.items()}, {p: math.log(v) - b for p, v in inside.items()}, math.log(stop) - b)


class Lattice:
    """Forward and backward sums over all segmentations of many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = vocabulary.longest
        self.tables = []
        self.names = []
        self.numbers = []
        for pieces in (vocabulary.first, vocabulary.inside):
            names = [p for p in pieces if p]
            keys = np.array([self._hash(p) for p in names], np.uint64)
            order = np.argsort(keys)
            weights = np.array([pieces[p] for p in names])
            sizes = np.array([len(p) for p in names])
            by_size = {}
            for size in np.unique(sizes):
                own = order[sizes[order] == size]
                by_size[int(size)] = (keys[own], weights[own], own)
            self.tables.append(by_size)
            self.names.append(names)
            self.numbers.append({p: i for i, p in enumerate(names)})

    @staticmethod
    def _hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * int(_MIX) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def _arcs(self, cells: np.ndarray, kind: int, start: int, size: int, hashes: list[np.ndarray]):
        """Weights (-inf without a piece) and piece numbers of cells[:, start:start + size]."""
        table = self.tables[kind].get(size)
        if table is None:
            return None
        keys, weights, own = table
        with np.errstate(over="ignore"):
            wanted = hashes[start + size] - hashes[start] * _MIX ** np.uint64(size)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return np.where(hit, weights[at], -np.inf), own[at], hit

    def _prefixes(self, cells: np.ndarray) -> list[np.ndarray]:
        hashes = [np.zeros(len(cells), np.uint64)]
        with np.errstate(over="ignore"):
            for i in range(cells.shape[1]):
                hashes.append(hashes[-1] * _MIX + cells[:, i].astype(np.uint64) + np.uint64(1))
        return hashes

    def _forward(self, cells: np.ndarray):
        n, length = cells.shape
        hashes, voc = self._prefixes(cells), self.vocabulary
        alpha = [np.full(n, voc.first[b""])]
        arcs = {}
        for end in range(1, length + 1):
            terms = []
            if one := self._arcs(cells, 0, 0, end, hashes):
                arcs[0, 0, end] = one
                terms.append(one[0])
            for start in range(max(0, end - self.longest), end):
                if one := self._arcs(cells, 1, start, end - start, hashes):
                    arcs[1, start, end] = one
                    terms.append(alpha[start] + one[0])
            alpha.append(_log_sum(terms))
        return alpha, arcs

    def log_q(self, words: list[bytes]) -> np.ndarray:
        """log Q of words; long ones, one by one."""
        out = np.empty(len(words))
        for places, cells in _by_length(words):
            if cells is None:
                for i in places:
                    out[i] = self._one(words[i])
            else:
                out[places] = self._forward(cells)[0][-1] + self.vocabulary.stop
        return out

    def _one(self, word: bytes) -> float:
        return self._forward_one(word)[-1] + self.vocabulary.stop

    def _forward_one(self, word: bytes) -> list[float]:
        first, inside, longest = self.vocabulary.first, self.vocabulary.inside, self.longest
        alpha = [first[b""]]
        for end in range(1, len(word) + 1):
            terms = [first[word[:end]]] if end <= longest and word[:end] in first else []
            for start in range(max(0, end - longest), end):
                weight = inside.get(word[start:end])
                if weight is not None:
                    terms.append(alpha[start] + weight)
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return alpha

    def _expected_one(self, word: bytes, uses: list[np.ndarray]) -> None:
        """Add one word's expected uses of pieces; its arcs are looked up again rather than held."""
        first, inside, longest, length = self.vocabulary.first, self.vocabulary.inside, self.longest, len(word)
        alpha, beta = self._forward_one(word), [0.0] * (length + 1)
        for start in range(length - 1, -1, -1):
            arcs = []
            for end in range(start + 1, min(length, start + longest) + 1):
                weight = inside.get(piece := word[start:end])
                if weight is not None:
                    arcs.append((piece, weight + beta[end]))
            top = max(t for _, t in arcs)
            beta[start] = top + math.log(sum(math.exp(t - top) for _, t in arcs))
            for piece, log in arcs:
                uses[1][self.numbers[1][piece]] += math.exp(alpha[start] + log - alpha[-1])
        for end in range(1, min(length, longest) + 1):
            if (piece := word[:end]) in first:
                uses[0][self.numbers[0][piece]] += math.exp(first[piece] + beta[end] - alpha[-1])
        uses[0][-1] += math.exp(first[b""] + beta[0] - alpha[-1])

    def expected(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected uses of first pieces (the bare mark last), of inside pieces, and of stops."""
        uses = [np.zeros(len(self.names[0]) + 1), np.zeros(len(self.names[1]))]
        stops, voc = 0.0, self.vocabulary
        for places, cells in _by_length(words):
            if cells is None:
                for i in places:
                    self._expected_one(words[i], uses)
                stops += len(places)
                continue
            n, length = cells.shape
            alpha, arcs = self._forward(cells)
            whole = alpha[-1]
            beta = [None] * length + [np.zeros(n)]
            for start in range(length - 1, -1, -1):
                terms = [arcs[1, start, end][0] + beta[end] for end in range(start + 1, min(length, start + self.longest) + 1) if (1, start, end) in arcs]
                beta[start] = _log_sum(terms)
            parts: tuple[list, list] = ([], [])
            for (kind, start, end), (weight, own, hit) in arcs.items():
                before = 0.0 if kind == 0 else alpha[start][hit]
                parts[kind].append((own[hit], before + weight[hit] + beta[end][hit] - whole[hit]))
            for kind, found in enumerate(parts):
                if found:
                    places, logs = (np.concatenate(x) for x in zip(*found))
                    uses[kind] += np.bincount(places, np.exp(logs), len(uses[kind]))
            uses[0][-1] += np.exp(voc.first[b""] + beta[0] - whole).sum()
            stops += n
        return uses[0], uses[1], stops


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(terms)
    top = stack.max(0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(stack - top).sum(0))


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of words of one length with their bytes as rows; None for long words."""
    sizes = np.array([len(w) for w in words], np.int64)
    long = np.flatnonzero(sizes > HEAD_BYTES)
    if len(long):
        yield long, None
    for size in np.unique(sizes[sizes <= HEAD_BYTES]):
        places = np.flatnonzero(sizes == size)
        yield places, np.frombuffer(b"".join(words[i] for i in places), np.uint8).reshape(len(places), size)


def text_classes(docs: DataFrame, training: Column) -> list[tuple[str | None, int]]:
    """(lang, training texts): the ``CLASSES - 1`` most frequent values, then None for all others."""
    counts = docs.filter(training).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("texts"))
    top = [tuple(r) for r in counts.filter("lang is not null").orderBy(F.desc("texts"), "lang").limit(CLASSES - 1).collect()]
    every = counts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    return [*top, (None, every - sum(n for _, n in top))]


def _larger(batches: Iterator[dict]) -> Iterator[dict]:
    """Batches of at least ``TOGETHER`` words but for the last, so that equally long words are many."""
    held: dict[str, list] = {}
    for b in batches:
        for name, values in b.items():
            held.setdefault(name, []).extend(values)
        if len(held["word"]) >= TOGETHER:
            yield held
            held = {}
    if held and held["word"]:
        yield held


def word_counts(docs: DataFrame, training: Column, classes: list[str | None]) -> DataFrame:
    """word, n, and n0.. for each class: counts in training texts; 0 for words of others only."""
    number = {name: i for i, name in enumerate(classes[:-1])}

    def run(batches):
        held: dict[int, Counter] = {}
        kept = 0
        for b in batches:
            for text, learn, lang in zip(b["text"], b["learn"], b["lang"]):
                own = held.setdefault(number.get(lang, len(classes) - 1) if learn else -1, Counter())
                kept -= len(own)
                own.update(text.lower().split())
                kept += len(own)
                if kept > FLUSH:
                    yield from rows(held)
                    held, kept = {}, 0
        yield from rows(held)

    def rows(held):
        for kind, own in held.items():
            yield from ((word, kind, n) for word, n in own.items())

    texts = docs.select(F.expr("coalesce(cast(text as binary), X'')").alias("text"), training.alias("learn"), F.col("lang").cast("string").alias("lang"))
    own = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(len(classes))]
    return mapped(texts, run, "word binary, kind int, n long").groupBy("word").agg(
        F.coalesce(F.sum(F.when(F.col("kind") >= 0, F.col("n"))), F.lit(0)).alias("n"), *own)


def estimate(words: DataFrame, start: Vocabulary, rounds: int = ROUNDS) -> Vocabulary:
    """Weights of the pieces from all distinct training words, by ``rounds`` of expected counts.

    Every task returns one vector of the vocabulary's size. Every piece starts with a small
    count, so none gets weight 0.
    """
    current = start
    seen = words.filter("n > 0").select("word")
    for _ in range(rounds):
        lattice = Lattice(current)

        def run(batches, lattice=lattice):
            total = None
            for b in _larger(batches):
                part = np.concatenate([*(x := lattice.expected(b["word"]))[:2], [x[2]]])
                total = part if total is None else total + part
            if total is not None:
                places = np.flatnonzero(total)
                yield from zip(places.tolist(), total[places].tolist())

        sums = mapped(seen, run, "place int, uses double").groupBy("place").agg(F.sum("uses").alias("uses")).collect()
        total = np.zeros(len(lattice.names[0]) + len(lattice.names[1]) + 2)
        for row in sums:
            total[row.place] = row.uses
        split = len(lattice.names[0]) + 1
        total += 1e-3
        first = dict(zip([*lattice.names[0], b""], total[:split].tolist()))
        current = _weighted(first, dict(zip(lattice.names[1], total[split:-1].tolist())), float(total[-1]))
    return current


def lattice_scores(docs: DataFrame, vocabulary: Vocabulary, training: Column, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score.

    ``training``, a condition on doc_id, says from which texts to learn, with their ``lang`` (null
    counts among the others). Words are runs of
    other characters than ``[\\x20\\x09-\\x0D]``, A-Z in lower case; the end counts as a token.
    ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, and
    ``score`` log10 of the text's probability. Null and empty texts are one end. Repeated rows
    count and come back as often as they are there. Without training texts every word comes
    from its pieces alone. An empty table gives no rows.

    The ``HEAD`` most frequent words are known to every task, so no word that is common enough
    to be a hot key is shuffled; all others meet their counts in a join.
    """
    classes = text_classes(docs, training)
    names = [f"n{k}" for k in range(len(classes))]
    words = written(word_counts(docs, training, [c for c, _ in classes]), "word-counts")
    ends = sum(n for _, n in classes)
    seen = [F.count(F.when(F.col(c) > 0, 1)) for c in ("n", *names)]
    tokens, *rest = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", *names)), *seen).first()
    own_tokens, distinct, own_distinct = rest[:len(classes)], rest[len(classes)], rest[len(classes) + 1:]
    n_all, kinds = tokens + ends, distinct + (ends > 0)
    lattice = Lattice(estimate(words, vocabulary, rounds))
    # Of each class: tokens with ends, the weight of falling back, and its share of the texts.
    sizes = np.array(own_tokens, float) + [n for _, n in classes]
    back = DISCOUNT * np.array([v + (n > 0) for v, (_, n) in zip(own_distinct, classes)], float) + 1
    shares = [math.log10((n + 1) / (ends + len(classes))) for _, n in classes]

    def log_p(batch: dict) -> list[tuple]:
        own, counts = batch["word"], np.array(batch["n"], float)
        whole = np.where(counts > DISCOUNT, np.log(np.maximum(counts - DISCOUNT, 1e-300)), -np.inf)
        both = np.logaddexp(whole, lattice.log_q(own) + math.log(DISCOUNT * distinct + 1)) - math.log(n_all + 2)
        return list(zip(own, batch["n"], *(batch[c] for c in names), (both / math.log(10)).tolist()))

    schema = ", ".join(["word binary, n long", *(f"{c} long" for c in names), "log_p double"])
    scored = written(mapped(words, lambda batches: (row for b in _larger(batches) for row in log_p(b)), schema), "word-scores")
    by_class = [
        F.when(F.col(c) > 0, F.log10(F.col(c) - DISCOUNT + F.lit(float(b)) * F.pow(F.lit(10.0), "log_p"))).otherwise(F.col("log_p") + math.log10(b))
        - math.log10(size + 1) for c, b, size in zip(names, back, sizes)
    ]
    base = F.log10((F.col("n") + 0.5) / F.lit(n_all + 0.5 * (kinds + 1)))
    valued = scored.select("word", "n", base.alias("base"), *(p.alias(f"p{k}") for k, p in enumerate(by_class)))
    values = ["base", *(f"p{k}" for k in range(len(classes)))]

    short = valued.filter((F.col("n") > 0) & (F.octet_length("word") <= HEAD_BYTES))
    head = short.orderBy(F.desc("n"), "word").limit(HEAD).select("word", *values).toArrow()
    places = {word: i for i, word in enumerate(head["word"].to_pylist())}
    known = docs.sparkSession.sparkContext.broadcast((places, np.column_stack([head[v].to_numpy() for v in values])))
    end_p = (ends + 1) / (n_all + 2)
    last = np.array([math.log10((ends + 0.5) / (n_all + 0.5 * (kinds + 1))), *(
        math.log10((max(n - DISCOUNT, 0) + b * end_p) / (size + 1)) for (_, n), b, size in zip(classes, back, sizes))])

    def run(batches):
        own, score_of = known.value
        for b in batches:
            for row, doc, learn, text in zip(b["row"], b["doc_id"], b["learn"], b["text"]):
                tokens = text.lower().split()
                at = np.array([own.get(t, -1) for t in tokens], np.int64)
                found = at[at >= 0]
                sums = score_of[found].sum(0) + last if len(found) else last
                rare = Counter(tokens[i] for i in np.flatnonzero(at < 0).tolist())
                yield row, doc, learn, len(tokens) + 1, len(found) + (ends > 0), *sums.tolist(), list(rare), list(rare.values())

    texts = whole_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", training.alias("learn"), "text")
    doubles = ", ".join(f"{v} double" for v in values)
    partial = written(mapped(
        texts, run, f"row long, doc_id long, learn boolean, n_tokens long, n_known long, {doubles}, rare array<binary>, times array<int>",
    ), "partial-scores")
    rare = partial.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    added = rare.join(valued, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more_known"), *(F.sum(F.col("times") * F.col(v)).alias(f"more_{v}") for v in values))
    total = {v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0.0)) for v in values}
    of_class = F.array(*(total[f"p{k}"] + share for k, share in enumerate(shares)))
    done = partial.join(added, "row", "left").select(
        "doc_id", F.col("learn").alias("learned"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), total["base"].alias("base_score"), of_class.alias("of_class"),
    ).withColumn("top", F.array_max("of_class"))
    over = F.aggregate("of_class", F.lit(0.0), lambda acc, p: acc + F.pow(F.lit(10.0), p - F.col("top")))
    return done.withColumn("score", F.col("top") + F.log10(over)).drop("of_class", "top")
