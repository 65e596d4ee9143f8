"""Encoding and decoding with the pieces of a SentencePiece model.

The best segmentation is the one with the greatest sum of log-probabilities. A unigram model has
them as its scores. Those of a byte-pair model are ranks of merges, which cannot be added up:
there the pieces' probabilities fall as one over their rank.

An Aho-Corasick automaton over all pieces reads a text once. At each position it reports the
pieces that end there, the longest first and then along its output links, and each relaxes
the best score of that position: a Viterbi search without a second look at the text.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.llm.common import mapped, whole_texts

SPACE = "▁"
UNKNOWN = 10.0  # below the worst piece, the score of a character that no piece holds
CACHED = 200_000  # words whose pieces a Python worker remembers


RANK = 10  # the piece at place r, from 0, weighs 1 / (r + RANK)


def rank_scores(scores: list[float]) -> list[float]:
    """Log-probabilities that fall as one over the places of ``scores``, greatest first.

    They are in single precision, as a model file holds scores.
    """
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    total = math.log(sum(1 / (r + RANK) for r in range(len(scores)))) if scores else 0.0
    out = [0.0] * len(scores)
    for r, i in enumerate(order):
        out[i] = -math.log(r + RANK) - total
    return array("f", out).tolist()


class Pieces:
    """Pieces and scores of a model file, the automaton over them, and the search.

    ``ranks`` says that the file's scores are ranks, as those of byte-pair models are.
    """

    def __init__(self, path: str, ranks: bool = False):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown_id = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        usual, scores = [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append("�".encode() if i == self.unknown_id else b"")
            else:
                self.texts.append(piece.encode())
                usual.append((i, piece))
                scores.append(model.get_score(i))
        if ranks:
            scores = rank_scores(scores)
        for (i, piece), score in zip(usual, scores):
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min(scores, default=0.0) - UNKNOWN
        whole = [t for t in self.texts if len(t) > 1]
        # Words are searched one by one where no piece reaches over a space or a line break.
        self.by_word = not any(SPACE.encode() in t.lstrip(SPACE.encode()) or b"\n" in t for t in whole)
        self.word = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.known: dict[str, tuple[bytes, float, int]] = {}

    def search(self, text: str) -> tuple[list[int], float, int]:
        """Ids of the best segmentation, its score, and the characters that no piece covers.

        Of equal scores the one with the longer last piece wins. A character without a piece
        costs ``lowest`` and becomes its bytes, or the unknown id where bytes are no pieces.
        """
        n = len(text)
        if not n:
            return [], 0.0, 0
        score = [float("-inf")] * (n + 1)
        score[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done, lowest = 0, self.lowest

        def unknown(end: int) -> None:
            value = score[end - 1] + lowest
            if value > score[end]:
                score[end], back[end] = value, (end - 1, -1)

        for last, (i, size, gain) in self.automaton.iter(text):
            end = last + 1
            while done < last:  # positions before this match have all their pieces
                done += 1
                unknown(done)
            value = score[end - size] + gain
            if value > score[end]:
                score[end], back[end] = value, (end - size, i)
        while done < n:
            done += 1
            unknown(done)
        ids, uncovered, end = [], 0, n
        while end:
            start, i = back[end]
            if i >= 0:
                ids.append(i)
            else:
                uncovered += 1
                codes = text[start:end].encode("utf-8", "replace")
                ids.extend([self.byte_ids[c] for c in reversed(codes)] if self.byte_ids else [self.unknown_id])
            end = start
        return ids[::-1], score[n], uncovered

    def encode(self, text: str) -> tuple[bytes, float, int]:
        """Ids as 32-bit bytes, score, and uncovered characters of a text; empty for an empty one."""
        if not text:
            return b"", 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            ids, score, uncovered = self.search(marked)
            return array("i", ids).tobytes(), score, uncovered
        found, known = [], self.known
        for word in self.word.findall(marked):
            one = known.get(word)
            if one is None:
                ids, score, uncovered = self.search(word)
                one = array("i", ids).tobytes(), score, uncovered
                if len(known) < CACHED:
                    known[word] = one
            found.append(one)
        parts, scores, uncovered = zip(*found)
        return b"".join(parts), sum(scores), sum(uncovered)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids; a first space is dropped."""
        numbers = array("i")
        numbers.frombytes(ids)
        text = b"".join(map(self.texts.__getitem__, numbers)).replace(SPACE.encode(), b" ")
        return text[1:] if text[:1] == b" " else text


_models: dict[tuple[str, bool], Pieces] = {}


def _model(path: str, ranks: bool = False) -> Pieces:
    if (path, ranks) not in _models:
        _models[path, ranks] = Pieces(path, ranks)
    return _models[path, ranks]


def encoded(docs: DataFrame, model: str, ranks: bool = False) -> DataFrame:
    """Per document: doc_id, ids (binary, little-endian 32-bit numbers), score and uncovered.

    ``model`` is a file that every executor can open. The best sum of the pieces' scores wins:
    their own, or with ``ranks`` those of ``rank_scores``. Null and empty texts have no ids and score 0. Repeated rows repeat; an empty
    table gives no rows.
    """

    def run(batches):
        pieces = _model(model, ranks)
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                yield doc, *pieces.encode(text.decode("utf-8", "replace"))

    return mapped(whole_texts(docs), run, "doc_id long, ids binary, score double, uncovered int")


def decoded(codes: DataFrame, model: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text of ids, and the columns ``keep`` of ``codes``.

    It is the encoded text again, but that a literal U+2581 reads as a space.
    """

    def run(batches):
        pieces = _model(model)
        for b in batches:
            for doc, ids, *rest in zip(b["doc_id"], b["ids"], *(b[c] for c in keep)):
                yield doc, pieces.decode(ids or b"").decode("utf-8", "replace"), *rest

    kinds = dict(codes.dtypes)
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` {kinds[c]}" for c in keep)])
    return mapped(codes.select("doc_id", "ids", *keep), run, schema)
