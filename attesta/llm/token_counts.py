"""Unigram token counts by dynamic programming over a trie of the distinct pre-tokens.

Distinct pre-tokens of a batch are visited in sorted order, which walks their trie depth first: the path to the current
node is all that is kept, a forward score is computed once for each prefix that several pre-tokens share, and the count
at a pre-token's last node is stored and kept for later batches of the worker. No shuffle: each batch has its own trie.
Tokenizers aren't trained here, so a piece's score follows from its rank in the public vocabulary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, freed, ship

VOCABULARY = "piece_bpe_32k.model"
#: Zipf-Mandelbrot shift: the score of the piece of rank r is -log((r + SHIFT) * H), with H the sum of 1 / (r + SHIFT).
SHIFT = 2.7
#: Score of each UTF-8 byte of a character that no piece covers.
BYTE_SCORE = -25.0
#: Pre-tokens whose counts a Python worker keeps; then it starts anew.
KEPT = 400_000
MARK = "▁"
#: Counts are summed in one integer: tokens below, tokens of bytes from this bit on.
BYTES_FROM = 40


class Unigram:
    """Best-scoring segmentation; scores: of each piece. The longest pieces win ties."""

    def __init__(self, scores: dict[str, float], byte_score: float = BYTE_SCORE):
        self.scores, self.byte_score = scores, byte_score
        self.suffixes = {p[i:] for p in scores for i in range(len(p))}
        self.counts: dict[str, int] = {}

    def node(self, path: list[tuple[float, int]], token: str, end: int) -> tuple[float, int]:
        """(forward score, count) of token[:end] from those of its shorter prefixes."""
        best, count = -math.inf, 0
        begin = end
        while begin:
            begin -= 1
            piece = token[begin:end]
            if piece not in self.suffixes:
                break
            score = self.scores.get(piece)
            if score is not None and (total := path[begin][0] + score) >= best:
                best, count = total, path[begin][1] + 1
        if best == -math.inf:
            n = len(token[end - 1].encode("utf-8", "surrogatepass"))
            best, count = path[end - 1][0] + n * self.byte_score, path[end - 1][1] + n + (n << BYTES_FROM)
        return best, count

    def count(self, words: Iterable[str]) -> None:
        """Stores the count of each word that has none yet."""
        if len(self.counts) > KEPT:
            self.counts.clear()
        path, before = [(0.0, 0)], ""
        for word in sorted(w for w in set(words) if w not in self.counts):
            token = MARK + word
            shared, most = 0, min(len(before), len(token))
            while shared < most and before[shared] == token[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                path.append(self.node(path, token, end))
            self.counts[word] = path[-1][1]
            before = token


def vocabulary_scores(name: str, shift: float = SHIFT) -> dict[str, float]:
    """Scores from the order of the pieces of a public vocabulary; pieces for bytes and controls are left out."""
    import public_tokenizers as files
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=files.path(name))
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    log_h = math.log(sum(1 / (r + shift) for r in range(len(plain))))
    return {sp.id_to_piece(i): -math.log(r + shift) - log_h for r, i in enumerate(plain)}


_models: dict[str, Unigram] = {}
_WORDS = re.compile(WORD)


def model_of(name: str) -> Unigram:
    if name not in _models:
        _models[name] = Unigram(vocabulary_scores(name))
    return _models[name]


def _counter(vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary)
        for batch in freed(batches):
            out: tuple[list, ...] = ([], [], [])
            # the words of the whole batch first, so that their trie is walked once
            model.count({w for t in batch.column(1) for w in _WORDS.findall(t.as_py() or "")})
            for t in batch.column(1):
                words = _WORDS.findall(t.as_py() or "")
                total = sum(map(model.counts.__getitem__, words))
                out[0].append(len(words))
                out[1].append(total & ((1 << BYTES_FROM) - 1))
                out[2].append(total >> BYTES_FROM)
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_pretokens", "n_tokens", "n_byte_tokens"])

    return run


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_byte_tokens), a row for each row of docs.

    Pre-tokens are the words of the whole text (null: none), of any length, each with a mark before it. Empty texts count
    0 and empty tables give no rows; each repeated row is counted, equal texts alike, and ties between segmentations go to
    the longest last piece; a null id stays null. Other columns of docs, of any name, play no role.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_counter(vocabulary), "doc_id long, n_pretokens long, n_tokens long, n_byte_tokens long")


def op4_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))
