"""Operator 4: token counts by dynamic programming shared along a trie.

The vocabulary is one of scored pieces; a pre-token (a word with the word mark in front) is segmented to the pieces of
largest total score, as a unigram model does: best[j] = max over pieces that end at j of best[i] + score. Distinct
pre-tokens are inserted in a trie, and the forward score of a node is computed once, when the first word that passes it
makes it; all later words with that prefix find it there. A node where a word ends stores the word's token count. Counts
of a text are sums over its words.

Scores: those of a unigram model file are taken as they are. The public files at hand hold merge vocabularies, whose
scores are places of merges and no log probabilities (and tokenizers are not trained here); for these a piece of rank r
scores -log(r + 2), as under Zipf's law, and the counts are those of that unigram model, not of the file's own merges. A
character outside all pieces costs BYTE a byte (byte fallback). Of equal scores the segmentation of fewer tokens counts.

Memory is bounded whatever the words: at NODES nodes a worker starts a new trie, at REMEMBERED characters of words it
forgets their counts, and words of more than LONG characters, which share no prefix worth keeping, run through a window of
as many scores as the longest piece has letters. Rows are independent: repeated rows repeat their result, null or empty texts
count 0, very long texts are counted whole, an empty table gives an empty table. Columns other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

MARK = "▁"
#: Score of one fallback byte.
BYTE = -14.0
#: Nodes of a worker's trie, and characters of its words (with 60 more a word).
NODES, REMEMBERED = 200_000, 28_000_000
LONG = 200


def read_pieces(path: str | None = None) -> dict[str, float]:
    """Score of each piece but special ones. Read on the driver and sent along (32,000 pieces)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in usual}
    if all(x == round(x) for x in pieces.values()):  # places of merges
        return zipf_scores(list(pieces))
    return pieces


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Scores of pieces in order of rank."""
    return {piece: -math.log(rank + 2) for rank, piece in reversed(list(enumerate(pieces)))}


#: Bits of a letter in the key of a node's child: node << LETTER | letter.
LETTER = 21


class Counter:
    """Counts tokens of words along a trie; keeps counts, and the trie while it is small, between calls.

    Tries are flat: one dictionary from a node and a letter to a child, and lists by node, which a worker's garbage
    collector need not walk.
    """

    def __init__(self, pieces: dict[str, float]):
        self.score = pieces
        # pieces by their letters from the last to the first, so that all that end at a place are met on one way back
        self.ends: dict[int, int] = {}
        self.piece: list[float | None] = [None]
        for piece, score in pieces.items():
            node = 0
            for c in reversed(piece):
                key = node << LETTER | ord(c)
                node = self.ends.get(key, 0)
                if not node:
                    node = self.ends[key] = len(self.piece)
                    self.piece.append(None)
            self.piece[node] = score
        self.longest = max(map(len, pieces), default=1)
        self.known: dict[str, int] = {}
        self.chars = 0
        self._start()

    def _start(self) -> None:
        # children, and by node the score and the tokens of the best segmentation of its prefix
        self.child: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]

    @property
    def nodes(self) -> int:
        return len(self.best)

    def forward(self, letters: list[int], j: int, path: list[int], scores: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of the first j letters; path[i] is where scores and tokens hold those of the first i."""
        i = j - 1
        c = letters[i]
        raw = 1 if c < 0x80 else len(chr(c).encode("utf-8", "replace"))
        top, few = scores[path[i]] + BYTE * raw, tokens[path[i]] + raw
        ends, piece, node = self.ends, self.piece, 0
        while node := ends.get(node << LETTER | letters[i], 0):
            p = piece[node]
            if p is not None:
                at = path[i]
                made = scores[at] + p
                if made > top or made == top and tokens[at] + 1 < few:
                    top, few = made, tokens[at] + 1
            if not i:
                break
            i -= 1
        return top, few

    def insert(self, word: str) -> int:
        """Token count of a word; nodes that earlier words made are passed, others are made."""
        letters = list(map(ord, MARK + word))
        if len(letters) > LONG:
            return self.windowed(letters)
        child, best, tokens = self.child, self.best, self.tokens
        node, path = 0, [0]
        for j, c in enumerate(letters, 1):
            key = node << LETTER | c
            node = child.get(key, 0)
            if not node:
                score, n = self.forward(letters, j, path, best, tokens)
                node = child[key] = len(best)
                best.append(score)
                tokens.append(n)
            path.append(node)
        return tokens[node]

    def windowed(self, letters: list[int]) -> int:
        """The same for a long word, of which no node is kept: only the last scores, as far back as a piece reaches."""
        wide, n = self.longest + 1, len(letters)
        scores, tokens, path = [0.0] * wide, [0] * wide, [i % wide for i in range(n + 1)]
        for j in range(1, n + 1):
            scores[j % wide], tokens[j % wide] = self.forward(letters, j, path, scores, tokens)
        return tokens[n % wide]

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and words of each text."""
        cut = [t.split() for t in texts]
        if self.chars > REMEMBERED:
            self.known, self.chars = {}, 0
        if self.nodes > NODES:
            self._start()
        known = self.known
        new = {w for words in cut for w in words} - known.keys()
        for w in new:
            known[w] = self.insert(w)
        self.chars += sum(map(len, new)) + 60 * len(new)
        return [sum([known[w] for w in words]) for words in cut], [len(words) for words in cut]


@lru_cache(maxsize=2)
def counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(dict(pieces))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_words of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(read_pieces(path).items()))

    def score(texts: list[str]) -> dict[str, pa.Array]:
        tokens, words = counter(sent.value).count(texts)
        return {"n_tokens": pa.array(tokens, pa.int64()), "n_words": pa.array(words, pa.int64())}

    return map_texts(docs, score, "n_tokens bigint, n_words bigint")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
