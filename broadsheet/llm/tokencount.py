"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of word-initial and continuing pieces. A word runs through it one
character at a time. Where the trie has no edge, the node's failure link leads to the
continuing node that is reached after popping the pieces matched so far, and the number
popped is precomputed; so each character is read once and no piece is ever built.

The lone word mark is a piece, so a word whose first character begins no word-initial piece is the mark and continuing pieces. A character that no
piece begins with counts as its UTF-8 bytes, each a piece, if the vocabulary has byte pieces; else the whole word counts as one unknown
token. Edge cases: a null text is an empty one and has 0 tokens; very long words take time in proportion to their length; words are
`[^\\x20\\x09-\\x0D]+`. Repeated rows are counted alike; an empty table gives no rows; carried columns with an output's name give way.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import _text as X
from .bpe import located

VOCABULARY = "piece_bpe_32k.model"
REMEMBERED = 200_000
MARK = "▁"


class Automaton(dict):
    """As a dict it holds the counts of words seen, at most `REMEMBERED` of them."""

    def __init__(self, initial: set[str], continuing: set[str], by_bytes: bool = False):
        super().__init__()
        self.by_bytes = by_bytes
        # Node 0 begins a word, node 1 continues one.
        self.edges: list[dict[str, int]] = [{}, {}]
        last = [False, False]
        parent: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in sorted(pieces):
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        last.append(False)
                        parent.append((node, c))
                    node = self.edges[node][c]
                last[node] = last[node] or bool(piece)
        self.link = [-1] * len(last)
        self.popped = [0] * len(last)
        # By depth, so that a node's parent is linked before it.
        if "" in initial or by_bytes:
            self.link[0], self.popped[0] = 1, 1 if "" in initial else len(MARK.encode())
        order, at = [0, 1], 0
        while at < len(order):
            order += self.edges[order[at]].values()
            at += 1
        for node in order[2:]:
            up, c = parent[node]
            if last[node]:
                self.link[node], self.popped[node] = 1, 1
                continue
            z, n = self.link[up], self.popped[up]
            while z >= 0 and c not in self.edges[z]:
                n += self.popped[z]
                z = self.link[z]
            if z >= 0:
                self.link[node], self.popped[node] = self.edges[z][c], n
            elif by_bytes:
                self.link[node], self.popped[node] = 1, n + len(c.encode())

    def count(self, word: str) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node, n = 0, 0
        for c in word:
            while c not in edges[node]:
                if node == 1 and self.by_bytes:
                    n += len(c.encode())
                    break
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            else:
                node = edges[node][c]
        while node != 1:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word.decode("utf-8", "replace"))
        if len(word) <= 96 and len(self) < REMEMBERED:
            self[word] = n
        return n


@lru_cache(2)
def automaton(name: str = VOCABULARY) -> Automaton:
    """From a sentencepiece model: pieces with a leading mark begin words, others continue them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=located(name))
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Automaton({p[1:] for p in plain if p[0] == MARK}, {p for p in plain if MARK not in p}, any(map(model.is_byte, range(model.get_piece_size()))))


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of each row with its numbers of words and of tokens."""

    def run(raw, offsets):
        machine, whole, at = automaton(vocabulary), raw.tobytes(), offsets.tolist()
        n_words, n_tokens = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            found = whole[a:b].split()
            n_words.append(len(found))
            n_tokens.append(sum(map(machine.__getitem__, found)))
        return [np.array(n_words, np.int64), np.array(n_tokens, np.int64)]

    return X.map_texts(df, text, [("n_words", "bigint"), ("n_tokens", "bigint")], run, keep)


def word_counts(texts: list[str]) -> Counter:
    return Counter(w for t in texts for w in t.encode().split())
