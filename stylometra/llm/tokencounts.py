"""Unigram token counts: distinct pre-tokens in a trie, forward scores once per shared prefix, counts at terminals."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import SAFE, vocabulary
from .shared import grouped, prepare, table, trimmed

SPACE = "▁"
BYTE_PENALTY = 10.0
#: characters of a pre-token that get nodes; beyond them only the scores within the longest piece's reach are kept
DEEPEST = 4096


def pieces(path: str) -> dict[str, float]:
    """The vocabulary of a sentencepiece file with unigram log probabilities by rank (Zipf); control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(names))))
    return {x: -math.log(k + 1) - total for k, x in enumerate(names)}


class Trie:
    """Nodes of all prefixes seen; node k holds the best score and token count of its prefix.

    A pre-token takes at most DEEPEST nodes. The best segmentation has the highest sum of scores, among equals the fewest tokens. A character that no piece
    covers costs one token per UTF-8 byte. Emptied when full, which changes no result.
    """

    def __init__(self, vocab: dict[str, float], limit: int = 700_000):
        self.vocab, self.limit = vocab, limit
        self.tails = {x[k:] for x in vocab for k in range(len(x))}
        self.reach = max(map(len, vocab), default=1)
        self.byte = min(vocab.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def insert(self, word: str) -> tuple[int, float]:
        if len(self.score) > self.limit:
            self.clear()
        children, score, tokens, vocab, tails = self.children, self.score, self.tokens, self.vocab, self.tails
        path, node = [0], 0
        if len(word) > DEEPEST:
            return self._beyond(word)
        for d, c in enumerate(word, 1):
            step = node * 0x110000 + ord(c)
            child = children.get(step)
            if child is None:
                n = len(c.encode("utf-8", "surrogatepass"))
                best, count = score[node] + n * self.byte, tokens[node] + n
                for begin in range(d - 1, -1, -1):
                    piece = word[begin:d]
                    if piece not in tails:
                        break
                    own = vocab.get(piece)
                    if own is not None:
                        before = path[begin]
                        s = score[before] + own
                        if s > best or (s == best and tokens[before] + 1 < count):
                            best, count = s, tokens[before] + 1
                child = len(score)
                children[step] = child
                score.append(best)
                tokens.append(count)
            path.append(child)
            node = child
        return tokens[node], score[node]


    def _beyond(self, word: str) -> tuple[int, float]:
        """The same for a word too long for the trie: its first part through the trie, the rest with a window of scores."""
        ends = [self.insert(word[:d]) for d in range(DEEPEST - self.reach + 1, DEEPEST + 1)]
        window = deque(((score, tokens) for tokens, score in ends), maxlen=self.reach)
        for d in range(DEEPEST + 1, len(word) + 1):
            n = len(word[d - 1].encode("utf-8", "surrogatepass"))
            best, count = window[-1][0] + n * self.byte, window[-1][1] + n
            for begin in range(d - 1, d - 1 - len(window), -1):
                piece = word[begin:d]
                if piece not in self.tails:
                    break
                own = self.vocab.get(piece)
                if own is not None:
                    score, tokens = window[begin - d]
                    if score + own > best or (score + own == best and tokens + 1 < count):
                        best, count = score + own, tokens + 1
            window.append((best, count))
        return window[-1][1], window[-1][0]


def pretokens(text: str) -> list[str]:
    """Pieces between single blanks, each with the mark of a blank before it."""
    if "  " in text or SPACE in text:
        at = [0, *(m.start() + 1 for m in SAFE.finditer(text)), len(text) + 1]
        return [SPACE + text[a : b - 1].replace(" ", SPACE) for a, b in zip(at, at[1:])]
    return (SPACE + text.replace(" ", "\0" + SPACE)).split("\0") if "\0" not in text else [SPACE + x for x in text.split(" ")]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and log_score of each row.

    No shuffle: every task keeps a trie and the terminals' counts of the pre-tokens it has met, both bounded. Null or
    empty text: 0, 0, 0.0. Repeated rows get equal results; null ids stay null; other columns are ignored.
    """
    prepare(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        trie = Trie(pieces(path))
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for group in grouped([*zip(ids, texts)], [len(t or "") for t in texts], 4_000_000):
                split = [pretokens(t) if t else [] for _, t in group]
                new = set().union(*split) - known.keys()
                if len(known) + len(new) > 700_000:
                    known = {}
                    new = set().union(*split)
                for word in sorted(new):
                    known[word] = trie.insert(word)
                for (i, _), s in zip(group, split):
                    found = [*map(known.__getitem__, s)]
                    n, score = map(sum, zip(*found)) if found else (0, 0.0)
                    out.append((i, len(s), n, float(score)))
                for word in new:
                    if len(word) > 64:
                        del known[word]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "n_pretokens", "n_tokens", "log_score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, n_pretokens long, n_tokens long, log_score double")


def op10_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
