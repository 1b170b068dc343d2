"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands for the blank before a word, as in the vocabulary
MAX_NODES = 1_000_000  # of a trie, some 300 bytes each; a fuller one is dropped and begun anew
NONE = object()  # no piece ends so


def default_vocabulary() -> str:
    """The public vocabulary whose pieces the unigram model takes."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_scores(model_file: str) -> dict[str, float]:
    """Piece -> log-probability by rank (Zipf's law), as the file's own scores are ranks of merges.

    Control, unknown and byte pieces have no score.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {m.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


class ForwardTrie:
    """A trie of pre-tokens; each node holds the best score of its prefix and that path's token count."""

    def __init__(self, scores: dict[str, float]):
        # Every end of a piece, with the score of those that are pieces: a walk back from a node stops where no piece goes on.
        self.ends: dict[str, float | None] = {piece[k:]: None for piece in scores for k in range(len(piece))} | scores
        self.unknown = min(scores.values(), default=0.0) - 10.0  # of a character that no piece covers
        self.reset()

    def reset(self) -> None:
        self.nodes = 1
        self.root: dict = {}
        self.counts: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of ``word`` on its best path. Nodes that earlier words share are walked, not scored again."""
        if self.nodes > MAX_NODES:
            self.reset()
        piece, ends, node = SPACE + word, self.ends, self.root
        best, tokens = [0.0], [0]
        for end in range(1, len(piece) + 1):
            char = piece[end - 1]
            child = node.get(char)
            if child is None:
                top, count = best[end - 1] + self.unknown, tokens[end - 1] + 1
                for start in range(end - 1, -1, -1):
                    score = ends.get(piece[start:end], NONE)
                    if score is NONE:
                        break
                    if score is not None and best[start] + score >= top:
                        top, count = best[start] + score, tokens[start] + 1
                child = node[char] = {"": (top, count)}
                self.nodes += 1
            top, count = child[""]
            best.append(top)
            tokens.append(count)
            node = child
        self.counts[word] = tokens[-1]
        return tokens[-1]


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` (longs), one row per input row.

    Pre-tokens are runs without white space (Unicode), each with a leading blank. Counts are those of the
    best-scoring split under ``unigram_scores``; on equal scores the split whose last piece starts first
    wins. Null and empty texts count zero. Repeated rows stay rows, null ids stay null; other columns are
    not read. Nothing is shuffled: each task scores the distinct pre-tokens of its own rows once, in a trie
    of bounded size, so no vocabulary is gathered anywhere and a lost task repeats only itself.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie = ForwardTrie(unigram_scores(path))
        for batch in batches:
            words_out, tokens_out = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                total = 0
                for word in words:
                    count = trie.counts.get(word)
                    total += trie.insert(word) if count is None else count
                words_out.append(len(words))
                tokens_out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_out, pa.int64()), pa.array(tokens_out, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
