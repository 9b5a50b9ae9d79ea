"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch lie in one flat numpy array of symbols.  In each round every word finds its best pair, all
words merge theirs at once from the left, and the array is compacted, until no word has a pair left.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import parts, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A word: marks of white space, then what follows up to the next mark; no piece goes on behind one.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Encoded words that a task keeps at most, code points of words encoded at once, and of texts that are held at once.
CACHE, CHUNK, HELD = 60_000, 1 << 18, 1 << 19

codecs.register_error("piece-bytes", lambda e: ("�", e.start + 1))


class PieceModel:
    """Tables of a BPE model with byte fallback, and encoding and decoding with them.

    Takes models whose normalizer is the identity with escaped white space and a dummy prefix, as is the one given;
    others are refused.  Symbols are piece ids; code points that are no piece have ids from ``size`` up.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(n)]
        normal = [not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)) for i in range(n)]
        if any(SPACE in s.lstrip(SPACE) for s, ok in zip(names, normal) if ok) or library.normalize("ﬁ 　 a ") != f"{SPACE}ﬁ{SPACE}　{SPACE}a{SPACE}":
            raise ValueError("the model normalizes texts or joins words")
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.ids = {s: i for i, (s, ok) in enumerate(zip(names, normal)) if ok}
        self.byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.output = [s.replace(SPACE, " ").encode() if ok else b"" for s, ok in zip(names, normal)]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.output[i] = bytes([b])
        self.byte_set = frozenset(self.byte_ids.tolist())
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for s, i in self.ids.items():
            if len(s) == 1:
                self.char_ids[ord(s)] = i
        if any(self.char_ids[ord(c)] < 0 for s in self.ids for c in s):
            raise ValueError("a piece has a code point that is no piece")
        self.unknown = library.unk_id()
        self.output[self.unknown] = " ⁇ ".encode()
        # Ranks: equal scores have equal ranks.
        score = np.array([library.get_score(i) for i in range(n)])
        rank = np.unique(-score, return_inverse=True)[1]
        pairs: dict[int, tuple[int, int]] = {}
        for s, i in self.ids.items():
            for at in range(1, len(s)):
                a, b = self.ids.get(s[:at]), self.ids.get(s[at:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (int(rank[i]), i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = keys
        self.pair_rank = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.pair_id = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        self.cache: dict[str, np.ndarray] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of neighbours; NO_RANK where they do not merge or ``same`` is false."""
        key = np.where(same & (left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NO_RANK), np.where(hit, self.pair_id[at], -1)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run merge rounds over flat ``symbols`` of words numbered, in order, by ``word``."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            new_word = word[1:] != word[:-1]
            rank, merged = self.look_up(symbols[:-1], symbols[1:], ~new_word)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.concatenate([[True], new_word]))
            number = np.concatenate([[0], np.cumsum(new_word)])
            best = np.minimum.reduceat(rank, starts)[number]
            at = np.flatnonzero((rank == best) & (best < NO_RANK))
            # Of touching hits every second one merges, from the left.
            begins = np.concatenate([[True], np.diff(at) > 1])[: len(at)]
            first = np.maximum.accumulate(np.where(begins, at, 0)) if len(at) else at
            take = at[(at - first) % 2 == 0]
            take = self.in_turn(symbols, word, take, merged, best)
            keep = best < NO_RANK
            if not keep.all():
                done.append((symbols[~keep], word[~keep]))
            symbols[take] = merged[take]
            keep[take + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def in_turn(self, symbols: np.ndarray, word: np.ndarray, take: np.ndarray, merged: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Leave only the first merge in words where a merge makes a pair that would come before the others."""
        if len(take) < 2:
            return take
        new, n = merged[take], len(symbols)
        left, right = np.maximum(take - 1, 0), np.minimum(take + 2, n - 1)
        inside = (take > 0) & (word[left] == word[take]), (take + 2 < n) & (word[right] == word[take])
        early = self.look_up(symbols[left], new, inside[0])[0] <= best[take]
        early |= self.look_up(new, symbols[right], inside[1])[0] <= best[take]
        beside = np.concatenate([[False], (take[1:] - take[:-1] == 2) & (word[take[1:]] == word[take[:-1]])])
        early |= self.look_up(np.concatenate([[0], new[:-1]]), new, beside)[0] <= best[take]
        if not early.any():
            return take
        alone = np.isin(word[take], word[take[early]])
        later = np.concatenate([[False], word[take[1:]] == word[take[:-1]]])
        return take[~(alone & later)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        known = self.char_ids[points].astype(np.int64)
        symbols, word = self.merge(np.where(known < 0, points + self.size, known), word)
        if (symbols >= self.size).any():
            symbols, word = self.to_bytes(symbols, word)
        ends = np.searchsorted(word, np.arange(1, len(words))) * 4
        flat = symbols.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(flat)])]

    def to_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace code points that are no piece by the pieces of their UTF-8 bytes."""
        raw = symbols >= self.size
        each = [chr(c).encode("utf-8", "replace") for c in (symbols[raw] - self.size).tolist()]
        times = np.ones(len(symbols), dtype=np.int64)
        times[raw] = [len(b) for b in each]
        out = np.repeat(symbols, times)
        out[np.repeat(raw, times)] = self.byte_ids[np.frombuffer(b"".join(each), dtype=np.uint8)]
        return out, np.repeat(word, times)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.cache))
        at = 0
        while at < len(fresh):
            end, total = at, 0
            while end < len(fresh) and (end == at or total + len(fresh[end]) <= CHUNK):
                total += len(fresh[end])
                end += 1
            self.cache.update(zip(fresh[at:end], self.encode_words(fresh[at:end])))
            at = end
        head, tail = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [b"".join([head, *map(self.cache.__getitem__, words), tail]) for words in split]

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces without the dummy prefix; bytes that are no UTF-8 become U+FFFD, one for each."""
        out = self.output
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        text = b"".join([out[i] for i in numbers])
        first = next((i for i in numbers if out[i]), self.unknown)
        if out[first][:1] == b" " and first not in self.byte_set and first != self.unknown:
            text = text[1:]
        return text.decode("utf-8", "piece-bytes")


NO_RANK = np.iinfo(np.int64).max


@functools.lru_cache(maxsize=1)
def model(path: str) -> PieceModel:
    """The model of a file, read once in each Python worker."""
    return PieceModel(path)


def encoded(m: PieceModel, batches: Iterator[pd.Series]) -> Iterator[list[bytes]]:
    """Ids of parts of batches of texts.  What is kept of one task's words is dropped at its end, since workers live on."""
    try:
        for batch in batches:
            texts = [t or "" for t in batch]
            for part in parts(texts, HELD):
                yield m.encode(texts[part])
    finally:
        m.cache.clear()


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4").astype(np.int32)


def with_ids(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``piece_ids`` (array of int) of a text column, with begin and end ids; a null text is an empty one."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in encoded(model(path), batches):
            yield pd.Series([numbers(b) for b in found])

    return docs.withColumn("piece_ids", ids(F.col(text)))


def with_text(rows: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """Add ``piece_text``, the text that an array of ids decodes to; null ids give a null text."""

    @F.pandas_udf("string")
    def text(found: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else model(path).decode(np.asarray(x, dtype="<u4").tobytes()) for x in found], dtype="object")

    return rows.withColumn("piece_text", text(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``piece_ids`` and ``piece_text`` in one pass through Python, which holds about ``HELD`` code points of texts at a time."""

    @F.pandas_udf("struct<piece_ids: array<int>, piece_text: string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for found in encoded(m, batches):
            yield pd.DataFrame({"piece_ids": [numbers(b) for b in found], "piece_text": [m.decode(b) for b in found]})

    return docs.withColumn("__both", both(F.col(text))).select(*docs.columns, "__both.*")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, number of ids, and SHA-256 of the ids and of the text decoded from them, for each document."""

    @F.pandas_udf("struct<n_tokens:bigint, ids_sha256:string, decoded_sha256:string>")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for found in encoded(m, batches):
            rows = [(len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(m.decode(b).encode()).hexdigest()) for b in found]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op6_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded texts of all documents.

    Null and empty texts have the begin and the end id only and decode to ``''``.  Repeated rows are all encoded, null ids too.
    An empty table gives no rows; other columns are not looked at.
    """
    return digests(table(spark, sf_dir, "documents"), path or public_model())
