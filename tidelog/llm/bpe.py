"""Byte-level BPE by prefix dynamic programming: every byte prefix has one valid last token.

A token sequence is what the merges give if and only if each pair of neighbours would stay apart when merged together. So the last token of a
prefix is the one vocabulary entry that ends it and may follow the last token of the shorter prefix. The table of last tokens only grows when
bytes are appended, and stays valid up to the first changed byte when text is edited.

Null and empty texts have no tokens. Repeated rows are encoded each for itself. Any other columns are kept as they are; a column that
bears the output's name is replaced.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.batches import with_column

CACHED_WORDS = 200_000
CACHED_PIECES = 200_000
WORDS_A_CALL = 50_000
SHORT_BYTES = 100


class Vocabulary:
    """Ranks of byte strings, as read from a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._edges: dict[int, tuple[tuple, tuple]] = {}
        # Judged pairs by their first token; tokens are few, and so are those that can follow one in text.
        self._pairs: dict[int, dict[int, bool]] = defaultdict(dict)
        # By the size of the last token of the prefix one byte shorter: sizes of the next last token, likely ones first. A short token tends to grow.
        self._sizes = [[*dict.fromkeys(([t + 1, 1] if t < 3 else [1, t + 1]) + [*range(2, self.longest + 1)])] for t in range(self.longest)]
        self._sizes.append([*range(1, self.longest + 1)])
        self._packed_ids = {rank: (rank.to_bytes(4, "little"), len(token)) for rank, token in self.bytes_of.items()}

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        token = self.bytes_of[rank]
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self._below(parts[i] + parts[i + 1], rank))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _below(self, token: bytes, limit: int) -> float:
        found = self.ranks.get(token)
        return float("inf") if found is None or found >= limit else found

    def edges(self, rank: int) -> tuple[tuple, tuple]:
        """The tokens that stand at this token's left and right edge while it is being merged, shortest first."""
        found = self._edges.get(rank)
        if found is None:
            parts = self.halves(rank)
            left = (*self.edges(parts[0])[0], rank) if parts else (rank,)
            right = (*self.edges(parts[1])[1], rank) if parts else (rank,)
            found = self._edges[rank] = (left, right)
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two tokens again."""
        found = self._pairs[a].get(b)
        if found is None:
            found = self._pairs[a][b] = self._stay_apart(self.edges(a)[1], self.edges(b)[0])
        return found

    def _stay_apart(self, left: tuple, right: tuple) -> bool:
        never = float("inf")
        i = j = 0
        while True:
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], never)
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            if across < grow_left and across <= grow_right:
                return False
            if grow_left is never and grow_right is never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Complete the table of last tokens, one per byte prefix of `piece`; what it holds already is kept."""
        ranks, apart, longest = self.ranks, self.apart, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (not start or apart(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """Walk back over a table of last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian 32-bit integers. In sorted order, a piece goes on with the table of the prefix it shares with the one before."""
        out: dict[str, bytes] = {}
        last: list[int] = []
        before = b""
        get, pairs, sizes, packed_ids = self.ranks.get, self._pairs, self._sizes, self._packed_ids
        for piece in sorted(pieces):
            data = piece.encode()
            length = len(data)
            shared, limit = 0, min(length, len(before))
            while shared < limit:
                middle = (shared + limit + 1) // 2
                if data[shared:middle] == before[shared:middle]:
                    shared = middle
                else:
                    limit = middle - 1
            del last[shared:]
            size = packed_ids[last[-1]][1] if shared else 0
            for end in range(shared + 1, length + 1):
                # The valid token is unique, so likely sizes come first.
                for size in sizes[size]:
                    if size > end:
                        continue
                    start = end - size
                    token = get(data[start:end])
                    if token is None:
                        continue
                    if start:
                        apart = pairs[last[start - 1]].get(token)
                        if apart is None:
                            apart = self.apart(last[start - 1], token)
                        if not apart:
                            continue
                    last.append(token)
                    break
            # Only last tokens are kept of each prefix, so that memory is linear in the longest piece.
            if length > SHORT_BYTES:
                out[piece] = np.array(self.tokens(last), "<i4").tobytes()
            else:
                found, end = b"", length
                while end:
                    ids, size = packed_ids[last[end - 1]]
                    found = ids + found
                    end -= size
                out[piece] = found
            before = data
        return out


class WordEncoder:
    """Texts to ids, word by word. Words between single spaces are encoded once, many together, and then looked up.

    `encode_words` gives the ids of each word with a space before it, `encode_text` those of any text, as little-endian 32-bit integers.
    """

    def __init__(self, encode_words, encode_text):
        self.encode_words, self.encode_text = encode_words, encode_text
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [t.split(" ") if t else None for t in texts]
        if len(self.known) > CACHED_WORDS:
            # Bounded. The words met first are the frequent ones; the others are encoded anew when they return.
            for word in list(self.known)[CACHED_WORDS // 4 :]:
                del self.known[word]
        known, fresh = self.known, set()
        for words in split:
            if words:
                fresh.update(words[1:])
        fresh = fresh.difference(known)
        # A space beside other white space or at the end belongs to no word: such words are never learnt, and their texts go as a whole.
        loose = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        for i, words in enumerate(split):
            if words and len(words) > 1 and (not words[0] or words[0][-1].isspace() or (loose and not loose.isdisjoint(words[1:]))):
                split[i] = None
        fresh = list(fresh - loose)
        for at in range(0, len(fresh), WORDS_A_CALL):
            some = fresh[at : at + WORDS_A_CALL]
            known.update(zip(some, self.encode_words(some), strict=True))
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.encode_text(text) if text else b"")
            else:
                words[0] = self.encode_text(words[0])
                words[1:] = map(known.__getitem__, words[1:])
                out.append(b"".join(words))
        # Long words seldom return, and the bound on the table counts words, not bytes.
        for word in fresh:
            if len(word) > SHORT_BYTES:
                del known[word]
        return out


class Encoder:
    """Text to ids by a vocabulary and a pattern that splits text into pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        # Words differ by the marks around them more than by their pieces. Bounded; the pieces met first are the frequent ones.
        self._known: dict[str, bytes] = {}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > CACHED_PIECES:
            for piece in list(known)[CACHED_PIECES // 4 :]:
                del known[piece]
        fresh = set(pieces).difference(known)
        known.update(self.vocabulary.encode_pieces(fresh))
        out = list(map(known.__getitem__, pieces))
        for piece in fresh:
            if len(piece) > SHORT_BYTES:
                del known[piece]
        return out

    def encode_bytes(self, text: str) -> bytes:
        return b"".join(self._encoded(self.split(text)))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it. Only a word's first piece starts with a space."""
        pieces = self.split(" " + " ".join(words))
        out: list[bytes] = []
        for piece, ids in zip(pieces, self._encoded(pieces), strict=True):
            if piece[0] == " ":
                out.append(ids)
            else:
                out[-1] += ids
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()


class EditableText:
    """A text with its tables of last tokens, for appends and edits that encode no more than they must."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder = encoder
        self.pieces: list[str] = []
        self.tables: list[list[int]] = []
        self._replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.encoder.vocabulary.tokens(table)]

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, begin: int, end: int, text: str) -> None:
        """Put `text` in place of the characters from `begin` to `end`."""
        ends = list(accumulate(map(len, self.pieces)))
        # White space looks one character ahead, so the piece before the touched one may change too.
        first = max(0, sum(e < begin for e in ends) - 1)
        start = ends[first - 1] if first else 0
        old = self.text
        self._replace(first, start, old[start:begin] + text + old[end:])

    def _replace(self, first: int, start: int, tail: str) -> None:
        vocabulary = self.encoder.vocabulary
        fresh = self.encoder.split(tail)
        spare = list(zip(self.pieces[first:], self.tables[first:], strict=True))
        same = 0
        while same < min(len(spare), len(fresh)) and spare[-1 - same][0] == fresh[-1 - same]:
            same += 1
        tables = []
        for k, piece in enumerate(fresh):
            if len(fresh) - k <= same:
                tables.append(spare[len(spare) - len(fresh) + k][1])
                continue
            data, table = piece.encode(), []
            if k < len(spare):
                before = spare[k][0].encode()
                shared = next((i for i, (a, b) in enumerate(zip(data, before, strict=False)) if a != b), min(len(data), len(before)))
                table = spare[k][1][:shared]
            tables.append(vocabulary.extend(data, table))
        self.pieces[first:] = fresh
        self.tables[first:] = tables


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array of integers."""

    def setup():
        encoder = Encoder(Vocabulary(path), pattern)
        words = WordEncoder(encoder.encode_words, encoder.encode_bytes)

        def make(texts: pa.Array) -> pa.Array:
            parts = words.encode(texts.to_pylist())
            offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
            values = np.frombuffer(b"".join(parts), dtype="<i4")
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

        return make

    return with_column(df, text, ids, T.ArrayType(T.IntegerType()), setup)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids decode to no bytes; an id outside the vocabulary is an error."""

    def setup():
        bytes_of = Vocabulary(path).bytes_of
        table = pa.array([bytes_of.get(rank) for rank in range(max(bytes_of) + 1)], pa.binary())

        def make(rows: pa.Array) -> pa.Array:
            rows = rows.fill_null([])
            tokens = table.take(rows.flatten())
            if tokens.null_count:
                raise KeyError("an id that the vocabulary does not have")
            # The bytes of a row's tokens lie side by side.
            ends = np.cumsum([0, *rows.value_lengths().to_numpy(zero_copy_only=False)])
            starts = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset :][ends] if len(tokens) else np.zeros(len(ends), np.int32)
            return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(starts.astype(np.int32)), tokens.buffers()[2] or pa.py_buffer(b"")])

        return make

    return with_column(df, ids, decoded, T.BinaryType(), setup)
