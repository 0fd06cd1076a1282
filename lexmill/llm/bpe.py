"""Problem 6: the whole corpus as token ids of a public byte-level BPE, by a trie of the distinct words.

Method: the words (pre-tokens) of a block of texts are found and made distinct (by hash, then compared); the distinct words form a trie,
and every node holds one state, the last token of the encoding of its prefix. A child's state follows from its ancestors':
a token t that is a suffix of the prefix is its last token if and only if t and the last token of what is before t stay
apart under the merges, and exactly one suffix does. So the encoding of a shared prefix is computed once, and a word's ids are
read back along its own path. The nodes of one depth are handled together, as numpy arrays, rather than one branch after
the other: each state needs its ancestors' only, so the order makes no difference to the result. Below the depth at which
fewer than FEW words go on, each of these is followed to its end alone, with the same states.

Defined cases: null and empty texts have no ids (an empty list); texts of white space have the ids of their white space;
strings of special tokens are ordinary text. Rows are never dropped, and repeated rows come out as often as they come in.
"""

from __future__ import annotations

import json
import os
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm.codepoints import SpanHash, blocks, first_difference, flatten, mix64

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"
#: Below this number of words at a depth of the trie, each is followed alone: a matter of cost, not of results.
FEW = 12
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def tokenizer_file() -> str:
    return os.environ.get("LEXMILL_TOKENIZER", DEFAULT_FILE)


def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            kinds[code] = LETTER
        elif kind == "N":
            kinds[code] = NUMBER
    # the characters with the property White_Space
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


class Lookup:
    """uint64 key -> int32 value in an open table: -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(12, int(np.ceil(np.log2(len(keys) * 6 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.steps = 1
        at = self._slot(keys)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slots = (at[todo] + step) & self.mask
            free = self.values[slots] < 0
            mine = todo[free]
            _, first = np.unique(slots[free], return_index=True)
            put = mine[first]
            self.keys[slots[free][first]], self.values[slots[free][first]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            step += 1
            self.steps = max(self.steps, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        for step in range(1, self.steps):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            slots = (at[left] + step) & self.mask
            out[left] = np.where(self.keys[slots] == keys[left], self.values[slots], -1)
        return out


@dataclass
class Words:
    """The words of a block of texts, in order: text number, first code point in it, and tokens."""

    text: np.ndarray
    start: np.ndarray
    n_tokens: np.ndarray
    distinct: np.ndarray
    offsets: np.ndarray  # of the distinct words' ids
    ids: np.ndarray

    def flat_ids(self) -> np.ndarray:
        """The ids of all words in order."""
        ends = np.cumsum(self.n_tokens)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - self.n_tokens - self.offsets[self.distinct], self.n_tokens)
        return self.ids[place]

    def tokens_of_texts(self, n: int) -> np.ndarray:
        return np.bincount(self.text, self.n_tokens, n).astype(np.int64)


class Encoder:
    """Byte-level BPE from a tokenizers file with `vocab` and `merges`; ids of merged tokens rise with their merges' order."""

    _loaded: dict[str, Encoder] = {}
    MEMO = 21

    @classmethod
    def of(cls, path: str | None = None) -> Encoder:
        """One for each process and file."""
        path = path or tokenizer_file()
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # printable bytes stand for themselves in the file, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = model["vocab"]
        special = {t for t in vocab if any(c not in letters for c in t)}
        words = {t: bytes(letters[c] for c in t) for t in vocab if t not in special and t != "<|endoftext|>"}
        self.size = max(vocab.values()) + 1
        self.left, self.right = np.full(self.size, -1, np.int32), np.full(self.size, -1, np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.left[merged[:, 2]], self.right[merged[:, 2]] = merged[:, 0], merged[:, 1]
        if np.any(np.diff(merged[:, 2]) <= 0):
            raise ValueError("the ids of this vocabulary don't follow the order of its merges")
        self.pairs = Lookup(self._pair(merged[:, 0], merged[:, 1]), merged[:, 2].astype(np.int32))
        self.words = {w: vocab[t] for t, w in words.items()}
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        sizes = np.array([len(w) for w in self.words])
        ends = np.cumsum(sizes)
        self.longest = int(sizes.max())
        ids = np.fromiter(self.words.values(), np.int32)
        hashes = SpanHash(flat)(ends - sizes, ends)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two tokens of this vocabulary have the same hash")
        self.token_of = Lookup(hashes, ids)
        self.bytes_of, self.begin_of, self.size_of = flat, np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.begin_of[ids], self.size_of[ids] = ends - sizes, sizes
        self.kinds = _classes()
        self.memo_key, self.memo = np.zeros(1 << self.MEMO, np.uint64), np.zeros(1 << self.MEMO, bool)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(24)) | b.astype(np.uint64) | np.uint64(1 << 60)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of a and b, encoded, is again a and b: the latest merges of the two are undone one by one, and
        no pair at the seam may have a merge that would have come before the one undone."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self.pairs(self._pair(x, y))
            bad = (m >= 0) & (m < limit[live])
            good[live[bad]] = False
            whole_x, whole_y = self.left[x] < 0, self.left[y] < 0
            go = ~bad & ~(whole_x & whole_y)
            live, x, y, whole_x, whole_y = live[go], x[go], y[go], whole_x[go], whole_y[go]
            undo_x = ~whole_x & (whole_y | (x > y))
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
        return good

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._pair(a, b)
        at = (mix64(key) >> np.uint64(64 - self.MEMO)).astype(np.int64)
        out = self.memo[at]
        miss = np.flatnonzero(self.memo_key[at] != key)
        if len(miss):
            _, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            one = miss[first]
            found = self._stay_apart(a[one], b[one])
            out[miss] = found[back]
            self.memo_key[at[one]], self.memo[at[one]] = key[one], found
        return out

    def split(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start: runs of letters, of numbers, of white space and of others, a single blank going with the run
        after it, white space before a word leaving its last character apart, and the English endings after an apostrophe."""
        n = len(codes)
        kind = self.kinds[codes]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        new = first[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        # the last character of white space before something else in the same text
        seam = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        new[seam] = True
        blank = seam[codes[seam] == 0x20]
        new[blank + 1] = False
        quote = np.flatnonzero((codes == 0x27) & new)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
        if len(quote):
            second = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
            second[first[np.minimum(quote + 2, n)]] = 0
            one = np.isin(codes[quote + 1], [ord(c) for c in "stmd"])
            pair = codes[quote + 1].astype(np.int64) * 65536 + second
            two = np.isin(pair, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")])
            for at, size in ((quote[one], 2), (quote[two], 3)):
                new[at + 1] = False
                rest = at + size
                rest = rest[rest < n]
                new[rest] = True
        return np.flatnonzero(new)

    def encode_words(self, texts: list) -> Words:
        codes, offsets = flatten(texts)
        none = np.zeros(0, np.int64)
        if not len(codes):
            return Words(none, none, none, none, np.zeros(1, np.int64), none.astype(np.int32))
        start = self.split(codes, offsets)
        end = np.append(start[1:], len(codes))
        first, distinct = self._distinct(codes, start, end)
        text = np.searchsorted(offsets, start, "right") - 1
        size = (end - start)[first]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size - start[first], size)
        chars = codes[place]
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        data = chars.tobytes().decode("utf-32-le").encode()
        byte_ends = np.cumsum(width)[ends - 1]
        ids, id_offsets = self._encode_distinct(data, np.concatenate(([0], byte_ends)))
        return Words(text, start - offsets[text], np.diff(id_offsets)[distinct], distinct, id_offsets, ids)

    @staticmethod
    def _distinct(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each distinct word, and the number of every word's own. Words of one hash are compared letter by letter."""
        _, first, distinct = np.unique(SpanHash(codes)(start, end), return_index=True, return_inverse=True)
        size, model = end - start, first[distinct]
        same = size == size[model]
        same[same] = first_difference(codes, start[same], start[model[same]], size[same]) == size[same]
        others: dict[bytes, int] = {}
        more: list[int] = []
        for i in np.flatnonzero(~same).tolist():
            word = codes[start[i] : end[i]].tobytes()
            if word not in others:
                others[word] = len(first) + len(more)
                more.append(i)
            distinct[i] = others[word]
        return np.append(first, np.array(more, np.int64)), distinct

    def _tokens_at(self, flat: np.ndarray, span: SpanHash, begin: np.ndarray, size: int) -> np.ndarray:
        """The token of flat[begin:begin+size] for each begin, -1 where there is none. Its bytes are compared, not the hash alone."""
        t = self.token_of(span(begin, begin + size))
        may = np.flatnonzero(t >= 0)
        own, inside = t[may], np.arange(size)
        good = self.size_of[own] == size
        good[good] = (flat[begin[may[good], None] + inside] == self.bytes_of[self.begin_of[own[good], None] + inside]).all(1)
        t[may[~good]] = -1
        return t

    def _encode_distinct(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[cuts[i]:cuts[i+1]], flat, and their offsets."""
        words = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        order = sorted(range(len(words)), key=words.__getitem__)
        n, token, length, base, size = self._trie([words[i] for i in order])
        counts = np.zeros(len(words), np.int64)
        counts[order] = n
        offsets = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros(offsets[-1], np.int32)
        to, at = offsets[np.array(order)], size.copy()
        live, left = np.arange(len(order)), n.copy()
        while len(live):  # from each word's end back along its path
            here = base[live] + at[live]
            left[live] -= 1
            out[to[live] + left[live]] = token[here]
            at[live] -= length[here]
            live = live[at[live] > 0]
        return out, offsets

    def _trie(self, words: list[bytes]):
        """Last token, its length and the number of tokens for each prefix of sorted distinct words."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        base = begin + np.arange(len(words))  # a word has size + 1 places, for its prefixes from the empty one on
        span = SpanHash(flat)
        # how much of a word is a prefix of the word before it, by halving
        low, high = np.zeros(len(words), np.int64), np.minimum(size, np.concatenate(([0], size[:-1])))
        before = np.maximum(np.arange(len(words)) - 1, 0)
        while np.any(low < high):
            mid = (low + high + 1) // 2
            same = span(begin, begin + mid) == span(begin[before], begin[before] + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        shared = first_difference(flat, begin, begin[before], low)  # equal hashes may say more than is equal, never less
        token, length, count = (np.zeros(len(flat) + len(words), np.int32) for _ in range(3))
        alive = np.arange(len(words))
        for depth in range(1, int(size.max()) + 1):
            alive = alive[size[alive] >= depth]
            if len(alive) < FEW:
                for i in alive.tolist():
                    self._follow(words[i], depth, int(base[i]), token, length, count)
                break
            new = shared[alive] < depth
            new[0] = True
            nodes = alive[new]
            token_n, length_n, count_n = (np.zeros(len(nodes), np.int32) for _ in range(3))
            todo = np.arange(len(nodes))
            for k in range(1, min(depth, self.longest) + 1):
                at = nodes[todo]
                t = self._tokens_at(flat, span, begin[at] + depth - k, k)
                may = np.flatnonzero(t >= 0)
                if k < depth and len(may):
                    previous = token[base[at[may]] + depth - k]
                    may = may[self.stay_apart(previous, t[may])]
                if not len(may):
                    continue
                hit = todo[may]
                token_n[hit], length_n[hit] = t[may], k
                count_n[hit] = count[base[at[may]] + depth - k] + 1
                todo = np.delete(todo, may)
                if not len(todo):
                    break
            group = np.cumsum(new) - 1
            place = base[alive] + depth
            token[place], length[place], count[place] = token_n[group], length_n[group], count_n[group]
        return count[base + size].astype(np.int64), token, length, base, size

    def _follow(self, word: bytes, depth: int, base: int, token: np.ndarray, length: np.ndarray, count: np.ndarray) -> None:
        """The states of one word's prefixes from `depth` bytes on, where those of the shorter ones are known."""
        end = base + len(word) + 1
        last, size, n = (a[base:end].tolist() for a in (token, length, count))
        known: dict[tuple[int, int], bool] = {}
        for d in range(depth, len(word) + 1):
            for k in range(1, min(d, self.longest) + 1):
                t = self.words.get(word[d - k : d])
                if t is None:
                    continue
                if k < d:
                    pair = (last[d - k], t)
                    if pair not in known:
                        known[pair] = bool(self._stay_apart(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if not known[pair]:
                        continue
                last[d], size[d], n[d] = t, k, n[d - k] + 1
                break
        token[base:end], length[base:end], count[base:end] = last, size, n

    def sizes(self) -> np.ndarray:
        """Bytes of each token, by id."""
        out = np.zeros(self.size, np.int64)
        out[list(self.words.values())] = [len(w) for w in self.words]
        return out

    def counts(self, texts: list) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b in blocks(texts):
            out[a:b] = self.encode_words(texts[a:b]).tokens_of_texts(b - a)
        return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """`id_col` and `ids` for every row of df; no shuffle, one pass over the two columns."""
    path = path or tokenizer_file()

    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                words = encoder.encode_words(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum(words.tokens_of_texts(b - a))))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words.flat_ids(), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids], names=[id_col, "ids"])

    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with the number of tokens of its text (0 for null and empty); needs no column but the text in the Python worker."""
    from pyspark.sql import functions as F

    path = path or tokenizer_file()

    @F.pandas_udf(T.LongType())
    def count(texts):
        import pandas as pd

        return pd.Series(Encoder.of(path).counts([t if isinstance(t, str) else None for t in texts]))

    return df.withColumn(out, count(F.col(text_col)))
