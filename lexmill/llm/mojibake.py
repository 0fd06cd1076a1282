"""Problem 2: text that was read in another encoding than it was written in, found and restored.

Method: a multinomial classifier over hashed byte bigrams. Its training rows are texts of the documents table, taken as they are (clean) and
garbled synthetically by every chain of encodings in CHAINS; of a sentence's UTF-8 bytes, the pairs with a byte beyond ASCII count. Every
sentence of every text is scored; those for which a garbled class is more likely than clean get the likeliest chains, each
is inverted (encoded back, decoded right), and the inverse must decode strictly and read as clean text by the same classifier.

A sentence that strictly decodes is restored. One that only decodes with a few bytes missing, or holds replacement characters,
is found but left as it is (the classifier names the chain, but nothing strict confirms it). Everything else stays untouched: foreign names, symbols, letters of other scripts.

Training is on at most TRAIN_ROWS texts, those with the lowest hashes of their ids. The model is as large as classes times
buckets, whatever the data. Texts are scored in one pass; nothing is shuffled but the ids found.

Defined cases: null, empty and blank texts are never garbled; a result delivered twice counts once; texts longer than a block are one block.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.codepoints import blocks
from lexmill.llm.lookalike import Forms

TRAIN_ROWS = 1_000
BUCKETS = 1 << 14
#: A garbled sentence's inverse must be likelier as clean text than the sentence by this many nats for each pair that counts.
GAIN = 1.0
#: Chains that are tried for a sentence, the likeliest first: the classifier's prediction. Where all are tried, unlikely ones fit right text by chance (60 of 416 results on sf0.1).
TRIED = 6
#: A chain must be likelier than clean text by this many nats over a sentence.
MARGIN = 8.0
#: Chains of (written in, read in), one or two steps.
CHAINS = [
    *[(("utf-8", w),) for w in ("latin-1", "cp1252", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "koi8-r", "gb18030", "big5", "shift_jis", "euc_kr")],
    *[(("gb18030", w),) for w in ("latin-1", "cp1252", "mac_roman", "cp1251", "cp437", "big5", "shift_jis", "euc_kr", "utf-8")],
    *[(("cp1252", w),) for w in ("utf-8", "mac_roman", "cp1251", "cp437", "cp850", "gb18030", "big5", "shift_jis")],
    *[(("big5", w),) for w in ("gb18030", "cp1252", "utf-8")],
    (("utf-8", "latin-1"), ("utf-8", "latin-1")), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "latin-1"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "latin-1")),
]
UNREADABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd\ue000-\uf8ff]")
SENTENCE = re.compile(r"[^\n。！？；]*?(?:[。！？；]+[”’」』）]*|[.!?;](?=\s)|\n|$)\s*")


class Codec:
    """A single-byte encoding as browsers read it: bytes without a character become control characters; others by Python."""

    _tables: dict[str, tuple] = {}
    SINGLE = {"latin-1", "cp1252", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "koi8-r"}

    @classmethod
    def table(cls, name: str):
        if name not in cls._tables:
            letters = "".join(bytes([b]).decode(name, "replace").replace("�", chr(b)) for b in range(256))
            cls._tables[name] = letters, codecs.charmap_build(letters)
        return cls._tables[name]

    @classmethod
    def members(cls, name: str) -> str:
        """All characters of a single-byte encoding."""
        return cls.table(name)[0]

    @classmethod
    def read(cls, data: bytes, name: str) -> str:
        if name in cls.SINGLE:
            return codecs.charmap_decode(data, "strict", cls.table(name)[0])[0]
        return data.decode(name, "replace")

    @classmethod
    def back(cls, text: str, name: str, strict: bool = True) -> bytes | None:
        """The bytes that `read` made the text of; without strict, characters that have none are left out."""
        try:
            if name in cls.SINGLE:
                return codecs.charmap_encode(text, "strict" if strict else "ignore", cls.table(name)[1])[0]
            return text.encode(name, "strict" if strict else "ignore")
        except UnicodeEncodeError:
            return None


def garble(text: str, chain) -> str | None:
    for right, wrong in chain:
        try:
            text = Codec.read(text.encode(right), wrong)
        except UnicodeEncodeError:
            return None
    return text


def invert(text: str, chain, strict: bool = True) -> str | None:
    """What a garbled text was; None where it isn't of this chain. Without strict, up to a quarter of it may be missing."""
    for right, wrong in reversed(chain):
        data = Codec.back(text, wrong, strict)
        if data is None:
            return None
        try:
            text = data.decode(right)
        except UnicodeDecodeError:
            if strict:
                return None
            text = data.decode(right, "replace")
            if text.count("�") > 0.25 * len(text):
                return None
            text = text.replace("�", "")
    return text


def sentences(text: str) -> list[str]:
    """The text in pieces that end where a sentence or a line does, or where a run of other letters than ideographs begins or ends
    among ideographs (a garbled sentence's own end can't be seen); nothing is lost."""
    out = []
    for piece in SENTENCE.findall(text):
        if piece and not piece.isascii() and HAN.search(piece) and FOREIGN.search(piece):
            at = 0
            for m in FOREIGN.finditer(piece):
                out += [x for x in (piece[at : m.start()], m.group()) if x]
                at = m.end()
            out += [piece[at:]] if at < len(piece) else []
        elif piece:
            out.append(piece)
    return out


def features(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte pairs beyond ASCII, and the piece of each."""
    data = [p.encode("utf-8", "replace") for p in pieces]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
    if len(flat) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(pieces)), [len(d) for d in data])
    pair = np.flatnonzero((owner[1:] == owner[:-1]) & ((flat[1:] | flat[:-1]) > 127))
    value = flat[pair] * 256 + flat[pair + 1]
    return (value * 40503 >> 2) % BUCKETS, owner[pair]


#: Signs of Western encodings that may be right though the training texts have none.
SIGNS = frozenset("¡¢£¥§©«®°±²³µ¶·¹º»¼½¾¿×÷–—‘’‚“”„†‡•…‰‹›€™")
HAN = re.compile(r"[\u3400-\u9fff]")


FOREIGN = re.compile(r"[\x80-\u2e7f](?:[\x00-\x7f]{0,12}[\x80-\u2e7f]){5,}")


def in_words(text: str, a: int, b: int) -> bool:
    """Whether accented letters in text[a:b] stand in words, as letters do and misread signs don't, or there are none."""
    places = [i for i in range(a, b) if 0xBF < ord(text[i]) < 0x250 and text[i].isalpha()]
    alone = [i for i in places if text[i] not in "àÀéó" and not (i and text[i - 1].isalpha() or text[i + 1 : i + 2].isalpha())]
    return len(alone) <= 0.5 * len(places)


@dataclass
class Model:
    """Log-likelihoods (classes x buckets) for two kinds of writing: clean and all chains of sentences with ideographs, then of
    those without; the same for clean and the mean of the chains; and the characters of clean text."""

    weights: np.ndarray
    coarse: np.ndarray
    letters: frozenset

    @staticmethod
    def train(texts: list[str]) -> Model:
        pieces = [p for p in dict.fromkeys(s for t in texts for s in sentences(t)) if not p.isascii()]
        weights, coarse = [], []
        for own in ([p for p in pieces if HAN.search(p)], [p for p in pieces if not HAN.search(p)]):
            counts = np.zeros((len(CHAINS) + 1, BUCKETS))
            counts[0] = np.bincount(features(own)[0], minlength=BUCKETS)
            whole = "".join(own)
            for k, chain in enumerate(CHAINS, 1):
                made = garble(whole, chain)
                if made is None:  # some sentences have characters that the encoding hasn't
                    made = "".join(g for p in own if (g := garble(p, chain)) is not None and g != p)
                counts[k] = np.bincount(features([made])[0], minlength=BUCKETS)
            total = counts.sum(1, keepdims=True)
            shares = (counts + 0.05) / (total + 0.05 * BUCKETS)
            weights.append(np.log(shares))
            coarse += [np.log(shares[0]), np.log(shares[1:][total[1:, 0] > 0.02 * total.max()].mean(0)) if total.max() else np.log(shares[0]) - 1]
        return Model(np.concatenate(weights).astype(np.float32), np.stack(coarse).astype(np.float32), frozenset("".join(pieces)))

    def suspects(self, pieces: list[str]) -> list[int]:
        """Pieces that are likelier garbled than clean, or hold what only a failed decoding leaves."""
        bucket, owner = features(pieces)
        clean_han, any_han, clean, any_other = (np.bincount(owner, row[bucket], len(pieces)) for row in self.coarse)
        odd = np.maximum(clean_han, clean) < np.maximum(any_han, any_other)
        return [i for i in range(len(pieces)) if odd[i] or "\ufffd" in pieces[i]]

    def clean_score(self, text: str) -> float:
        """Mean log-likelihood as clean text of the likelier kind, over the pairs that count; 0 for ASCII."""
        bucket, _ = features([text])
        return max(float(self.coarse[0][bucket].mean()), float(self.coarse[2][bucket].mean())) if len(bucket) else 0.0

    def judge(self, piece: str) -> tuple[bool, str | None, str]:
        """Whether a piece is garbled, what it was if nothing is lost, and the chain."""
        bucket, _ = features([piece])
        if not len(bucket):
            return False, None, ""
        n = len(CHAINS) + 1
        both = self.weights[:, bucket].sum(1)
        likely = np.maximum(both[:n], both[n:])
        lost = "\ufffd" in piece
        order = [k for k in np.argsort(-likely)[:TRIED].tolist() if k and (lost or likely[k] > likely[0] + MARGIN * 0.5)]
        bad = [i for i, c in enumerate(piece) if ord(c) > 127 and c not in self.letters]
        form = Forms.of().strings([piece])[0]
        if form != piece and not lost and all(ord(c) < 128 or c in self.letters for c in form):
            return False, None, ""  # disguised by characters of the same look, not garbled
        own = self.clean_score(piece)
        best = None
        for k in order:
            chain = CHAINS[k - 1]
            made = self._inverse(piece, chain, bad)
            if made is None:
                continue
            whole, other = made
            gain = self.clean_score(whole) - own
            known = sum(c in self.letters or c in SIGNS for c in other)
            enough = GAIN
            if chain[0][0] == "utf-8":  # several bytes of UTF-8 hardly ever fit by chance
                enough = -2.5 if known == len(other) else 0.0
            elif chain[0][0] == "cp1252" and not any(0xBF < ord(c) < 0x250 for c in other):
                continue
            elif chain[0][0] != "cp1252" and chain[0][1] not in Codec.SINGLE and len(other) < 4:
                continue
            if gain > enough and known >= 0.8 * len(other) and in_words(whole, 0, len(whole)) and (best is None or gain > best[0]):
                best = (gain, whole, k)
        if best and (bad or likely[best[2]] > likely[0] + MARGIN):
            return True, None if lost else best[1], self.name(best[2])
        if lost:
            return True, None, self.name(int(likely[1:].argmax()) + 1)
        if len(bad) > 3:
            for k in order:
                made = invert(piece, CHAINS[k - 1], strict=False)
                other = [c for c in made or "" if ord(c) > 127]
                if len(other) > 2 and sum(c in self.letters for c in other) >= 0.9 * len(other) and self.clean_score(made) - own > 2 * GAIN:
                    return True, None, self.name(k)
        return False, None, ""

    @staticmethod
    def _inverse(piece: str, chain, bad: list[int]) -> tuple[str, list[str]] | None:
        """A piece with its garbled stretches inverted strictly, and the characters beyond ASCII that this makes; None where nothing inverts.

        Of an encoding with one byte a character, the stretches are those that it has; of others, all of the piece, or what lies between
        its first and last character that clean text hasn't, a little wider."""
        wrong = chain[-1][1]
        if wrong in Codec.SINGLE:
            has = Codec.members(wrong)
            out, other, at = [], [], 0
            for m in re.finditer("[" + re.escape(has) + "]+", piece):
                made = invert(m.group(), chain) if not m.group().isascii() else None
                if made is None or made == m.group() or UNREADABLE.search(made):
                    continue
                out.append(piece[at : m.start()] + made)
                at = m.end()
                other += [c for c in made if ord(c) > 127]
            return ("".join(out) + piece[at:], other) if other else None
        parts = [(0, len(piece))]
        if bad:
            parts += [(max(0, bad[0] - x), min(len(piece), bad[-1] + 1 + y)) for x in range(4) for y in range(4)]
        for a, b in dict.fromkeys(parts):
            made = invert(piece[a:b], chain)
            if made is not None and made != piece[a:b] and not UNREADABLE.search(made):
                return piece[:a] + made + piece[b:], [c for c in made if ord(c) > 127]
        return None

    @staticmethod
    def name(k: int) -> str:
        return ", ".join(f"{right} read as {wrong}" for right, wrong in CHAINS[k - 1])

    def repair(self, text: str) -> tuple[bool, str | None, list[str]]:
        """Whether a text is garbled in a place, the text with all such places restored (None if one can't be), and the chains."""
        pieces = sentences(text)
        found, whole, chains = False, True, []
        for i in self.suspects(pieces):
            garbled, restored, chain = self.judge(pieces[i])
            if garbled:
                found = True
                chains.append(chain)
                if restored is None:
                    whole = False
                else:
                    pieces[i] = restored
        return found, "".join(pieces) if found and whole else None, sorted(set(chains))


def train(documents: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of at most `rows` documents, those whose ids have the lowest hashes."""
    hashed = documents.filter("text is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text")
    last = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # of texts, only those of the rows chosen reach the driver
    if last is None:
        return Model.train([])
    return Model.train([r.text for r in hashed.filter(F.col("h") <= last).orderBy("h", "doc_id").limit(rows).collect()])


def repair(results: DataFrame, documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """result_id, restored (null where something is lost) and chains of the results that are garbled in a place."""
    model = results.sparkSession.sparkContext.broadcast(train(documents, train_rows))

    def run(batches):
        m = model.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                pieces, owner = [], []
                for i in range(a, b):
                    own = sentences(texts[i])
                    pieces += own
                    owner += [i] * len(own)
                rows = [(keys[i], *m.repair(texts[i])) for i in sorted({owner[k] for k in m.suspects(pieces)})]
                rows = [r for r in rows if r[1]]
                yield pa.RecordBatch.from_pydict({"result_id": pa.array([r[0] for r in rows], pa.int64()), "restored": pa.array([r[2] for r in rows], pa.string()), "chains": pa.array([r[3] for r in rows], pa.list_(pa.string()))})

    odd = results.filter(F.length("text") < F.octet_length("text")).select("result_id", "text")  # others have no pair that counts
    return odd.mapInArrow(run, "result_id bigint, restored string, chains array<string>").dropDuplicates(["result_id"])
