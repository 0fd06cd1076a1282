"""Joint decoding of a page's character stream: the language model, and a lattice of words over lines put end to end.

The stream is cut into tokens (words and numbers, runs of ideographs and punctuation). An edge of the lattice reads one token or several as what the page
had: a token as it is or with a confusion of shapes undone, two tokens as one word (a blank taken out, a line end that cut a word, a hyphen at a line
end), one token as two words (a blank put in). Every edge costs the surprise of the words that it makes, from counts of whole words that fall back
on letter trigrams, plus the price of what it undoes; the cheapest path is the reading, and its edges say what was wrong.

A line's confidence and a second reading set the price of undoing a confusion: `Model.odds` is how likely a line is to have one at a confidence, learned from the lines that were
read twice. Whether a line is misread is asked of all its alternatives together (the odds, times the mean likelihood ratio of the
alternatives), so that a line whose wrong character can't be told still counts as much as it should.

All counts have a fixed size, whatever the number of texts, and are sums, so they can be added up in any order.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np

from lexmill.llm.codepoints import mix64

GRAMS, WORDS, BINS = 1 << 19, 1 << 18, 64
#: Where each table starts in the array of counts, and its length: grams, two rows of words, words of furniture, lines read twice and those that differ.
PARTS = {"grams": (0, GRAMS), "words": (GRAMS, 2 * WORDS), "furniture": (GRAMS + 2 * WORDS, WORDS), "bins": (GRAMS + 3 * WORDS, 2 * BINS)}
SIZE = 8192 * -(-(GRAMS + 3 * WORDS + 2 * BINS) // 8192)
#: What a scan may show for what the page has (fixed values: shapes that are easily taken for each other).
CONFUSIONS = [
    *("Z2 21 2Z l1 1l 71 17 |1 1| I1 1I Il lI 0o o0 0O O0 〇0 0〇 60 06 38 83 B8 8B b6 6b 65 56 5S S5 5s s5 94 49 ce ec bh hb ft tf !i i! i1 1i".split()),
    *("陷限 限陷 同司 司同 么公 公么 曰日 日曰 台合 合台 干于 于干 讧证 证讧 末未 未末 入人 人入 贷货 货贷 冋同 田由 由田 歉款 款歉 木本 本木 朗期 期朗 己已 已己 准淮 淮准".split()),
]
PAIRS = {"ii": "u", "rn": "m", "vv": "w", "ri": "n", "cl": "d", "II": "ll", "帐长": "账"}
BY_SHAPE: dict[str, list[str]] = {}
for _c in CONFUSIONS:
    BY_SHAPE.setdefault(_c[0], []).append(_c[1])
for _a, _b in PAIRS.items():
    if len(_b) == 1 and _b.isascii():
        BY_SHAPE.setdefault(_b, []).append(_a)
HAN = re.compile("[" + "".join(c for c in BY_SHAPE if c > "⺀" and c != "〇") + "]")
MASK = (1 << 64) - 1


class Letters(dict):
    """A table for `str.translate` that leaves what it doesn't list as it is, without an exception for each such letter."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


class Kept(dict):
    """Answers kept up to a number of them, worked out when first asked for."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.make(key)
        return got


DIGITS, DIGIT = Letters(str.maketrans("123456789", "000000000")), re.compile("[1-9]")
TOKEN = re.compile(r"(?:[A-Za-zÀ-ɏ0-9〇|]++|!(?=[a-zà-ÿ])|(?<=\d)[.,](?=[\dOlISZBb〇|])|(?<=[OlISZBb〇|])[.,](?=\d))++|[-‐‑¬­!.,]|[^A-Za-zÀ-ɏ0-9〇|\s\-‐‑¬­!.,]++")
TOKEN_AND_BLANKS = re.compile(rf"({TOKEN.pattern})(\s*+)")
PUNCTUATION = Letters(str.maketrans("，。：；！？（）", ",.:;!?()"))
LAST_WORD, FIRST_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]++[-‐‑¬­]$"), re.compile(r"[^\W\d_]+")
#: Nats for a blank taken out, a blank put in, a word cut at a line end without a hyphen, a hyphen that cuts a word, one that belongs there.
MERGE, SPLIT, CUT, HYPHEN, KEPT_HYPHEN = 7.0, 7.0, 5.0, 1.0, 4.0
#: Share of words that no count of words can foretell; the count from which a word is known; the odds of a confusion in a line without any confidence.
UNSEEN, KNOWN, BLIND = 0.02, 3, 0.05
#: Stands for how often a run of ideographs or marks was counted, which isn't asked.
NO_WORD = 1 << 40
#: A run of more letters is no word: it has no other readings, and costs what its letters cost.
LONGEST = 64


def shape(word: str) -> str:
    """Numbers count by their shape, so that they don't fill the tables."""
    return word.translate(DIGITS) if not word.isalpha() and DIGIT.search(word) else word


def word_slots(word: str) -> tuple[int, int]:
    d = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "little") & (WORDS - 1), int.from_bytes(d[4:], "little") & (WORDS - 1)


def same_but_marks(a: str, b: str) -> bool:
    """Whether two readings of a line differ in the width of punctuation at most."""
    return a == b or len(a) == len(b) and not (a.isascii() and b.isascii()) and a.translate(PUNCTUATION) == b.translate(PUNCTUATION)


def is_wide(token: str) -> bool:
    """Whether a token is a word or a number (others are runs of ideographs or of marks)."""
    c = token[0]
    return c < "ɐ" and c.isalnum() or c == "〇" or c in "|!" and len(token) > 1


def tokens(line: str) -> list[tuple[str, str]]:
    """The tokens of a line, each with the blanks after it."""
    return TOKEN_AND_BLANKS.findall(line)


def words_of(line: str) -> list[str]:
    """Words, numbers by their shape, and single ideographs and marks."""
    return [w for t in TOKEN.findall(shape(line)) for w in ([t] if is_wide(t) else t)]


def gram_slots(codes: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(codes.shape[:-1] + (codes.shape[-1] - width + 1,), np.uint64)
    for k in range(width):
        h = h * np.uint64(0x2545F4914F6CDD1D) + codes[..., k : codes.shape[-1] - width + 1 + k].astype(np.uint64, copy=False)
    return (mix64(h + np.uint64(width)) & np.uint64(GRAMS - 1)).astype(np.int64)


def gram_slot(text: str) -> int:
    """The same as `gram_slots` for one gram as wide as the text."""
    h = 0
    for c in text:
        h = (h * 0x2545F4914F6CDD1D + ord(c)) & MASK
    h = (h + len(text) + 0x9E3779B97F4A7C15) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return (h ^ (h >> 31)) & (GRAMS - 1)


slots_of = Kept(gram_slot, 200_000)


def whole_words(lines: list[str]) -> list[str]:
    """Lines without the words that a hyphen cuts at their ends."""
    out, cut = [], False
    for line in lines:
        if cut:
            line = FIRST_WORD.sub("", line, count=1) if line[:1].isalpha() else line
        cut = line[-1:] in "-‐‑¬­" and line[-1:] != ""
        if cut:
            line = LAST_WORD.sub("", line)
        out.append(line)
    return out


class Counts:
    """Sums of one task."""

    def __init__(self):
        self.all = np.zeros(SIZE, np.int64)
        self.part = {name: self.all[a : a + n] for name, (a, n) in PARTS.items()}
        self.waiting: list[str] = []
        self.waiting_words: list[str] = []
        self.size = 0

    def text(self, lines: list[str]) -> None:
        """Letters and words of lines, counted when there are enough; words that a hyphen cuts at a line end are left out."""
        self.waiting += lines
        self.waiting_words += whole_words(lines) if any(line[-1:] in "-‐‑¬­" for line in lines) else lines
        self.size += sum(map(len, lines))
        if self.size > 1_000_000:
            self.flush()

    def flush(self) -> None:
        lines, words, self.waiting, self.waiting_words, self.size = self.waiting, self.waiting_words, [], [], 0
        if not lines:
            return
        codes = np.frombuffer(("  " + "\n  ".join(lines)).encode("utf-32-le"), np.uint32)
        codes = np.where((codes >= 48) & (codes <= 57), 48, codes).astype(np.uint64)
        for width in (1, 2, 3):
            if len(codes) >= width:
                self.part["grams"] += np.bincount(gram_slots(codes, width), minlength=GRAMS)
        each: dict[str, int] = {}
        runs = []
        for word, n in Counter(TOKEN.findall("\n".join(words))).items():
            if not is_wide(word):
                runs.append(word * n)
            elif len(word) <= LONGEST:
                word = shape(word)
                each[word] = each.get(word, 0) + n
        single = np.bincount(np.frombuffer(shape("".join(runs)).encode("utf-32-le"), np.uint32))
        for c in np.flatnonzero(single).tolist():
            each[chr(c)] = each.get(chr(c), 0) + int(single[c])
        slots = np.array([word_slots(w) for w in each]).reshape(-1, 2)
        n = np.fromiter(each.values(), np.int64, len(each))
        np.add.at(self.part["words"], slots[:, 0], n)
        np.add.at(self.part["words"], WORDS + slots[:, 1], n)

    def furniture(self, line: str) -> None:
        for word in words_of(line):
            self.part["furniture"][word_slots(word)[0]] += 1

    def twice(self, confidence: float, differs: bool) -> None:
        k = bin_of(confidence)
        self.part["bins"][k] += 1
        self.part["bins"][BINS + k] += differs


def bin_of(confidence: float) -> int:
    return min(BINS - 1, max(0, int(confidence * BINS)))


class Model:
    """Costs in nats, from counts."""

    def __init__(self, counts: np.ndarray):
        part = {name: counts[a : a + n] for name, (a, n) in PARTS.items()}
        self.grams, self.words, self.marks = part["grams"], part["words"].reshape(2, WORDS), part["furniture"]
        self.n_letters = int(self.grams.sum(dtype=np.int64)) // 3
        self.n_words = max(1, int(self.words[0].sum(dtype=np.int64)))
        self.n_marks = int(self.marks.sum(dtype=np.int64))
        self.bins = part["bins"].reshape(2, BINS)
        n, d = self.bins.astype(float)
        middle = (np.arange(BINS) + 0.5) / BINS
        before = np.clip(1.9 - 2.1 * middle, 0.01, 0.9)  # what four lines of each bin would say before any is seen
        rate = (d + 4 * before) / (n + 4)
        top = np.cumsum(n[::-1])[::-1] - n <= n.sum() / 2  # the bins of the surer half of the lines: where they differ, it is mostly the second reading's slip
        self.slips = float(np.clip((d[top].sum() + 0.1) / (n[top].sum() + 10), 0.002, 0.2))
        noise = np.sqrt(rate * (1 - rate) / (n + 4))
        self.share = np.clip((rate - np.where(n >= 20, noise, 0.0) - self.slips) / (1 - self.slips), 0.0005, 0.995)
        self.known = Kept(self._gram, 400_000)
        self.seams = Kept(self._seam, 200_000)
        self.counts_of = Kept(self._seen, 500_000)
        self.ranks_of = Kept(lambda token: self.counts_of[token] if is_wide(token) else NO_WORD, 100_000)
        self.ratios = Kept(self._ratio, 200_000)
        self.costs_of = Kept(self._word, 300_000)
        self.gains_of = Kept(self._readings, 100_000)
        self.places_of = Kept(lambda word: sum(len(BY_SHAPE.get(c, ())) for c in word), 200_000)
        self.han_of = Kept(self._han, 200_000)

    def odds(self, confidence: float | None) -> float:
        """Log-odds that a line of this confidence is misread."""
        p = BLIND if confidence is None else float(self.share[bin_of(confidence)])
        return math.log(p / (1 - p))

    def _mix(self, three, two, pair, one, own):
        """From the counts of the three, the first two, the last two, the middle one and the last one; what has hardly been seen leaves its share to the shorter ones."""
        rest = 1.0 - 0.75 * two / (two + 2.0) - 0.2 * one / (one + 5.0)
        return 0.75 * three / (two + 2.0) + 0.2 * pair / (one + 5.0) + rest * (own + 1.0) / (self.n_letters + 200.0)

    def _gram(self, gram: str) -> float:
        """Cost of the last of three characters."""
        three = int(self.grams[gram_slot(gram)])
        return -math.log(self._mix(three, *(int(self.grams[slots_of[g]]) for g in (gram[:2], gram[1:], gram[1], gram[2]))))

    def letters(self, text: str) -> float:
        """Cost of a text by its letters; digits as in `shape`."""
        padded, known = "  " + text, self.known
        return sum([known[padded[i : i + 3]] for i in range(len(text))])

    def seen(self, word: str) -> int:
        """How often a word was counted, but for once, which may be chance, or a piece that a page's end left."""
        return self.counts_of[word]

    def _seen(self, word: str) -> int:
        if len(word) > LONGEST:
            return 0
        a, b = word_slots(shape(word))
        return max(0, min(int(self.words[0, a]), int(self.words[1, b])) - 1)

    def word(self, word: str) -> tuple[int, float]:
        """How often a word was counted, and its cost."""
        return self.costs_of[word]

    def _word(self, word: str) -> tuple[int, float]:
        n = self.counts_of[word]
        unseen = math.log(UNSEEN) - self.letters(shape(word) + " ")
        return n, -(_either(math.log((1 - UNSEEN) * n / self.n_words), unseen) if n else unseen)

    def readings(self, word: str) -> tuple[list[tuple[str, float]], str, float]:
        """What a word gains by each reading that has one confusion undone (a known word has nothing to gain by one never seen: minus infinity); and, of a word that isn't known, the cheapest such reading with its cost."""
        return self.gains_of[word]

    def _readings(self, word: str) -> tuple[list[tuple[str, float]], str, float]:
        count, cost = self.costs_of[word]
        own, gains, best, least = shape(word), [], "", math.inf
        for v in variants(word):
            if count < KNOWN:
                other = self.costs_of[v][1]
                if other < least:
                    best, least = v, other
                gains.append((v, 0.0 if shape(v) == own else cost - other))
            elif shape(v) == own:
                gains.append((v, 0.0))
            else:
                gains.append((v, cost - self.costs_of[v][1] if self.counts_of[v] else -math.inf))
        return gains, best, least

    def seam(self, text: str) -> float:
        """Mean cost of the characters where two lines meet, times three."""
        return self.seams[text]

    def _seam(self, text: str) -> float:
        given = shape(text)
        n = len(given) - 2
        return 3 * sum(self.known[given[k : k + 3]] for k in range(n)) / max(1, n)

    def _han(self, window: str) -> list[tuple[str, float]]:
        """What the ideograph in the middle of five characters gains by each that it may stand for."""
        cost = sum(self.known[window[k : k + 3]] for k in range(3))
        others = [(to, window[:2] + to + window[3:]) for to in BY_SHAPE[window[2]]]
        return [(to, cost - sum(self.known[w[k : k + 3]] for k in range(3))) for to, w in others]

    def line(self, text: str) -> float:
        """Cost of a line: its words, and by letters what is between them."""
        total, rest = 0.0, []
        for t, _ in tokens(text.translate(PUNCTUATION)):
            if is_wide(t):
                total += self.word(t)[1]
                rest.append(" ")
            else:
                rest.append(t)
        return total + self.letters(shape("".join(rest)))

    def words_in(self, own_tokens: list[tuple[str, str]]) -> list[str]:
        """The words and numbers among tokens."""
        ranks = self.ranks_of
        return [t for t, _ in own_tokens if ranks[t] != NO_WORD]

    def furniture(self, own_tokens: list[tuple[str, str]], words: list[str]) -> float:
        """How much likelier a line, given by its tokens and the words among them, is in furniture than anywhere (mean log-ratio of its words, ideographs and marks)."""
        if not self.n_marks:
            return 0.0
        ratio, ranks = self.ratios.__getitem__, self.ranks_of
        n, total = len(words), sum(map(ratio, words))
        if n < len(own_tokens):
            runs = "".join([t for t, _ in own_tokens if ranks[t] == NO_WORD]) if n else "".join([t for t, _ in own_tokens])
            n += len(runs)
            total += sum(map(ratio, runs))
        return total / n if n else 0.0

    def _ratio(self, word: str) -> float:
        share = self.n_marks / self.n_words
        a = word_slots(shape(word))[0]  # furniture is counted among the words, too
        return math.log((int(self.marks[a]) + share) / (int(self.words[0, a]) + 1.0) / share)


def _either(a: float, b: float) -> float:
    """The logarithm of the sum of two chances that are given by theirs."""
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def variants(word: str) -> list[str]:
    """All readings of a word with one confusion undone."""
    out = []
    if len(word) > LONGEST:
        return out
    for i, c in enumerate(word):
        out += [word[:i] + to + word[i + 1 :] for to in BY_SHAPE.get(c, ())]
        if word[i : i + 2] in PAIRS:
            out.append(word[:i] + PAIRS[word[i : i + 2]] + word[i + 2 :])
    return out


def han_gains(model: Model, text: str) -> list[tuple[int, str, float]]:
    """(place, character, gain) of every ideograph of a stream that may stand for another."""
    padded, han = "  " + shape(text) + "  ", model.han_of
    found = [(i, to, gain) for m in HAN.finditer(text) for i in (m.start(),) for to, gain in han[padded[i : i + 5]]]
    for a in re.finditer("帐长", text):
        i, to = a.start(), PAIRS["帐长"]
        before, after = shape(text[max(0, i - 2) : i]), shape(text[i + 2 : i + 4])
        found.append((i, to, model.letters(before + "帐长" + after) - model.letters(before + to + after)))
    return found


class Stream:
    """Lines put end to end, as tokens with the blanks after them. `first`: the first token of each line that has any, `numbers`: which lines these are, `ends`: what follows the last token of each, a line end, or a hyphen and a line end."""

    def __init__(self, lines: list[list[tuple[str, str]]]):
        self.tokens: list[tuple[str, str]] = []
        self.first: list[int] = []
        self.numbers: list[int] = []
        self.ends: dict[int, str] = {}
        for k, line in enumerate(lines):
            if not line:
                continue
            self.first.append(len(self.tokens))
            self.numbers.append(k)
            cut = len(line) > 1 and k + 1 < len(lines) and line[-1][0] in "-‐‑¬­" and not line[-2][1]
            self.tokens += line[:-1] if cut else line
            self.ends[len(self.tokens) - 1] = "-\n" if cut else "\n"


def is_word(token: str) -> bool:
    return token[0].isalpha() and token[0] < "ɐ"


def decode(lines: list[list[tuple[str, str]]], prices: list[float], model: Model) -> tuple[list[tuple[int, int, int, int, str, str]], float]:
    """The cheapest path over a stream of lines, each given by its tokens. `prices`: what undoing a confusion costs in each line.

    Edges other than a token as it is: (kind, token, tokens, line, was, becomes), kind of `confusion`, `merge`, `split`, `cut`, `hyphen`; and what the path costs beyond the tokens as they are.

    Costs are counted from those of the tokens as they are, so that an edge counts only if it is cheaper than its tokens, and between the tokens that may have one (those that aren't known,
    the ones before them, and those that a hyphen cuts) the path goes straight on.
    """
    s = Stream(lines)
    n, costs, seen, ranks = len(s.tokens), model.costs_of, model.counts_of, model.ranks_of
    rare = [k for k, (t, _) in enumerate(s.tokens) if ranks[t] < KNOWN]
    able = sorted({*rare, *(k - 1 for k in rare if k), *(k for k, after in s.ends.items() if after == "-\n")})
    waiting: dict[int, tuple[float, int, tuple]] = {}
    taken: list[tuple[int, int, tuple]] = []
    cost, settled = 0.0, 0

    def as_it_is(k: int) -> float:
        token = s.tokens[k][0]
        return (costs[token][1] if is_wide(token) else 1.0) + (KEPT_HYPHEN if s.ends.get(k) == "-\n" else 0.0)

    def edge(b: int, more: float, what: tuple) -> None:
        if more < 0 and (b not in waiting or cost + more < waiting[b][0]):
            waiting[b] = cost + more, what[1], what

    for k in [*able, n]:
        for b in range(settled + 1, min(settled + 2, k) + 1):
            if b in waiting:
                other, a, what = waiting.pop(b)
                if other < cost:
                    cost = other
                    taken.append((b, a, what))
        settled = k
        if k == n:
            break
        token, blanks = s.tokens[k]
        if not is_wide(token):
            continue
        after, count, own = s.ends.get(k) or blanks, seen[token], as_it_is(k)
        line = s.numbers[bisect_right(s.first, k) - 1]
        if count < KNOWN:
            _, v, least = model.readings(token)
            edge(k + 1, least + prices[line] - own, ("confusion", k, 1, line, token, v))
            if is_word(token):
                for i in range(max(2, len(token) - LONGEST), min(len(token) - 1, LONGEST + 1)):
                    if seen[token[:i]] >= KNOWN and seen[token[i:]] >= KNOWN:
                        edge(k + 1, costs[token[:i]][1] + costs[token[i:]][1] + SPLIT - own, ("split", k, 1, line, token, token[:i] + " " + token[i:]))
        if after and k + 1 < n and is_word(token) and is_word(s.tokens[k + 1][0]):
            following = s.tokens[k + 1][0]
            joined = token + following
            if after == "-\n":
                if token[-1].islower() and following[0].islower():
                    own += as_it_is(k + 1)
                    nj, cj = costs[joined]
                    edge(k + 2, cj + HYPHEN - own, ("hyphen", k, 2, line, token, joined))
                    if nj < KNOWN:
                        _, v, least = model.readings(joined)
                        edge(k + 2, least + HYPHEN + prices[line] - own, ("hyphen", k, 2, line, token, v))
            elif (count < KNOWN or seen[following] < KNOWN) and following[0].islower():
                if seen[joined] >= KNOWN:
                    inner = s.ends.get(k) is None
                    edge(k + 2, costs[joined][1] + (MERGE if inner else CUT) - own - as_it_is(k + 1), ("merge" if inner else "cut", k, 2, line, token, joined))
    path, at = [], n
    for b, a, what in reversed(taken):
        if b <= at:
            path.append(what)
            at = a
    return path[::-1], cost
