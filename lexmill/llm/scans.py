"""Problem 4: texts of scanned pages repaired into continuous paragraphs, and which of them had which defect.

Method. Page furniture goes first: each line's evidence is added up (does it come again, letter for letter but for misread shapes; does it stand at a page's edge;
do the lines around it go on without it; is it made of what furniture is made of elsewhere), and so is that of numbers alone on a line. What remains is one stream of characters, in which
words are segmented jointly (lexmill.llm.lattice): splits, merges, confusions, hyphens and line ends are edges of one lattice, and the cheapest path is the reading.
A file is hyphenated where that path takes a hyphen out of a word. It is misread where, over all lines, the chance that none has a wrong character is below
one half; a line's chance comes from its confidence, its second reading and all alternatives that the lattice has for it.
Paragraphs are then chosen by dynamic programming over the line ends: a boundary costs little after a full stop with a blank line
or a short line, much in mid-sentence, and more right after another one.

A wrong digit that only its line's confidence betrays is found, but left as it is: nothing says which digit the page has.

The counts behind the model have a fixed size. They are summed in the tasks, then over FAN groups of tasks, then over those.

Defined cases: only texts whose engine is `local:` or `cloud:` are scans; null, empty and blank texts have no defect; a result delivered twice counts once, and
of several second readings the least text counts; confidences that are null, or not as many as lines, are no evidence; of a second reading of another number of lines
only its count of mismatched numbers is: where it is 0, no digit is taken for a wrong one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.lattice import BY_SHAPE, HAN, KNOWN, PAIRS, PUNCTUATION, SIZE, Counts, Letters, Model, decode, han_gains, same_but_marks, tokens

NUMBER = r"[0-9lIOoZSB〇|]{1,4}"
PAGE = re.compile(
    rf"[—–\-·•\[(（]\s*{NUMBER}\s*[—–\-·•\])）]|第\s*{NUMBER}\s*页(?:\s*[，,/]?\s*共\s*{NUMBER}\s*页)?|{NUMBER}\s*/\s*{NUMBER}|(?i:p\.|pp\.|s\.|pág\.|page|seite|página|pagina|folio)\s*{NUMBER}(?:\s*(?:of|von|sur|de|/)\s*{NUMBER})?"
)
#: What the last letter of a page number may be.
PAGE_END = frozenset("0123456789lIOoZSB〇|—–-·•])）页")
BARE = re.compile(r"\d{1,4}")
TAIL = re.compile(rf"(?<!\s)\s{{2,}}+({NUMBER})$")
TAIL_END = frozenset("0123456789lIOoZSB〇|")
DIGITS = str.maketrans("lI|OoZSB〇", "111002580")
FULL_STOP, CLOSING = frozenset("。！？.!?:：；;"), "”’\"»」』）)"
MARKED = re.compile(r"[|#>*\-]|\d+[.、)]|第.{1,4}条")
EDGE = " \t\r﻿"
#: Below this confidence a line isn't counted for the model.
LOW = 0.87
#: Groups of tasks whose counts are added up first.
FAN, WIDTH = 1024, 8192


def _classes() -> dict[str, str]:
    """One letter for all that may be taken for each other, where two different digits never get the same."""
    groups: dict[str, set[str]] = {}
    for a, others in BY_SHAPE.items():
        for b in others:
            if len(a) == len(b) == 1:
                both = groups.get(a.lower(), {a.lower()}) | groups.get(b.lower(), {b.lower()})
                if sum(c.isdigit() and c != "〇" for c in both) < 2:
                    for c in both:
                        groups[c] = both
    return {c: min(g) for c, g in groups.items()}


CLASS = _classes()


FOLD = Letters(str.maketrans(CLASS | dict.fromkeys(" \t\u00a0\u3000")))


def key_of(line: str) -> str:
    """A line up to case, blanks, misread shapes and a number set off at its end; its other digits count."""
    if line[-1:] in TAIL_END:
        line = TAIL.sub("", line)
    for a, b in PAIRS.items():
        if a in line:
            line = line.replace(a, b)
    return line.lower().translate(FOLD)


def stops(line: str) -> bool:
    """Whether a line ends with a full stop, or with closing marks after one."""
    return line.rstrip(CLOSING)[-1:] in FULL_STOP


def width_of(lines: list[str]) -> float:
    """The length that four fifths of the lines don't exceed (as numpy's percentile has it)."""
    sizes = sorted(map(len, lines))
    place = (len(sizes) - 1) * 0.8
    k = int(place)
    a, b, part = sizes[k], sizes[min(k + 1, len(sizes) - 1)], place - k
    return float(b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part)


class Page:
    """The lines of one scan, sorted into furniture and body."""

    def __init__(self, text: str, confidences: list | None, second: str | None, model: Model, mismatches: int | None = None):
        self.lines = [x.strip(EDGE) for x in text.split("\n")]
        self.full = [i for i, x in enumerate(self.lines) if x.strip()]
        self.confidence: dict[int, float] = {i: c for i, c in zip(self.full, confidences) if c is not None} if confidences and len(confidences) == len(self.full) else {}
        other = second.split("\n") if second else []
        self.second: dict[int, str] = {i: other[i].strip(EDGE) for i in self.full} if len(other) == len(self.lines) else {}
        self.digits_agree = not self.second and mismatches == 0
        self.model, self.known = model, None
        self.split = {i: tokens(self.lines[i]) for i in self.full} if model.n_marks or model.n_letters else {}
        self.words = {i: model.words_in(own) for i, own in self.split.items()}
        self.numbers = self._page_numbers()
        self.headers = self._running_headers()
        tails = [int(m.group(1).translate(DIGITS)) for i in sorted(self.headers) if (m := TAIL.search(self.lines[i]))]
        self.numbered = len(set(tails)) > 1 or len(tails) == 1 and len(self.headers) == 1
        self.body = [i for i in self.full if i not in self.numbers and i not in self.headers]

    def _page_numbers(self) -> set[int]:
        """Lines of a number and little else, by the sum of what speaks for and against."""
        lines, full = self.lines, self.full
        bare = {i for i in full if len(lines[i]) <= 4 and BARE.fullmatch(lines[i])}
        found, run = set(), {}
        alone = [i for k, i in enumerate(full) if i in bare and not ({*full[max(0, k - 1) : k], *full[k + 1 : k + 2]} & bare)]
        start = 0
        for k in range(1, len(alone) + 1):  # how long the runs are that rise by one
            if k == len(alone) or int(lines[alone[k]]) != int(lines[alone[k - 1]]) + 1:
                run |= {i: k - start for i in alone[start:k]}
                start = k
        for k, i in enumerate(full):
            form = lines[i][-1] in PAGE_END and bool(PAGE.fullmatch(lines[i]))
            if i not in bare and not form:
                continue
            score = -1.5 + 3.0 * form + 3.0 * (run.get(i, 0) > 1)
            score += 2.0 * (k in (0, len(full) - 1)) + 2.0 * (k > 0 and self._open(full[k - 1]))
            score -= 4.0 * (i in bare and i not in run)
            if score > 0:
                found.add(i)
        longest = max((run[i] for i in run), default=0)
        return {i for i in found if i not in bare or run.get(i, 0) == longest}  # one numbering, not several

    def _open(self, i: int) -> bool:
        """Whether a line is one of running text that goes on after it."""
        return not stops(self.lines[i]) and not self.lines[i].startswith("|") and len(self.lines[i]) > 12

    def _seam(self, a: str, b: str) -> float:
        """Surprise where one line goes on with another."""
        between = " " if a[-1:] < "ɐ" and b[:1] < "ɐ" else ""
        return self.model.seam(a[-2:] + between + b[:2])

    def _running_headers(self) -> set[int]:
        lines = self.lines
        rest = [i for i in self.full if i not in self.numbers]
        if len(rest) < 2:
            return set()
        width = width_of([lines[i] for i in rest])
        able = [i for i in rest if 6 <= len(lines[i]) <= 1.3 * width + 10]
        start = {i: CLASS.get(c := lines[i][0].lower(), c) for i in able}
        many = Counter(start.values())
        keys = {i: key_of(lines[i]) if many[start[i]] > 1 else lines[i] for i in able}  # a line that starts as no other comes once
        by_key: dict[str, list[int]] = {}
        for i, key in keys.items():
            by_key.setdefault(key, []).append(i)
        order = sorted(by_key)
        again = {i: len(own) - 1 for own in by_key.values() for i in own}
        for a, b in zip(order, order[1:]):  # the same with something after it
            if len(a) >= 8 and b.startswith(a):
                for i in by_key[a] + by_key[b]:
                    again[i] += len(by_key[b] if keys[i] == a else by_key[a])
        scores = {}
        more = 4.5 if self.split else 0.0
        for k, i in enumerate(rest):
            if i not in keys or not more and not again[i]:
                continue
            line = lines[i]
            edge = k in (0, len(rest) - 1) or i - 1 in self.numbers or i + 1 in self.numbers or not lines[i - 1].strip() and self._open(rest[k - 1])
            if not again[i] and 2.0 * edge + more <= 4.0:  # nothing can make it one
                continue
            score = -4.0 + 3.0 * (again[i] > 0) + 1.0 * (again[i] > 1) + 2.0 * edge - 4.0 * stops(line) - 4.0 * bool(MARKED.match(line))
            if score > -4.5 and self.split:  # what is left can add 3 and 1.5
                score += min(3.0, max(-3.0, 2.0 * self.model.furniture(self.split[i], self.words[i])))
            if score > -1.5 and 0 < k < len(rest) - 1 and self.model.n_letters:
                a, b = lines[rest[k - 1]], lines[rest[k + 1]]
                score += min(1.5, max(-1.5, (self._seam(a, line) + self._seam(line, b) - 2 * self._seam(a, b)) / 4))
            scores[i] = score
        found = {i for i, score in scores.items() if score > 0}
        # copies of one line are judged together, and a header that stands first of all is one only if it, or another, comes again
        for own in by_key.values():
            if len(own) > 1 and found & set(own):
                found = found | set(own) if sum(scores[i] for i in own) > 0 else found - set(own)
        return found if found - {rest[0]} else set()

    # --- misread characters

    def odds(self, i: int, words: list[str], han: dict[int, list[tuple[int, str, float]]]) -> tuple[float, float]:
        """Log-odds that a line (with these words) has a character that its page doesn't have, and the price of undoing a confusion in it. `han`: gains of ideographs by line."""
        model, line, other = self.model, self.lines[i], self.second.get(i)
        prior = model.odds(self.confidence.get(i))
        if other is not None:
            if same_but_marks(line, other):
                return -12.0, 16.0
            # one of the two is wrong
            return prior + math.log((1 - model.slips) / model.slips) + model.line(line) - model.line(other), 16.0
        gains = [g for _, _, g in han.get(i, ())]
        sites = len(gains)
        ranks, places, readings = model.ranks_of, model.places_of, model.gains_of
        for token in words:
            if prior < -4.0 and ranks[token] >= KNOWN:  # a word that is well known gains nothing worth so small a chance
                sites += places[token]
                continue
            own = readings[token][0]
            if self.digits_agree and own:
                own = [] if any(c.isdigit() for c in token) else [(v, g) for v, g in own if not any(c.isdigit() for c in v)]
            sites += len(own)
            gains += [g for _, g in own if g > -math.inf]
        if not sites:
            return prior - 4.0, 16.0
        most = max(gains, default=0.0)
        mean = most + math.log(sum([math.exp(g - most) for g in gains])) - math.log(sites) if gains else -12.0
        return prior + mean, max(0.5, math.log(sites) - prior)

    def read(self) -> tuple[list[str], float, list, dict[int, str]]:
        """Defects but for furniture, with the chance that a line is misread, the path, and the lines as they should be."""
        if self.known:
            return self.known
        body, han = self.body, self._han_gains()
        chance, prices, made = 1.0, {}, {}
        split = self.split or {i: tokens(self.lines[i]) for i in self.full}
        for i in self.full:
            odds, prices[i] = self.odds(i, self.words[i] if self.words else self.model.words_in(split[i]), han)
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, odds))))
            chance *= 1 - p
            made[i] = self.lines[i]
            if odds > 0 and i in self.second:
                made[i] = self._aligned(i)
                split[i] = tokens(made[i])
            elif odds > 0:
                for place, to, gain in sorted(han.get(i, ()), key=lambda x: -x[2]):
                    was = self._around(i, place)
                    if gain > max(1.0, prices[i]) and made[i].count(was) == 1:
                        made[i] = made[i].replace(was, was[0] + to + was[-1] if len(was) == 3 else to)
                split[i] = tokens(made[i])
        path, _ = decode([split[i] for i in body], [prices[i] for i in body], self.model)
        self.known = path, 1 - chance, body, made
        return self.known

    def _han_gains(self) -> dict[int, list[tuple[int, str, float]]]:
        """Gains of ideographs in the stream, by line; each with its place in the line."""
        out: dict[int, list[tuple[int, str, float]]] = {}
        for part in (self.body, [i for i in self.full if i in self.headers]):
            text = "".join([self.lines[i] for i in part])
            if not HAN.search(text) and "帐长" not in text:
                continue
            starts = [0, *accumulate([len(self.lines[i]) for i in part])]
            for place, to, gain in han_gains(self.model, text):
                k = bisect_right(starts, place) - 1
                i = part[k]
                if to != PAIRS["帐长"] or HAN.search(self.lines[i]) or "帐长" in self.lines[i]:
                    out.setdefault(i, []).append((place - starts[k], to, gain))
        return out

    def _around(self, i: int, p: int) -> str:
        """The piece of a line around one of its ideographs."""
        line = self.lines[i]
        if line[p : p + 2] in PAIRS:
            return line[p : p + 2]
        return line[p - 1 : p + 2] if 0 < p < len(line) - 1 else line[p]

    def _aligned(self, i: int) -> str:
        """The second reading of a line, with the line's own punctuation where both are as long."""
        line, other = self.lines[i], self.second[i]
        if len(line) != len(other):
            return other
        return "".join(a if a.translate(PUNCTUATION) == b.translate(PUNCTUATION) else b for a, b in zip(line, other))


def defects(page: Page) -> list[str]:
    path, chance, _, _ = page.read()
    found = ["hyphenation"] if any(what[0] == "hyphen" for what in path) else []
    if chance > 0.5:
        found.append("misread")
    if page.headers:
        found.append("running_header")
    if page.numbers or page.numbered:
        found.append("page_number")
    return found


def paragraphs(page: Page) -> str:
    """The body as continuous paragraphs, in the words of the cheapest path."""
    path, _, body, made = page.read()
    if not body:
        return ""
    lines = [made[i] for i in body]
    joined: set[int] = set()  # line ends at which a word goes on
    for kind, _, _, k, was, becomes in path:
        line = lines[k]
        if kind in ("hyphen", "cut"):
            joined.add(k)
            head = re.match(r"(?:[^\W\d_]|!(?=[a-zà-ÿ])|[0-9|](?=[a-zà-ÿ]))+", lines[k + 1])
            rest = lines[k + 1][len(head.group()) :] if head else lines[k + 1]
            at = line.rfind(was)
            lines[k], lines[k + 1] = line[:at] + becomes, rest
        elif kind == "merge":
            left, right = was, becomes[len(was) :]
            lines[k] = re.sub(rf"(?<![^\W_]){re.escape(left)}[ \t ]+{re.escape(right)}(?![^\W_])", lambda _: becomes, line, count=1)
        else:
            lines[k] = re.sub(rf"(?<![^\W_]){re.escape(was)}(?![^\W_])", lambda _: becomes, line, count=1)
    ends = _boundaries(page, lines, joined)
    out, text = [], lines[0]
    for k in range(1, len(lines)):
        a, b = text, lines[k]
        if k - 1 in joined:
            text += b
        elif k - 1 in ends:
            out.append(text)
            text = b
        elif a.startswith("|") or b.startswith("|") or BARE.fullmatch(lines[k - 1]) or BARE.fullmatch(b):
            text += "\n" + b
        else:
            number = re.search(r"\d[.,]?$", a) and b[:1].isdigit() or re.search(r"\d$", a) and re.match(r"[.,]\d", b)
            code = a.endswith("-") and b[:1].isdigit() or re.search(r"[A-Z]{2}$", a) and re.match(r"-\d", b)
            latin = not number and not code and a[-1:] < "ɐ" and b[:1] < "ɐ" and not b[:1] in ",.;:)!?%" and a[-1:] != "("
            text += (" " if latin else "") + b
    out.append(text)
    return "\n\n".join(t for t in out if t.strip())


def _boundaries(page: Page, lines: list[str], joined: set[int]) -> set[int]:
    """The line ends at which a paragraph ends: the cheapest sequence of ends and goings-on, where an end right after another costs more."""
    body = page.body
    width = width_of(lines)
    best, back = (0.0, 1.5), []  # costs with a paragraph going on, and with one that has just ended
    for k, (i, j) in enumerate(zip(body, body[1:])):
        stop, blank, short = stops(lines[k]), any(not page.lines[x].strip() for x in range(i + 1, j)), len(lines[k]) < 0.75 * width
        marked = bool(MARKED.match(lines[k + 1])) or lines[k].startswith(("|", "#"))
        table = lines[k].startswith("|") and lines[k + 1].startswith("|")
        cut = (0.5 if stop else 5.0) + (0.0 if blank else 1.5) - (2.0 if marked else 0.0) - (3.0 if short and blank else 0.0) + (20.0 if k in joined or table else 0.0) + 0.5
        keep = (2.0 if stop and blank else 0.0) + (2.0 if short else 0.0) + (4.0 if marked and not table else 0.0)
        again = 0.0 if marked or short else 1.0  # a paragraph of one full line
        on = min((best[0], 0), (best[1], 1))
        end = min((best[0], 0), (best[1] + again, 1))
        back.append((on[1], end[1]))
        best = (on[0] + keep, end[0] + cut)
    ends, state = set(), 0 if best[0] <= best[1] else 1
    for k in range(len(back) - 1, -1, -1):
        if state:
            ends.add(k)
        state = back[k][state]
    return ends


# --- Spark


def is_scan(engine):
    return engine.startswith("local:") | engine.startswith("cloud:")


def _with_second(results: DataFrame, cross_checks: DataFrame) -> DataFrame:
    """Each result with text once, with what is known of its second reading."""
    second = cross_checks.groupBy("result_id").agg(F.min("second_text").alias("second_text"), F.max("digit_mismatches").alias("digit_mismatches"))
    some = results.filter(F.length(F.trim("text")) > 0).select("result_id", "engine", "text", "confidences").dropDuplicates(["result_id"])
    return some.join(second, "result_id", "left").select("result_id", F.coalesce(is_scan(F.col("engine")), F.lit(False)).alias("scan"), "text", "confidences", "second_text", "digit_mismatches")


def learn(rows: DataFrame) -> Model:
    """The model of all texts: what is counted in a task is added up over groups of tasks and then over the groups, in parts of fixed size."""

    def count(batches):
        counts, blind = Counts(), Model(np.zeros(SIZE, np.int64))
        for batch in batches:
            for scan, text, confidences, second in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if not scan:
                    counts.text([x for x in (x.strip(EDGE) for x in text.split("\n")) if x.strip()])
                    continue
                page = Page(text, None, None, blind)
                lines, full = page.lines, page.full
                sure = dict(zip(full, confidences)) if confidences and len(confidences) == len(full) else {}
                good = {i for i in full if (sure.get(i) or 1.0) >= LOW}
                for i in page.headers:
                    counts.furniture(lines[i])
                for part in (page.body, page.headers):
                    counts.text([lines[i] for i in part if i in good])
                other = second.split("\n") if second else []
                if sure and len(other) == len(lines):
                    for i, c in sure.items():
                        if c is not None:
                            counts.twice(c, not same_but_marks(lines[i], other[i].strip(EDGE)))
        counts.flush()
        parts = np.minimum(counts.all, 2**31 - 1).astype(np.int32).reshape(-1, WIDTH)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in used], pa.binary())})

    def add(group):
        import pandas as pd

        total = np.zeros(WIDTH, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x, np.int32)
        return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    schema = "part int, counts binary"
    counted = rows.select("result_id", "scan", "text", "confidences", "second_text").mapInArrow(count, schema)
    grouped = counted.withColumn("fan", F.spark_partition_id() % FAN).groupBy("part", "fan").applyInPandas(add, schema)
    total = np.zeros((SIZE // WIDTH, WIDTH), np.int64)
    for row in grouped.groupBy("part").applyInPandas(add, schema).collect():  # SIZE counts, whatever the number of texts
        total[row.part] = np.frombuffer(row.counts, np.int32)
    return Model(total.ravel())


def _run(results: DataFrame, cross_checks: DataFrame, schema: str, make) -> DataFrame:
    from lexmill.checkpoints import Stages

    rows = Stages(results.sparkSession, "scans").write("rows", _with_second(results, cross_checks))
    model = learn(rows)
    sent = rows.sparkSession.sparkContext.broadcast(np.concatenate([model.grams, model.words.ravel(), model.marks, model.bins.ravel()]).astype(np.int32))

    def run(batches):
        own = Model(sent.value)
        for batch in batches:
            out = []
            for key, text, confidences, other, mismatches in zip(*(c.to_pylist() for c in batch.columns)):
                out += make(key, Page(text, confidences, other, own, mismatches))
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema=arrow)

    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])
    return rows.filter("scan").select("result_id", "text", "confidences", "second_text", "digit_mismatches").mapInArrow(run, schema)


def find_defects(results: DataFrame, cross_checks: DataFrame) -> DataFrame:
    """result_id, defect: one row for each scan and defect."""
    return _run(results, cross_checks, "result_id bigint, defect string", lambda key, page: [(key, d) for d in defects(page)])


def repair(results: DataFrame, cross_checks: DataFrame) -> DataFrame:
    """result_id, repaired (continuous paragraphs) and defects of every scan with text."""
    return _run(results, cross_checks, "result_id bigint, repaired string, defects array<string>", lambda key, page: [(key, paragraphs(page), defects(page))])
