"""Sentence boundaries across languages and scripts.

Every place where a sentence may end carries a hidden event, boundary or none. A hidden-event n-gram
model scores the event with the token to its left, the class of the token to its right and the event
before it; forward-backward posteriors over each line decide. Places in scripts without marks (spaces
of Thai) are events like the others, and in a line of LONG words without any mark every place between two
words is one: its odds are those of a boundary anywhere, times how much likelier the word before it ends a
sentence and the word after it begins one than words do (characters stand for words in scripts without
spaces). The model starts from fixed rates for the classes below and learns from all texts, in one pass:
how much rarer a boundary is after each token than after others of its class, by what follows the token
anywhere (an abbreviation that no list has is often seen before lower case), how events follow each other,
and which words begin and end the sentences that marks and line breaks show. Tokens and words are counted in
BINS bins, whatever the corpus.

Defined results: null and blank texts have no sentence; repeated rows give their spans once; a line
break always ends a sentence; texts of any length are processed whole.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.functions.fold import make_fold
from attestia.session import written

BINS = 1 << 18
#: Words of a line from which a missing mark is looked for, and words that lie between two such boundaries.
LONG, APART = 16, 3
#: Weight of a class against the counts of one token, and share of texts that break the rules of writing.
PRIOR, NOISE = 4.0, 0.02
#: What follows a token where no sentence ends.
CONTINUED = ("lower", "dash", "month")
# Tokens before a full stop that a sentence does not end on.
NEVER = set(
    "dr prof st mr mrs ms mme mlle sr sra srta dra don dña sen gen col capt lt sgt rev hon no nr nos fig figs vs ca approx incl e.g i.e cf al vol ch sec eq pp p pág págs art núm ej "
    "z b d h bzw evtl ggf inkl sog vgl abb str hr fr bd ед ул пр пл пер им г-н г-жа стр рис см гл д-р проф тов акад напр т κ κα δρ καθ σελ αρ π د أ م ص डॉ श्री प्रो डा नं".split()
)
# Abbreviations that may also end a sentence.
MAY = set("etc usw co inc ltd corp bros jr a.m p.m am pm a.d b.c u.s u.k u.n d.c д г гг др руб тыс млн млрд н.э κ.ά κλπ ч мин sq ft in lb oz yd mi cu op ibid".split())
_FOLD = make_fold()
NEVER, MAY = {_FOLD(w) for w in NEVER}, {_FOLD(w) for w in MAY}
# Words after a day's number in a date.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner jahrhundert".split())
SINGLE_END = {"д", "г", "гг", "др"}
END_ALWAYS = "。！？｡。፧።։।॥؟۔‽"
OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "‹": "›", '"': '"'}
TITLES, PARENS = "《〈", "（([【"
CLOSERS = "”“»」』》〉）)]】›\"’'"
_WORDS = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff][\u0e31-\u0e3a\u0e47-\u0e4e\u0eb1-\u0ebc\u0ec8-\u0ecd\u0f71-\u0f84\u102b-\u103e\u17b6-\u17d3]*|[^\\W_]+(?:['’][^\\W_]+)*")
LEFT = ["hard", "held", "stop", "never", "may", "initial", "number", "dots", "thai", "list"]
RIGHT = ["upper", "lower", "digit", "other", "end", "dash", "month"]

#: The Greek question mark is drawn like a semicolon and has a code point of its own as well.
GREEK = ";\u037e"
_MARK = re.compile(rf"[.!?…。！？｡፧።։।॥؟۔‽{GREEK}]+")
# What stands before a unit of one letter.
_COUNTED = re.compile(r"(?:\d|\b(?:sq|cu|square|cubic|one|two|three|four|five|six|seven|eight|nine|ten|twelve|hundred|thousand|million))[^\S\n]?\Z", re.I)
_THAI = re.compile("[฀-๿]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ0-9๐-๙]")


def right_class(text: str, at: int, end: int) -> str:
    while at < end and (text[at].isspace() or text[at] in "“„«「『《（([\"¿¡‘'"):
        at += 1
    if at >= end:
        return "end"
    ch, nxt = text[at], text[at + 1 : min(at + 2, end)]
    if ch in "—–" and (nxt in ("¿", "¡") or nxt.isupper()):
        return "upper"  # a line of dialogue
    if ch in "—–-,，、:：;；)）":
        return "dash"
    if ch.isdigit():
        return "digit"
    if ch.islower():
        # A name written like a brand, small letter first.
        return "upper" if nxt.isupper() else "lower"
    if ch.isupper():
        word = re.match(r"\w+", _FOLD(text[at : min(at + 30, end)]))
        return "month" if word and word.group().lower() in MONTHS else "upper"
    return "other"


def quotes(text: str, a: int, b: int) -> dict[int, tuple[int, str]]:
    """closing place -> (opening place, opener) of the matched pairs of one line."""
    out, stack = {}, []
    for i in range(a, b):
        ch = text[i]
        if ch == '"':
            if i > a and text[i - 1].isdigit() and not any(o == '"' for _, o in stack):
                continue  # inches
            if any(o == '"' for _, o in stack):
                while stack:
                    j, o = stack.pop()
                    if o == '"':
                        out[i] = (j, o)
                        break
            else:
                stack.append((i, ch))
        elif stack and ch in OPEN[stack[-1][1]] and stack[-1][1] != '"':
            out[i] = stack.pop()
        elif ch in OPEN:
            stack.append((i, ch))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] != '"' and ch in OPEN[stack[k][1]]:
                    out[i] = stack[k]
                    del stack[k:]
                    break
    return out


def word_bin(word: str) -> int:
    return zlib.crc32(_FOLD(word).lower().encode("utf-8", "surrogatepass")) % BINS


def bare_events(text: str, a: int, b: int) -> list[tuple[int, str, tuple[int, int], str]]:
    """(end, "bare", bins of the words around it, right class) of the places between words, for a line without marks."""
    words = list(_WORDS.finditer(text, a, b))
    if len(words) < LONG:
        return []
    cased = any(w.group()[0].isupper() for w in words[1:])
    out = []
    for n in range(APART, len(words) - APART + 1):
        w, v = words[n - 1], words[n]
        # Where a line has capitals, a sentence begins with one; a comma, hyphen or bracket in between ends none.
        if (cased and v.group()[0].islower()) or text[w.end() : v.start()].strip():
            continue
        out.append((w.end(), "bare", (word_bin(w.group()), word_bin(v.group())), "other"))
    return out


def events(text: str, a: int, b: int) -> list[tuple[int, str, int | tuple[int, int], str]]:
    """(end, left class, left bin, right class) of every place of the line text[a:b] where a sentence may end."""
    pairs = quotes(text, a, b)
    inside: list[tuple[int, int]] = sorted((j, i) for i, (j, _) in pairs.items())
    out, start, last = [], a, a

    def covering(at: int) -> list[tuple[int, int]]:
        return [(j, i) for j, i in inside if j < at <= i]

    marks = list(_MARK.finditer(text, a, b))
    if not marks and not _THAI.search(text, a, b):
        return bare_events(text, a, b)
    if _THAI.search(text, a, b):
        for m in re.finditer(r"\s+", text[a:b]):
            x, y = a + m.start(), a + m.end()
            if x > a and y < b and (_THAI.match(text[x - 1]) or text[x - 1] in ")）”»\"ๆฯ") and _THAI.match(text[y]) and not covering(x):
                out.append((x, "thai", 0, "other"))
    for m in marks:
        mark, end = m.group(), m.end()
        if m.start() < last:
            continue
        greek = mark[0] in GREEK
        if greek:
            before = re.search(r"\w(?=\W*$)", text[max(a, m.start() - 6) : m.start()])
            if not before or not ("Ͱ" <= before.group() <= "Ͽ" or "ἀ" <= before.group() <= "῿"):
                continue
        opened = covering(end)
        # Closing quotes and brackets belong to the sentence.
        while end < b and text[end] in CLOSERS and (end in pairs or text[end] in "’'"):
            end += 1
        if end < b and text[end] == " " and end + 1 < b and text[end + 1] in "»" and end + 1 in pairs:
            end += 2
        closed = [(j, i) for j, i in opened if i < end]
        if len(closed) < len(opened):
            continue  # still inside a quotation, title or bracket
        last = end
        nxt = text[end : end + 1]
        right = right_class(text, end, b)
        ascii_mark = mark[-1] in ".!?"
        if nxt and not nxt.isspace() and ascii_mark and not (ord(nxt) >= 0x2E80 or (mark[-1] != "." and ord(nxt) > 0x24F)) and not (closed and nxt in "—–"):
            if not (nxt in "“„«「《（(¿¡" and mark[-1] in "!?."):
                continue  # inside a number, address or abbreviation
        token = re.search(r"[^\s“„«「『《（(\[\"]*$", text[max(a, m.start() - 30) : m.start()]).group()
        word, token = m.start() - len(token), _FOLD(token)
        code = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BINS
        left = "hard"
        if closed:
            j = min(closed)[0]
            opener, lead = text[j], text[max(a, j - 2) : j].rstrip()[-1:]
            first = not text[max(start, a) : j].strip("“„«「『《（([\" \t-*•0123456789.)")
            if opener in TITLES:
                left = "held"
            elif opener in PARENS:
                left = "hard" if first else "held"
            elif lead in (":", "：", ",", "，") and not first:
                left = "hard" if right != "lower" and right != "dash" else "held"
            else:
                left = "held" if first or ord(nxt or " ") >= 0x2E80 or right in ("lower", "dash") else "hard"
                if first and right in ("upper", "end") and nxt != "," and mark[-1] == ".":
                    left = "hard"
                if right == "end":
                    left = "hard"
        elif right in ("lower", "dash") and ascii_mark and mark[-1] in "!?":
            left = "held"
        elif "…" in mark or mark.startswith(".."):
            left = "dots" if not (mark[0] == "…" and ord(nxt or " ") >= 0x2E80) else "held"
            if right in ("lower", "dash"):
                left = "held"
        elif mark == ".":
            low = token.lower().strip("'’")
            head = not text[a:word].strip(" \t-*•(")
            if token.isdigit():
                left = "list" if head or not text[start:word].strip() else "number"
            elif len(token) == 1 and token.isalpha() and _COUNTED.search(text, max(a, word - 12), word):
                left = "may"  # a unit after its number
            elif low in NEVER or (len(low) == 1 and low.isalpha() and low not in SINGLE_END):
                left = "initial" if len(token) == 1 and token.isupper() else "never"
            elif low in MAY:
                left = "may"
            elif re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", token):
                left = "may"
            else:
                left = "stop"
        out.append((end, left, code, right))
        if left in ("hard",) or (left == "stop" and right in ("upper", "other", "end")) or (left in ("number", "may", "dots") and right in ("upper", "other", "end")):
            start = end
    return sorted(out)


# P(boundary | left class, right class), the model's start.
def seeds() -> dict[tuple[str, str], float]:
    table = {}
    for left in LEFT:
        for right in RIGHT:
            p = {"hard": 0.999, "held": 0.002, "never": 0.005, "initial": 0.01, "list": 0.001, "thai": 0.99}.get(left)
            if p is None:
                p = {"upper": 0.97, "other": 0.96, "digit": 0.9, "end": 0.999, "lower": 0.02, "dash": 0.05, "month": 0.02}[right]
                if left == "may":
                    p = {"upper": 0.9, "other": 0.8, "digit": 0.6, "end": 0.99}.get(right, 0.02)
                if left == "number" and right == "digit":
                    p = 0.6
            if right == "end":
                p = 0.999
            table[left, right] = p
    return table


def odds(p: float) -> float:
    return p / (1 - p)


class EventModel:
    """P(event | left class, token, right class), and how much likelier an event is after the event before.

    *ratios*: (left class, bin) -> odds of a boundary after the token against its class; *step*: (event
    before, event) -> its rate against the event's rate anywhere; *words*: (rate of a boundary after a word, by bin how
    much likelier than that a word ends a sentence, and begins one).
    """

    def __init__(self, ratios: dict[tuple[str, int], float] | None = None, step: dict[tuple[int, int], float] | None = None, words: tuple[float, np.ndarray, np.ndarray] | None = None):
        self.start, self.ratios, self.words = seeds(), ratios or {}, words
        self.step = step or {(s, t): 1.0 for s in (0, 1) for t in (0, 1)}

    def emit(self, left: str, code: int | tuple[int, int], right: str) -> float:
        if left == "bare":
            if self.words is None:
                return 0.0
            rate, ends, starts = self.words
            return (x := odds(rate) * float(ends[code[0]]) * float(starts[code[1]])) / (1 + x)
        p = self.start[left, right]
        ratio = self.ratios.get((left, code)) if right != "end" else None
        return p if ratio is None else (x := odds(p) * ratio) / (1 + x)

    @staticmethod
    def learn(totals: dict[tuple[str, str], float], tokens: dict[tuple[str, int], dict[str, float]], pairs: dict[tuple[int, int], float], words: np.ndarray | None = None) -> EventModel:
        """From counts by (left, right) of all tokens, by right class of single ones, expected pairs of neighbouring events,
        and *words*: by bin how often a word occurs, ends and begins a sentence."""
        start, ratios = seeds(), {}
        for left in ("stop", "may"):
            seen = {r: n for (x, r), n in totals.items() if x == left and r != "end"}
            if not sum(seen.values()):
                continue
            rate = (PRIOR + sum(n * start[left, r] for r, n in seen.items())) / (2 * PRIOR + sum(seen.values()))
            for (x, code), counts in tokens.items():
                if x != left:
                    continue
                counts, ratio = {r: n for r, n in counts.items() if n and r != "end"}, 1.0
                for _ in range(20):
                    b = sum(n * (y := odds(start[left, r]) * ratio) / (1 + y) for r, n in counts.items())
                    p = (b + PRIOR * rate) / (sum(counts.values()) + PRIOR)
                    ratio = odds(NOISE + (1 - 2 * NOISE) * p) / odds(NOISE + (1 - 2 * NOISE) * rate)
                ratios[left, code] = round(ratio, 6)
        whole = sum(pairs.values()) + 4 * PRIOR
        side = lambda i, x: (sum(n for k, n in pairs.items() if k[i] == x) + 2 * PRIOR) / whole
        # Few pairs leave the events of a line independent.
        p = {(s, t): (pairs.get((s, t), 0.0) + 4 * PRIOR * side(0, s) * side(1, t)) / whole for s in (0, 1) for t in (0, 1)}
        step = {(s, t): round(p[s, t] / ((p[s, 0] + p[s, 1]) * (p[0, t] + p[1, t])), 6) for s, t in p}
        if words is None or not words[1].sum():
            return EventModel(ratios, step)
        rate = float(words[1].sum() / words[0].sum())
        likelier = lambda n: ((n + PRIOR * rate) / (words[0] + PRIOR) / rate).astype(np.float32)
        return EventModel(ratios, step, (min(rate, 0.5), likelier(words[1]), likelier(words[2])))

    def posteriors(self, places: list[tuple[int, str, int, str]]) -> list[float]:
        if not places:
            return []
        e = [self.emit(*p[1:]) for p in places]
        # How marks follow each other says nothing about places between words.
        step = {k: 1.0 for k in self.step} if places[0][1] == "bare" else self.step
        alpha, prev = [], None
        for p in e:
            now = [1 - p, p] if prev is None else [(1 - p) * sum(prev[s] * step[s, 0] for s in (0, 1)), p * sum(prev[s] * step[s, 1] for s in (0, 1))]
            z = sum(now)
            prev = (now[0] / z, now[1] / z)
            alpha.append(prev)
        beta, out = (1.0, 1.0), [0.0] * len(e)
        for k in range(len(e) - 1, -1, -1):
            w = [alpha[k][s] * beta[s] for s in (0, 1)]
            out[k] = w[1] / sum(w)
            beta = tuple(step[s, 0] * (1 - e[k]) * beta[0] + step[s, 1] * e[k] * beta[1] for s in (0, 1))
        return out


def lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for part in re.split("([\n\r\x0b\x0c\x85  ])", text):
        if part and part not in "\n\r\x0b\x0c\x85  " and part.strip():
            yield at, at + len(part)
        at += len(part)


def spans(text: str, model: EventModel) -> list[tuple[int, int]]:
    """Code-point spans of the sentences of *text*."""
    out = []
    for a, b in lines(text):
        places = events(text, a, b)
        cuts = [p[0] for p, x in zip(places, model.posteriors(places)) if x > 0.5]
        at = a
        for cut in [*cuts, b]:
            x, y = at, cut
            while x < y and text[x].isspace():
                x += 1
            while y > x and text[y - 1].isspace():
                y -= 1
            if x < y:
                if out and out[-1][0] >= a and not any(c.isalnum() for c in text[x:y]):
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
            at = cut
    return out


def _expect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bin, left and right class; bin -1 is all tokens, bin -2 expected pairs of neighbouring events."""
    model = EventModel()
    for part in parts:
        total: dict[tuple[int, str, str], float] = {}
        counts = {"w": Counter(), "e": Counter(), "s": Counter()}
        for text in part.column(0).to_pylist():
            text = text.strip()
            for a, b in lines(text):
                before, places = None, events(text, a, b)
                at = a
                for cut in [*(p[0] for p in places if model.emit(*p[1:]) > 0.5), b] if _MARK.search(text, a, b) else []:
                    found = _WORDS.findall(text[at:cut])
                    counts["w"].update(found)
                    if found:
                        counts["s"][found[0]] += 1
                        counts["e"][found[-1]] += 1
                    at = cut
                for _, left, code, right in places:
                    if left in ("stop", "may"):
                        for k in ((code, left, right), (-1, left, right)):
                            total[k] = total.get(k, 0.0) + 1
                    p = model.emit(left, code, right)
                    if before is not None:
                        for k, n in (("00", (1 - before) * (1 - p)), ("01", (1 - before) * p), ("10", before * (1 - p)), ("11", before * p)):
                            total[-2, "", k] = total.get((-2, "", k), 0.0) + n
                    before = p
        for kind, some in counts.items():
            for word, n in some.items():
                k = (word_bin(word), kind, "word")
                total[k] = total.get(k, 0.0) + n
        cols = list(zip(*((*k, n) for k, n in total.items()))) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["code", "left", "right", "n"])


def train(texts: DataFrame, text: str) -> EventModel:
    """The model learnt from all texts; at most 3 x BINS word counts and 2 x BINS token bins reach the driver."""
    found = texts.select(text).filter(F.col(text).isNotNull()).mapInArrow(_expect, "code int, left string, right string, n double").groupBy("code", "left", "right").agg(F.sum("n").alias("n"))
    found = written(found, "events")
    by_word = found.filter("right = 'word'").groupBy("left", "code").agg(F.sum("n").cast("float").alias("n")).toArrow()
    words = np.zeros((3, BINS))
    for row, kind in enumerate("wes"):
        some = by_word.filter(pc.equal(by_word.column("left"), kind))
        words[row, some.column("code").to_numpy()] = some.column("n").to_numpy()
    rows = found.filter("right <> 'word'").groupBy("code", "left").agg(F.map_from_entries(F.collect_list(F.struct("right", "n"))).alias("counts")).filter((F.col("code") < 0) | F.arrays_overlap(F.map_keys("counts"), F.lit(list(CONTINUED)))).collect()
    totals = {(r["left"], k): n for r in rows if r["code"] == -1 for k, n in r["counts"].items()}
    pairs = {(int(k[0]), int(k[1])): round(n, 3) for r in rows if r["code"] == -2 for k, n in r["counts"].items()}
    return EventModel.learn(totals, {(r["left"], r["code"]): r["counts"] for r in rows if r["code"] >= 0}, pairs, words)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, char_start, char_end): the sentences of every text without its outer white space."""
    learnt = train(df, text)
    shipped = df.sparkSession.sparkContext.broadcast((learnt.ratios, learnt.step, learnt.words))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = EventModel(*shipped.value)
        for part in parts:
            keys, starts, ends = [], [], []
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for a, b in spans(t.strip(), model):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "char_start", "char_end"])

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, char_start bigint, char_end bigint").distinct()
