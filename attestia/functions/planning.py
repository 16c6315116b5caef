"""Search queries that don't presuppose the answer, and how far a text is about a topic. Pure Python, used in Arrow batches.

A claim gives at most three queries: its wording, the question behind it and that question in its narrowest context; a
compound claim spends them on its parts, a simple one gives its last query to original sources.
Defined results: a blank claim without anchors has no query; null texts count as empty.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from .atoms import atoms, slot_of
from .text import CJK_STOP, STOP, TERM

MOST_QUERIES, LONGEST = 3, 160
# Suffixes of the query for original sources, and topics that go to science sites.
SCIENCE = re.compile(r"声音|声速|真空|光速|太阳|地球|自转|公转|沸点|大气压|物理|化学|生物")
SCIENCE_SITES, ORIGINALS = " (site:ac.cn OR site:cas.cn OR site:edu.cn OR site:kepu.gmw.cn)", " 官方 原始资料"
# Names of one subject; a claim about one needs a text with one of them.
SAME_SUBJECT = (("声音", "声波", "声速"), ("太阳", "日出", "日落"), ("地球",), ("狗", "犬"), ("猫",), ("水", "纯水", "蒸馏水"))
# Signs of a page that is no text.
NOT_A_PAGE = ("edit history", "what links here", "permanent link", "access denied", "enable javascript", "verify you are human", "隐私政策", "用户登录", "网站导航")
# What is taken out of a claim before it is asked, in order, with what stands in its place.
REWRITES = [
    (r"^(?:研究显示|研究表明|资料显示|报告显示|数据显示)[，,:：\s]*", ""),
    (r"(?:自|从|由)[东南西北](?:方)?(?:向|往|到|至)[东南西北](?:方)?", "方向"), (r"(?:从|自)[东南西北](?:方|边|面)?(?=升起|落下)", ""), (r"(升起|落下)(?=[。！？!?；;，,\s]|$)", r"\1 方向"),
    (r"(?:传播|运动|移动)(?:得)?最[快慢]", "速度"), (r"(?<![㐀-鿿])(?:因为|由于)", ""),
]
_VALUE = re.compile(r"(?<![A-Za-z0-9])\d+(?:[.,]\d+)?\s*(?:%|％|亿元|万人|万|亿|吨|公斤|kg|米|千米|次|倍|摄氏度|平方公里)(?![A-Za-z0-9])", re.I)
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?%?")
_MARK = r"[。！？!?；;]?"


def folded(text: str | None) -> str:
    """NFKC, case-folded, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def topic_terms(text: str | None) -> list[str]:
    """Distinct terms in order, as functions.text.terms gives them, of NFKC text."""
    out: dict[str, None] = {}
    for run in re.findall(TERM, unicodedata.normalize("NFKC", text or "")):
        wide = "㐀" <= run[0] <= "鿿"
        for t in ([run[i : i + 2] for i in range(max(1, len(run) - 1))] if wide else [run]):
            if t not in CJK_STOP if wide else len(t) > 1 and t.casefold() not in STOP:
                out.setdefault(t)
    return list(out)


_KNOWN: dict[tuple, object] = {}


def _once(make, text: str | None):
    """make(text), remembered for a while."""
    key = (make.__name__, text)
    if key not in _KNOWN:
        if len(_KNOWN) > 50_000:
            _KNOWN.clear()
        _KNOWN[key] = make(text)
    return _KNOWN[key]


def _topic_words(topic: str | None) -> frozenset[str]:
    """Terms that tell a topic; numbers and pairs with a grammatical sign don't, unless there are only such."""
    words = frozenset(t.casefold() for t in topic_terms(topic) if not _NUMBER.fullmatch(t))
    return frozenset(t for t in words if not re.search(r"[的是在于了从向最]", t)) or words


def topic_share(text: str | None, topic: str | None) -> tuple[float, int]:
    """(share, number) of the topic's terms that *text* has."""
    words, body = _once(_topic_words, topic), _once(folded, text)
    hits = sum(t in body for t in words)
    return (hits / len(words) if words else 0.0), hits


def _subject(claim: str) -> tuple[str, ...] | None:
    """The names of the known subject that the claim begins with."""
    head = re.sub(r"^(?:因为|由于)", "", claim.strip())
    head = re.sub(r"^(?:在|截至)[^，,。；;]{1,40}[，,]\s*", "", head)
    return next((g for g in SAME_SUBJECT if re.match(rf"(?:{'|'.join(g)})(?:的|在|是|从|自|公|属|能|不|会|由)", head)), None)


def about_subject(text: str, claim: str) -> bool:
    """False where the claim begins with a known subject that *text* never names."""
    names = _once(_subject, claim)
    return names is None or any(name in text for name in names)


def usable_text(text: str | None, topic: str, claim: str) -> bool:
    """Whether a passage is about the claim: its property where it states one, else enough of the topic; and is a text at all."""
    slot, body = slot_of(claim), _once(folded, text)
    share, hits = topic_share(text, topic)
    fits = slot.strength(text or "") > 0 if slot else share >= 0.3 and hits > 0
    return fits and about_subject(body, claim) and sum(body.count(m) for m in NOT_A_PAGE) < 3


def _distinct(parts: Iterable[str | None]) -> list[str]:
    kept: dict[str, str] = {}
    for p in parts:
        p = " ".join((p or "").split())
        if p:
            kept.setdefault(folded(p), p)
    return list(kept.values())


def joined_parts(parts: Iterable[str | None]) -> list[str]:
    """Parts none of which another says: a later, longer one takes the place of those inside it."""
    out: list[str] = []
    for part in _distinct(parts):
        said = [folded(o) for o in out]
        if any(folded(part) in s for s in said) or (" " in part and all(any(folded(w) in s for s in said) for w in part.split())):
            continue
        out = [o for o in out if folded(o) not in folded(part)] + [part]
    return out


def bounded(parts: Iterable[str], longest: int = LONGEST) -> str:
    """Parts in one line of *longest* signs: whole clauses, else whole words, else cut."""
    line = " ".join(p for p in parts if p).strip()
    if len(line) <= longest:
        return line
    kept = ""
    for clause in (c.strip() for c in re.split(r"(?<=[。！？!?；;，,])\s*", line) if c.strip()):
        if len(f"{kept} {clause}".strip()) > longest:
            break
        kept = f"{kept} {clause}".strip()
    head = line[:longest].rstrip()
    return kept or (head[: head.rfind(" ")].rstrip() if " " in head else head)


def cause_asked(text: str) -> str | None:
    """The outcome whose cause a claim states, as a question."""
    m = re.fullmatch(r"([^，,。；;]{2,30}?)(?:因为|由于|因)([^，,。；;]+)而([^，,。；;]{2,20})[。.]?", text.strip())
    return f"{m[1]} {m[3]} 原因" if m and not re.search(r"如果|可能|据称|报告称|表示|认为|[“”\"]", text) else None


def _without_answer(text: str) -> str:
    """The question behind "X的Y是Z", "X是Y的Z" and "X是Z"."""
    if m := re.match(rf"\s*(.+?)的(.+?)(?<!不)是(.+?){_MARK}$", text):
        return f"{m[1]} {m[2]}"
    if m := re.match(rf"\s*(.+?)(?<!不)是(.+?)的(.+?){_MARK}$", text):
        return f"{m[2]} {m[3]}"
    m = re.fullmatch(r"([^，,。；;]{2,40}?)是([^，,。；;]{2,40})[。.]?", text)
    return f"{m[1]} 分类 定义" if m and not re.search(r"\d|最|比|超过|低于|高于|因为|如果", m[2]) else text


def neutral(action: str, anchors: Iterable[str] = (), value: str = "") -> str:
    """The claim as a question: its property or cause, else its words without answer, anchors and amounts."""
    slot = slot_of(action)
    text = slot.query() if slot else cause_asked(action) or action
    for pattern, instead in REWRITES:
        text = re.sub(pattern, instead, text)
    text = _without_answer(text)
    for word in [*anchors, value]:
        text = re.sub(re.escape(word), " ", text, flags=re.I) if word else text
    changed = text != action
    asked = re.sub(r"不是|并非|不等于|不属于", " ", spared := _VALUE.sub(" ", text))
    if changed or asked != spared:
        # What an anchor leaves behind.
        asked = re.sub(r"^[\s，,。;；:：]*(?:(?:根据|关于|针对|对于|的|为|在|于|截至|下|是)\s*)+", "", asked)
        asked = re.sub(r"(?:(?:的|为|在|于|截至|下|是)\s*)+[\s，,。;；:：]*$", "", asked)
    return " ".join(asked.split()).strip(" ，,。;；")


def variants(action: str | None, entities: Iterable[str] = (), conditions: Iterable[str] = (), time: str = "", value: str = "") -> list[str]:
    """At most three distinct queries: the wording with what it lacks, the question, the question in one context."""
    action, names, limits = " ".join((action or "").split()), _distinct(entities), _distinct(conditions)
    extra = [*names, time, value, *limits]
    if not action and not any(extra):
        return []
    anchored = any(x and folded(x) in folded(action) for x in extra)
    base = [action, *(x for x in extra if folded(x) not in folded(action))] if anchored else [*names, action, time, value, *limits]
    question, limits = neutral(action, [*names, *limits], value), [neutral(x, (), value) for x in limits]
    titles = re.findall(r"《([^《》\n]{2,60})》", action)
    asked = [bounded(_distinct(titles))] if titles else [bounded(joined_parts([*names, question, time, *limits])), bounded(joined_parts([*names, question, time, *limits[:1]]))]
    out: dict[str, str] = {}
    for query in [bounded(joined_parts(base)), *asked]:
        if query:
            out.setdefault(re.sub(r"[\s。！？!?；;，,]+", "", folded(query)), query)
    return list(out.values())[:MOST_QUERIES]


def queries(claim: str | None, entities: Iterable[str] = (), conditions: Iterable[str] = (), most: int = MOST_QUERIES) -> list[str]:
    """The queries of a claim."""
    most, found = max(1, min(most, MOST_QUERIES)), variants(claim, entities, conditions)
    if not found:
        return []
    parts = atoms(claim)
    if len(parts) > 1:
        asked = [v[1] if len(v) > 1 else v[0] for v in (variants(p.normalized) for p in parts) if v]
        return ([found[0], *asked] if len(asked) == 2 else asked)[:most]
    topic = found[1] if len(found) > 1 else found[0]
    if len(topic) >= 6 and len(topic_terms(topic)) >= 3:
        suffix = SCIENCE_SITES if SCIENCE.search(topic) else ORIGINALS
        found = [*found[:2], bounded([topic], LONGEST - len(suffix)) + suffix]
    return found[:most]


def targets(claim: str | None, entities: Iterable[str] = (), conditions: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(part, its question) of what a passage may be about: the parts of a compound claim, else the claim itself."""
    parts = atoms(claim)
    if len(parts) > 1:
        return [(p.normalized, neutral(p.normalized)) for p in parts]
    found = variants(claim, entities, conditions)
    return [(claim or "", found[1] if len(found) > 1 else found[0] if found else "")]
