"""Vetoes on quoted passages: reasons why a passage does not settle a claim although it was quoted for it.

A quote is read in every sentence it stands in. Each reading is put to an ordered table of vetoes; the first that
applies gives its code. A veto never says what is true. Pure Python, used in Arrow batches.

Defined results: no reading, or more than MOST_READINGS of them, is a veto of its own; null texts count as empty.
"""
from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

from .atoms import Slot, slot_of
from .claims import statements

MOST_READINGS = 8
# Wordings that limit, deny, compare, explain or generalise a statement.
_CONDITION = r"在[^，,。；;]{1,25}(?:条件下|情况下|大气压下|期间)"
QUALIFIER = re.compile(r"据称|传闻|网传|有人声称|可能|或许|预计|有望|计划|如果|假如|仅在|只有|只要|" + _CONDITION + r"|\b(?:if|unless|may|might|could|allegedly|reportedly|plans? to)\b", re.I)
NEGATION = re.compile(r"不能|无法|并非|不是|不会|没有|未曾|尚未|不支持|不属于|不在|\b(?:cannot|can't|does not|do not|is not|are not|never|no longer)\b", re.I)
REQUIRED = re.compile(r"仅在|只有|只要|如果|假如|" + _CONDITION)
COMPARISON = re.compile(r"超过|大于|小于|低于|高于|至少|至多|不少于|不超过|约|大约|[<>≥≤~～]|\b(?:over|under|at least|about)\b", re.I)
CAUSAL = re.compile(r"因为|由于|因此|从而|导致|使得|原因|因(?=[^。]{1,30}而)|\b(?:because|causes?|caused|therefore|due to)\b", re.I)
UNIVERSAL = re.compile(r"所有|全部|每个|任何|\b(?:all|every|always)\b", re.I)
PARTICULAR = re.compile(r"部分|一些|有些|多数|\b(?:some|many|sometimes)\b", re.I)
# Names of one measured figure.
FIGURES = (("研发投入", "研发费用", "研发支出"), ("营收", "营业收入"), ("净利润",), ("员工人数", "员工数量"), ("用户数", "用户数量"), ("沸点", "boiling point"), ("声速", "声音传播速度", "speed of sound"))
# Units that convert into each other, with their factor.
UNITS = {
    "CNY": {"亿元": "100000000", "万元": "10000", "元": "1"}, "USD": {"亿美元": "100000000", "万美元": "10000", "美元": "1"}, "Celsius": {"摄氏度": "1", "°c": "1", "oc": "1"},
    "length": {"千米": "1000", "公里": "1000", "km": "1000", "厘米": "1/100", "米": "1"}, "mass": {"千克": "1", "公斤": "1", "kg": "1", "克": "1/1000"}, "people": {"万人": "10000", "人": "1"},
    "percent": {"百分比": "1", "%": "1"}, "speed": {"米/秒": "1", "m/s": "1", "千米/小时": "5/18", "km/h": "5/18"},
}
# Wordings that state a property more strictly than its search words.
STRICT = {
    "毕业院校": "毕业于 毕业", "成立时间": "成立于 创立于 创办于 始建于 成立 创立 创办 始建", "出生地点 时间": "出生于 诞生于 生于 出生 诞生", "地址 地理位置": "位于 坐落于 坐落 地处 地址 校址 位置", "所属类别": "属于 归属",
}
_UNIT = {unit: (dimension, Fraction(factor)) for dimension, units in UNITS.items() for unit, factor in units.items()}
_ANY_UNIT = "|".join(re.escape(u) for u in sorted(_UNIT, key=len, reverse=True))
_AMOUNT = re.compile(rf"(?<![\w.])([+-]?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?)\s*({_ANY_UNIT})(?![A-Za-z/])", re.I)
_DAY = re.compile(r"(?<!\d)(\d{4})\s*年(?:\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?)?")
_WHEN = r"\d{4}年(?:\d{1,2}月(?:\d{1,2}日)?)?"
_STOPS = "，,。；;"


def compact(text: str | None) -> str:
    """NFKC and case-folded, without white space."""
    return "".join(unicodedata.normalize("NFKC", text or "").split()).casefold()


def bare(text: str | None) -> str:
    return compact(text).strip("。.!！?？；;，,")


def scope_form(text: str | None) -> str:
    """Compact, with the ways of naming standard pressure made one."""
    text = re.sub(r"(?:1|一)(?:个)?标准大气压|101\.325kpa|1atm", "标准大气压", compact(text))
    return re.sub(r"(?:在)?标准大气压(?:条件)?下", "标准大气压下", text)


def amounts(text: str | None) -> set[tuple[str, Fraction]]:
    """(dimension, exact value) of the figures with a known unit."""
    text = re.sub(r"(?<=[㐀-鿿])(?=[+-]?\d)", " ", unicodedata.normalize("NFKC", text or "").casefold())
    return {(_UNIT[m[2]][0], Fraction(m[1].replace(",", "")) * _UNIT[m[2]][1]) for m in _AMOUNT.finditer(text)}


def days(text: str | None) -> list[tuple[int, ...]]:
    """Dates as (year[, month[, day]])."""
    return [tuple(int(x) for x in m.groups() if x) for m in _DAY.finditer(text or "")]


def covered(wanted: list[tuple[int, ...]], seen: list[tuple[int, ...]]) -> bool:
    """Every wanted date is met by a seen one of at least its precision."""
    return all(any(s[: len(w)] == w for s in seen) for w in wanted)


def _cuts(text: str, signs: str) -> list[int]:
    """Places of *signs*, but for commas inside numbers."""
    return [m.start() for m in re.finditer(f"[{signs}]", text) if not (text[m.start() - 1 : m.start()].isdigit() and text[m.end() : m.end() + 1].isdigit())]


def clause_of(context: str, quote: str) -> str:
    """The clauses of *context* that *quote* lies in."""
    at = context.find(quote)
    if at < 0:
        return context
    cuts = _cuts(context, "，,；;")
    return context[max((c + 1 for c in cuts if c < at), default=0) : min((c for c in cuts if c >= at + len(quote)), default=len(context))]


def readings(text: str, quote: str) -> list[str]:
    """The sentences around every occurrence of *quote*, one more than MOST_READINGS at most."""
    out, spans, at = [], statements(text), text.find(quote) if quote else -1
    while at >= 0 and len(out) <= MOST_READINGS:
        met = [s for s in spans if s[0] < at + len(quote) and s[1] > at]
        out.append(text[met[0][0] : met[-1][1]] if met else text)
        at = text.find(quote, at + 1)
    return out


def starts_subject(text: str, at: int) -> bool:
    """A subject may begin here: at the start of a clause or right after its date."""
    head = re.split(r"[，,。；;：:]", text[:at])[-1]
    return not head or re.fullmatch(rf"(?:在|截至)?{_WHEN}", head) is not None


def figure_subject(part: str, names: tuple[str, ...]) -> str | None:
    """Whose figure the claim states; None where that is not plain."""
    text = compact(part)
    at = min((i for i in (text.find(compact(n)) for n in names) if i >= 0), default=-1)
    if at < 0:
        return None
    head = re.sub(rf"^(?:在|截至)?{_WHEN}[，,]?", "", text[:at])
    head = re.sub(r"^在[^，,]{1,30}(?:条件下|情况下|大气压下|期间)[，,]", "", head)
    head = re.sub(rf"(?:在|于)?{_WHEN}的?$", "", head).removesuffix("的")
    plain = re.fullmatch(r"[㐀-鿿A-Za-z0-9_-]{1,40}", head) and not re.search(r"^(?:在|当|如果|由于|因为)|与|和|并|且|属于", head)
    return head if plain else None


def figure_clauses(part: str, context: str, names: tuple[str, ...]) -> list[str]:
    """The stretches of *context* that state this figure of this subject, with a date clause right before."""
    text, subject = compact(context), figure_subject(part, names)
    called = ("纯净水", "蒸馏水", "纯水", "水") if subject == "水" else (subject,)
    who = "|".join(map(re.escape, called)) if subject else ""
    head = rf"(?:{who})(?:(?:在|于)?(?:在|截至)?{_WHEN}|(?:在|于)[^，,。；;]{{1,25}}(?:下|时|中))?的?" if subject else ""
    cue, out, cuts = "|".join(re.escape(compact(n)) for n in names), [], _cuts(text, _STOPS)
    others = re.compile("|".join(re.escape(compact(n)) for group in FIGURES for n in group))
    for m in re.finditer(f"{head}(?:{cue})", text):
        if subject and not starts_subject(text, m.start()):
            continue
        before = [c for c in cuts if c < m.start()]
        left = before[-1] + 1 if before else 0
        if before:
            earlier = before[-2] + 1 if len(before) > 1 else 0
            left = earlier if re.fullmatch(rf"(?:在|截至)?{_WHEN}", text[earlier : before[-1]]) else left
        right = min([c for c in cuts if c >= m.end()] + [len(text), m.end() + 100])
        nxt = others.search(text, m.end(), right)
        out.append(text[left : nxt.start() if nxt else right])
    if subject:
        out += [m.group() for m in re.finditer(rf"\d+(?:\.\d+)?(?:{_ANY_UNIT})(?:作为|是|为)(?:{who})的?(?:{cue})", text) if starts_subject(text, m.start())]
    return out


def property_answer(slot: Slot | None, part: str, context: str, quote: str) -> tuple[str, str] | None:
    """(answer claimed, answer quoted) of the claim's property; ("", "") where the quote does not state it of this subject once."""
    if slot is None:
        return None
    cues = "|".join(re.escape(c) for c in sorted(STRICT[slot.name].split() if slot.name in STRICT else slot.cues, key=len, reverse=True))
    dated = rf"(?:(?:于|在)(?P<day>{_WHEN}))?" if slot.name == "成立时间" else "(?P<day>(?!))?"
    pattern = re.compile(
        rf"{re.escape(compact(slot.subject))}(?:的)?(?:(?:最终|最后|主要|通常|目前|曾经|已经|约)的?)*{dated}(?:{cues})(?:于|在|为|是|：|:)?"
        r"(?P<answer>[^，,。；;！？!?]*(?:[，,](?:而非|而不是|不是|并非|不在)[^，,。；;！？!?]+)?)", re.I)
    text, said = compact(context), compact(quote)
    found = [m for m in pattern.finditer(text) if starts_subject(text, m.start()) and (said in m.group() or m.group() in said)]
    claimed = pattern.search(compact(part))
    answer = lambda m: (m["day"] or m["answer"]).strip("。.!，,")
    if len(found) != 1:
        return "", ""
    if claimed is None:
        return None
    return (answer(claimed), answer(found[0])) if answer(found[0]) else ("", "")


@dataclass(frozen=True)
class Reading:
    """One place of a quote, with what it is held against."""

    part: str
    whole: str
    quote: str
    relation: str
    context: str
    before: str = ""

    @cached_property
    def supports(self) -> bool:
        return self.relation == "supports"

    @cached_property
    def refutes(self) -> bool:
        return self.relation == "refutes"

    @cached_property
    def scope_only(self) -> bool:
        return REQUIRED.fullmatch(bare(self.part)) is not None

    @cached_property
    def sentence(self) -> str:
        """The context; a sentence before it that defines the same figure's condition belongs to it."""
        about = self.whole if self.scope_only else self.part
        has = lambda text, group: any(n.casefold() in text.casefold() for n in group)
        defines = re.search(r"^(?:通常|一般)(?:说的|所称的)?沸点[，,]?(?:都|均)?(?:是指|指)", compact(self.before))
        joined = REQUIRED.search(self.whole) and defines and REQUIRED.search(self.before) and any(has(about, g) and has(self.before, g) for g in FIGURES)
        return self.before + self.context if joined else self.context

    @cached_property
    def same_polarity(self) -> bool:
        return bool(NEGATION.search(self.part)) == bool(NEGATION.search(clause_of(self.sentence, self.quote)))

    @cached_property
    def slot(self) -> Slot | None:
        return slot_of(self.part)

    @cached_property
    def answers(self) -> tuple[str, str] | None:
        return property_answer(self.slot, self.part, self.sentence, self.quote)

    @cached_property
    def denied(self) -> bool:
        """The quoted answer rules the claimed one out in so many words."""
        return bool(self.answers and self.answers[0]) and re.search(rf"(?:而非|不是|不在|并非){re.escape(bare(self.answers[0]))}", bare(self.answers[1])) is not None

    @cached_property
    def period(self) -> list[tuple[int, ...]]:
        return days(self.slot.scope if self.slot else self.part)

    @cached_property
    def wanted(self) -> set[tuple[str, Fraction]]:
        """Amounts that must agree; none where the claim compares."""
        return set() if COMPARISON.search(self.part) else amounts(self.part)


def _answer_problem(r: Reading) -> str | None:
    if r.slot and r.answers == ("", ""):
        return "property_not_bound"
    if not r.answers:
        return None
    claimed, said = r.answers
    a, b = days(claimed), days(said)
    if r.supports:
        return ("answer_date" if not covered(a, b) else None) if a else None if bare(claimed) in bare(said) else "answer_missing"
    same = bare(claimed) in bare(said) or bare(said) in bare(claimed) or bool(a and b and (covered(a, b) or covered(b, a)))
    return "same_answer" if r.refutes and same and not r.denied else None


def _figure_problem(r: Reading) -> str | None:
    for names in FIGURES:
        if not any(n.casefold() in r.part.casefold() for n in names):
            continue
        if not any(compact(n) in compact(r.sentence) for n in names):
            return "other_figure"
        found, said = figure_clauses(r.part, r.sentence, names), compact(r.quote)
        if not found:
            return "figure_not_bound"
        found = [c for c in found if said in c or c in said]
        if not found:
            return "figure_not_quoted"
        found = [c for c in found if covered(r.period, days(c))]
        if not found:
            return "figure_period"
        values = set().union(*map(amounts, found))
        if r.wanted and (problem := _values_problem(r, values, "figure_")):
            return problem
    return None


def _values_problem(r: Reading, values: set, prefix: str = "") -> str | None:
    if r.supports and not r.wanted <= values:
        return prefix + "value_missing"
    if r.refutes:
        if not values or (not prefix and {d for d, _ in r.wanted} != {d for d, _ in values}):
            return prefix + "value_not_comparable"
        if r.wanted == values and r.same_polarity:
            return prefix + "value_equal"
    return None


#: (code, whether it applies) or a function that gives the code; the first that applies decides.
VETOES = [
    ("scope_cannot_refute", lambda r: r.scope_only and r.refutes),
    ("extra_qualifier", lambda r: any(scope_form(m.group()) not in scope_form(r.whole) for m in QUALIFIER.finditer(r.sentence))),
    ("condition_missing", lambda r: any(scope_form(m.group()) not in scope_form(r.sentence) for m in REQUIRED.finditer(r.whole))),
    ("polarity", lambda r: r.supports and not r.scope_only and not r.same_polarity),
    ("claim_repeated", lambda r: r.refutes and bare(r.part) in bare(r.quote) and r.same_polarity),
    ("no_cause", lambda r: CAUSAL.search(r.part) and not CAUSAL.search(r.sentence)),
    ("only_some", lambda r: r.supports and UNIVERSAL.search(r.part) and PARTICULAR.search(r.sentence) and not UNIVERSAL.search(r.sentence)),
    _answer_problem,
    ("period", lambda r: r.period and not covered(r.period, days(r.quote))),
    _figure_problem,
    lambda r: _values_problem(r, amounts(r.quote)) if r.wanted else None,
]


def _read(part: str, text: str, quote: str, relation: str, whole: str) -> list[Reading]:
    out = []
    for context in readings(text, quote):
        at = text.find(context)
        alone = at > 0 and text.find(context, at + 1) < 0
        before = statements(text[:at])[-1:] if alone else []
        out.append(Reading(part, whole or part, quote, relation, context, text[slice(*before[0])] if before else ""))
    return out


def problem(part: str, text: str, quote: str, relation: str, whole: str = "") -> str | None:
    """The code of the first veto on taking *quote* of *text* as settling *part*; None where there is none."""
    found = _read(part or "", text or "", quote or "", relation, whole)
    if not 0 < len(found) <= MOST_READINGS:
        return "place_unclear"
    for r in found:
        for veto in VETOES:
            code = veto(r) if callable(veto) else veto[0] if veto[1](r) else None
            if code:
                return code
    return None


def literal_support(part: str, text: str, quote: str, whole: str = "") -> bool:
    """The quote holds the claim word for word and nothing stands against it."""
    return bool(bare(part)) and bare(part) in bare(quote) and problem(part, text, quote, "supports", whole) is None


def explicit_denial(part: str, text: str, quote: str, whole: str = "") -> bool:
    """In every place the quote states the same property and rules the claimed answer out."""
    found = _read(part or "", text or "", quote or "", "refutes", whole)
    return problem(part, text, quote, "refutes", whole) is None and bool(found) and all(r.denied for r in found)


def checked(relation: str, quote: str | None, text: str, part: str, alignment: dict | None, whole: str = "") -> tuple[str, str | None]:
    """(relation that stands, code of what took it away) of one decision on one part; *alignment* has entity, predicate, scope and value."""
    if relation not in ("supports", "refutes", "partially_supports"):
        return relation, None
    if not quote or quote not in (text or ""):
        return "unknown", "quote_not_found"
    if alignment is None:
        stands = {"supports": literal_support, "refutes": explicit_denial}.get(relation)
        return (relation, None) if stands is None or stands(part, text, quote, whole) else ("unknown", "no_alignment")
    wanted = {"entity": "match", "predicate": "match", "scope": "match"} | {"supports": {"value": "match"}, "refutes": {"value": "conflict"}}.get(relation, {})
    off = next((name for name, value in wanted.items() if alignment.get(name) != value), None)
    code = f"{off}_not_{wanted[off]}" if off else problem(part, text, quote, relation, whole) if relation != "partially_supports" else None
    return ("unknown", code) if code else (relation, None)
