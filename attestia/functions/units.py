"""Units as a graph of affine conversions, and amounts found in English, German and Chinese text."""
from __future__ import annotations

import re
from collections import deque
from fractions import Fraction

from .fold import make_fold

# Conversions unit -> other unit, value * factor + offset. Names are this module's own.
EDGES: list[tuple[str, str, str, str]] = [
    ("centimetre", "millimetre", "10", "0"), ("metre", "centimetre", "100", "0"), ("kilometre", "metre", "1000", "0"), ("inch", "millimetre", "25.4", "0"), ("foot", "inch", "12", "0"),
    ("yard", "foot", "3", "0"), ("mile", "yard", "1760", "0"), ("nautical mile", "metre", "1852", "0"), ("li", "metre", "500", "0"), ("decimetre", "centimetre", "10", "0"), ("mile", "metre", "1609.344", "0"),
    ("kilogram", "gram", "1000", "0"), ("milligram", "gram", "0.001", "0"), ("tonne", "kilogram", "1000", "0"), ("pound", "gram", "453.59237", "0"), ("pound", "ounce", "16", "0"), ("jin", "gram", "500", "0"), ("jin", "liang", "10", "0"),
    ("litre", "millilitre", "1000", "0"), ("centilitre", "millilitre", "10", "0"), ("cubic metre", "litre", "1000", "0"), ("gallon", "millilitre", "3785.411784", "0"), ("hectolitre", "litre", "100", "0"),
    ("square kilometre", "hectare", "100", "0"), ("hectare", "square metre", "10000", "0"), ("acre", "square foot", "43560", "0"), ("square foot", "square metre", "0.09290304", "0"), ("mu", "square metre", "2000/3", "0"),
    ("square mile", "acre", "640", "0"), ("square yard", "square foot", "9", "0"), ("square centimetre", "square metre", "1/10000", "0"), ("hectare", "mu", "15", "0"),
    ("kilobyte", "byte", "1000", "0"), ("megabyte", "kilobyte", "1000", "0"), ("gigabyte", "megabyte", "1000", "0"), ("terabyte", "gigabyte", "1000", "0"),
    ("kibibyte", "byte", "1024", "0"), ("mebibyte", "kibibyte", "1024", "0"), ("gibibyte", "mebibyte", "1024", "0"), ("tebibyte", "gibibyte", "1024", "0"),
    ("joule", "kilojoule", "0.001", "0"), ("megajoule", "kilojoule", "1000", "0"), ("kilowatt-hour", "megajoule", "3.6", "0"), ("kilocalorie", "kilojoule", "4.184", "0"), ("watt-hour", "kilowatt-hour", "0.001", "0"), ("calorie", "kilocalorie", "0.001", "0"), ("gigajoule", "megajoule", "1000", "0"), ("megawatt-hour", "kilowatt-hour", "1000", "0"),
    ("kilopascal", "pascal", "1000", "0"), ("hectopascal", "pascal", "100", "0"), ("megapascal", "kilopascal", "1000", "0"), ("bar", "hectopascal", "1000", "0"), ("millibar", "bar", "0.001", "0"), ("atmosphere", "pascal", "101325", "0"), ("psi", "pascal", "6894.757293168", "0"),
    ("kilometre per hour", "metre per hour", "1000", "0"), ("metre per second", "metre per hour", "3600", "0"), ("mile per hour", "metre per hour", "1609.344", "0"), ("knot", "metre per hour", "1852", "0"), ("metre per second", "kilometre per hour", "3.6", "0"),
    ("kelvin", "degree Celsius", "1", "-273.15"), ("degree Fahrenheit", "degree Celsius", "5/9", "-160/9"), ("degree Fahrenheit", "kelvin", "5/9", "45967/180"),
    ("jiao", "yuan", "0.1", "0"), ("fen", "jiao", "0.1", "0"),
]

# How each unit is written; a trailing "s?" style is a pattern. Case matters for symbols.
WRITTEN: dict[str, str] = {
    "millimetre": "millimet(?:er|re)s?|Millimetern?|mm|毫米", "centimetre": "centimet(?:er|re)s?|Zentimetern?|cm|厘米|公分", "decimetre": "decimet(?:er|re)s?|Dezimetern?|dm|分米", "metre": "met(?:er|re)s?|Metern?|m|米", "kilometre": "kilomet(?:er|re)s?|Kilometern?|km|公里|千米",
    "inch": "inch(?:es)?|in\\.|in(?= (?:from|long|high|wide|deep|tall)\\b)|Zoll|英寸|″|′′", "foot": "feet|foot|ft\\b\\.?|Fuß|英尺|′", "yard": "yards?|yds?|码", "mile": "miles?|mi|Meilen?|英里", "nautical mile": "nautical miles?|nmi|Seemeilen?|海里", "li": "里|华里",
    "milligram": "milligram(?:me)?s?|Milligramm|mg|毫克", "gram": "gram(?:me)?s?|Gramm|g|克", "kilogram": "kilogram(?:me)?s?|kilos?|Kilogramm|Kilo|kg|公斤|千克", "tonne": "metric tons?|metric tonnes?|tonnes?|Tonnen?|t|公吨|吨", "pound": "pounds?|lbs?|磅", "ounce": "ounces?|oz|Unzen?|盎司", "jin": "市斤|斤", "liang": "两",
    "millilitre": "millilit(?:er|re)s?|Millilitern?|ml|mL|毫升", "centilitre": "centilit(?:er|re)s?|Zentilitern?|cl|cL", "litre": "lit(?:er|re)s?|Litern?|L|l|公升|升", "hectolitre": "hectolit(?:er|re)s?|Hektolitern?|hl|hL", "cubic metre": "cubic met(?:er|re)s?|cu m|Kubikmetern?|m³|m\\^3|立方米", "gallon": "(?:US )?gallons?|gal|Gallonen?|加仑",
    "square centimetre": "square centimet(?:er|re)s?|sq cm|Quadratzentimetern?|cm²|平方厘米", "square metre": "square met(?:er|re)s?|sq\\.? m|Quadratmetern?|m²|平方米|平米", "hectare": "hectares?|Hektar|ha|公顷", "square kilometre": "square kilomet(?:er|re)s?|sq\\.? km|Quadratkilometern?|km²|平方公里|平方千米", "acre": "acres?|英亩", "square foot": "square f(?:ee|oo)t|sq\\.? ft|Quadratfuß|ft²|平方英尺", "square mile": "square miles?|sq\\.? mi|Quadratmeilen?|平方英里", "square yard": "square yards?|sq\\.? yd", "mu": "亩",
    "byte": "bytes?|Bytes?|字节", "kilobyte": "kilobytes?|Kilobytes?|kB|KB|千字节", "megabyte": "megabytes?|Megabytes?|MB|兆字节", "gigabyte": "gigabytes?|Gigabytes?|GB|吉字节|千兆字节", "terabyte": "terabytes?|Terabytes?|TB|太字节", "kibibyte": "kibibytes?|Kibibytes?|KiB", "mebibyte": "mebibytes?|Mebibytes?|MiB", "gibibyte": "gibibytes?|Gibibytes?|GiB", "tebibyte": "tebibytes?|Tebibytes?|TiB",
    "joule": "joules?|Joule|J|焦耳|焦", "kilojoule": "kilojoules?|Kilojoule|kJ|千焦耳?", "megajoule": "megajoules?|Megajoule|MJ|兆焦耳?", "gigajoule": "gigajoules?|Gigajoule|GJ|吉焦耳?", "watt-hour": "watt-hours?|Wattstunden?|Wh|瓦时", "kilowatt-hour": "kilowatt[- ]hours?|Kilowattstunden?|kWh|千瓦时|度电|度(?=用电|的电)", "megawatt-hour": "megawatt[- ]hours?|Megawattstunden?|MWh|兆瓦时", "calorie": "calories?|Kalorien?|cal|卡路里|卡", "kilocalorie": "kilocalories?|Kilokalorien?|kcal|千卡|大卡",
    "pascal": "pascals?|Pascal|Pa|帕斯卡|帕", "hectopascal": "hectopascals?|Hektopascal|hPa|百帕", "kilopascal": "kilopascals?|Kilopascal|kPa|千帕", "megapascal": "megapascals?|Megapascal|MPa|兆帕", "bar": "bars?|Bar|巴", "millibar": "millibars?|Millibar|mbar|毫巴", "atmosphere": "atmospheres?|Atmosphären?|atm|个?标准大气压|个?大气压", "psi": "psi|PSI|pounds? per square inch",
    "metre per second": "met(?:er|re)s? per second|Metern? pro Sekunde|m/s|米/秒|米每秒", "kilometre per hour": "kilomet(?:er|re)s? (?:per|an) hour|Stundenkilometern?|Kilometern? pro Stunde|km/h|kph|公里/小时|公里/时|公里每小时|千米每小时|千米/小时", "metre per hour": "met(?:er|re)s? per hour|m/h|米/小时|米每小时", "mile per hour": "miles? (?:per|an) hour|mph|Meilen pro Stunde|英里每小时|英里/小时", "knot": "knots?|Knoten|kn|kts?|节",
    "degree Celsius": "degrees? (?:Celsius|centigrade)|° ?C|Grad Celsius|摄氏度", "degree Fahrenheit": "degrees? Fahrenheit|° ?F|Grad Fahrenheit|华氏度", "kelvin": "kelvins?|Kelvin|K|开尔文|开氏度",
    "yuan": "yuan|Yuan|renminbi|RMB|CNY|元人民币|人民币元|元|块钱", "jiao": "角", "fen": "分钱",
}

# Number words.
_EN = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_DE = {"null": 0, "ein": 1, "eins": 1, "eine": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwölf": 12, "sechzehn": 16, "siebzehn": 17, "zwanzig": 20, "dreißig": 30, "vierzig": 40, "fünfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90}
_ZH = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "Millionen": 10**6, "Million": 10**6, "Milliarden": 10**9, "Milliarde": 10**9, "Tausend": 1000, "tausend": 1000, "Mio.": 10**6, "Mio": 10**6, "Mrd.": 10**9, "Mrd": 10**9, "m": 10**6, "mn": 10**6, "bn": 10**9, "k": 1000, "万": 10**4, "亿": 10**8, "千": 1000, "百": 100, "百万": 10**6, "千万": 10**7, "万亿": 10**12}
_FRACTIONS = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4)}


def conversions(targets: dict[str, str], edges=EDGES) -> dict[str, tuple[str, Fraction, Fraction]]:
    """unit -> (dimension, factor, offset) by the shortest path to the common unit of its dimension.

    *targets*: dimension -> common unit. Raises ValueError where two paths disagree, in factor or offset, by more than
    rounding; units that no target reaches are checked among themselves.
    """
    graph: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for a, b, factor, offset in edges:
        f, o = Fraction(factor), Fraction(offset)
        # x_b = f x_a + o, so coming from b: x_a = (x_b - o) / f. Walking out from the target composes target(x).
        graph.setdefault(b, []).append((a, f, o))
        graph.setdefault(a, []).append((b, 1 / f, -o / f))
    close = lambda x, y: abs(x - y) <= max(abs(x), abs(y), 1) * Fraction(1, 10**9)

    def walk(common: str) -> dict[str, tuple[Fraction, Fraction]]:
        found, queue = {common: (Fraction(1), Fraction(0))}, deque([common])
        while queue:
            unit = queue.popleft()
            f, o = found[unit]
            for nxt, g, p in graph.get(unit, []):
                way = (f * g, f * p + o)
                if nxt not in found:
                    found[nxt] = way
                    queue.append(nxt)
                elif not close(found[nxt][0] / way[0], Fraction(1)) or not close(found[nxt][1], way[1]):
                    raise ValueError(f"conversions of {nxt} to {common} disagree")
        return found

    out = {u: (dimension, f, o) for dimension, common in targets.items() for u, (f, o) in walk(common).items()}
    rest = set(graph) - set(out)
    while rest:
        rest -= set(walk(min(rest)))
    return out


def zh_number(text: str) -> Fraction:
    whole, _, part = text.partition("点")
    total = section = digit = 0
    plain = ""
    for ch in whole:
        if ch in _ZH:
            digit = _ZH[ch]
            plain += str(digit)
        elif ch == "半":
            return Fraction(1, 2)
        else:
            unit = {"十": 10, "百": 100, "千": 1000, "万": 10**4, "亿": 10**8}[ch]
            plain = ""
            if unit >= 10**4:
                total = (total + section + digit) * unit
                section = 0
            else:
                section += (digit or 1) * unit
            digit = 0
    value = Fraction(int(plain)) if len(plain) > 1 and plain else Fraction(total + section + digit)
    if part:
        value += Fraction(int("".join(str(_ZH[c]) for c in part)), 10 ** len(part))
    return value


def en_number(text: str) -> Fraction:
    total = now = 0
    for w in re.split(r"[\s-]+", text.lower()):
        if w in _EN:
            now += _EN[w]
        elif w == "hundred":
            now = (now or 1) * 100
        elif w == "thousand":
            total, now = total + (now or 1) * 1000, 0
    return Fraction(total + now)


def de_number(text: str) -> Fraction:
    def small(t: str) -> int:
        if not t:
            return 0
        if t in _DE:
            return _DE[t]
        if "und" in t:
            a, _, b = t.partition("und")
            return _DE.get(a, 0) + _DE.get(b, 0)
        if t.endswith("zehn"):
            return _DE.get(t[:-4], 0) + 10
        return 0

    t, total = text.lower(), 0
    if "tausend" in t:
        a, _, t = t.partition("tausend")
        total += int(de_number(a) if a else 1) * 1000
    if "hundert" in t:
        a, _, t = t.partition("hundert")
        total += (small(a) if a else 1) * 100
        t = t.removeprefix("und")
    return Fraction(total + small(t))


def _patterns():
    spelled = {}
    alternatives = []
    for unit, forms in WRITTEN.items():
        for form in re.split(r"\|(?![^(]*\))", forms):
            alternatives.append((form, unit))
    # Longest forms first, so that "square metres" is not read as a shorter unit.
    alternatives.sort(key=lambda x: -len(x[0]))
    for n, (form, unit) in enumerate(alternatives):
        spelled[f"u{n}"] = unit
    unit = "|".join(f"(?P<u{n}>{form}{'' if re.search('[㐀-鿿′″]', form) else '(?![A-Za-zÀ-ÿ/²³^0-9])'})" for n, (form, _) in enumerate(alternatives))
    plain_unit = re.sub(r"\?P<u\d+>", "?:", unit)
    en = "|".join(sorted(_EN, key=len, reverse=True))
    de_part = "|".join(sorted(_DE, key=len, reverse=True))
    number = (
        r"(?:\d{1,3}(?:[ ']\d{3})+(?:[.,]\d+)?(?!\d)|\d+(?:[.,]\d+)*)(?:[½¼¾]|(?= ?[½¼¾]) ?[½¼¾])?|[½¼¾]"
        rf"|(?<![A-Za-z-])(?:(?:{en})(?:[ -](?:and |)(?:{en}|hundred|thousand))*)(?![a-z])"
        rf"|(?<![A-Za-zÀ-ÿ-])(?:(?:{de_part}|und|hundert|tausend|zehn)+)(?![a-zß-ÿ])"
        r"|[零〇一二两三四五六七八九十百千万亿半]+(?:点[零〇一二三四五六七八九]+)?"
    )
    sign = r"(?:(?:minus |零下|负|[-−–](?=\d))\s?)?"
    scale = r"(?:\s?(?:million|billion|trillion|thousand|Millionen|Million|Milliarden|Milliarde|Tausend|Mio\.?|Mrd\.?|bn|mn)(?![a-z])|(?:百万|千万|万亿|万|亿|千|百))"
    joint = r"\s?(?:-|–|—|~|～|to|bis|至|到|und|and)\s?"
    money = r"(?:CN¥|RMB|CNY|人民币|¥)"
    amount = re.compile(
        rf"(?:(?P<money>{money})\s?)?(?P<s1>{sign})(?P<n1>{number})(?P<k1>{scale}|(?<=\d)[mk](?=[^A-Za-z]|$)(?=(?:\s|[.,;])|$))?"
        rf"(?:\s?(?:{plain_unit})?(?P<j>{joint})(?P<s2>{sign})(?P<n2>{number})(?P<k2>{scale})?)?"
        rf"(?:(?P<gap>[\s-]{{0,2}})(?:{unit}))?"
    )
    tail = re.compile(rf"(?:\s|,\s| and |又)?(?P<n>\d+(?:[.,]\d+)?[½¼¾]?)\s?(?:{unit})")
    # Where a number may begin. Every amount has such a place, so texts without one are passed over.
    firsts = "".join(sorted({w[0] for w in _DE} | set("ht")))
    start = rf"\d|[½¼¾]|(?<![A-Za-z-])(?:{en})(?![a-rt-x])|(?<![A-Za-zÀ-ÿ-])(?=[{firsts}])(?:{de_part}|hundert|tausend)|[零〇一二两三四五六七八九十百千半]"
    begin, maybe = re.compile(rf"{money}|minus |零下|负|[-−–](?=\d)|{start}"), re.compile(rf"{start}|[万亿]")
    header = re.compile(rf"(?:\((?P<a>{plain_unit})\)|\[(?P<b>{plain_unit})\]|, (?P<c>{plain_unit})| in (?P<d>{plain_unit}))\s(?:of|von|der|des)\s[^.:\n]{{1,90}}?:\s?(?P<s>{sign})(?P<n>{number})")
    one = re.compile(rf"(?:{unit})")
    return spelled, maybe, begin, amount, tail, header, one


_GERMAN = re.compile(r"\b(?:der|die|das|dem|den|und|liegt|fasst|zahlte|verbrauchte|erreichte|wiegt|belegt|umfasst|vom|für|lang|hoch|bei|mit|ist|wurde|auf|ein|eine|von|im|am|wie|bis)\b")
_ENGLISH = re.compile(r"\b(?:the|of|was|is|and|at|with|for|to|by|in|its|from|that)\b")
# Parts of one compound amount: the unit and the smaller unit that may follow it.
_COMPOUNDS = {"foot": {"inch"}, "pound": {"ounce"}, "yard": {"foot", "inch"}, "mile": {"yard", "foot"}, "kilometre": {"metre"}, "metre": {"centimetre", "millimetre"}, "centimetre": {"millimetre"}, "kilogram": {"gram"}, "tonne": {"kilogram"}, "litre": {"millilitre"}, "jin": {"liang"}, "yuan": {"jiao"}, "hectare": {"square metre"}}


def make_finder():
    """amounts(text) -> list of (unit, value as Fraction); a range gives both ends, a compound one value in its smaller unit."""
    fold, (spelled, maybe, begin, amount, tail, header, one), ways = make_fold(), _patterns(), conversions({"length": "millimetre", "mass": "gram", "volume": "millilitre", "money": "fen", "area": "square metre"})

    def german(text: str, at: int, end: int) -> bool:
        around = text[max(0, at - 70) : end + 50]
        return len(_GERMAN.findall(around)) > len(_ENGLISH.findall(around))

    def value(raw: str, de: bool) -> Fraction | None:
        extra = Fraction(0)
        if raw[-1] in _FRACTIONS:
            extra, raw = _FRACTIONS[raw[-1]], raw[:-1].strip()
            if not raw:
                return extra
        if raw[0].isdigit():
            raw = raw.replace(" ", "").replace("'", "")
            point, group = (",", ".") if de else (".", ",")
            if group in raw:
                parts = raw.split(point)[0].split(group)
                if len(parts[0]) > 3 or any(len(p) != 3 for p in parts[1:]):
                    if raw.count(group) == 1 and point not in raw:
                        point, group = group, point  # one separator that cannot be a grouping
                    else:
                        return None
            raw = raw.replace(group, "").replace(point, ".")
            return None if raw.count(".") > 1 else Fraction(raw) + extra
        if re.match("[零〇一二两三四五六七八九十百千万亿半]", raw):
            return zh_number(raw) if raw not in ("百", "千", "万", "亿") else None
        words = re.split(r"[ -]", raw.lower())
        return en_number(raw) if all(w in _EN or w in ("hundred", "thousand", "and") for w in words) else de_number(raw)

    def unit_of(match: re.Match) -> str | None:
        return spelled.get(match.lastgroup) if match.lastgroup and match.lastgroup in spelled else next((spelled[k] for k, v in match.groupdict().items() if v and k in spelled), None)

    def amounts(text: str | None) -> list[tuple[str, Fraction]]:
        if not text or not maybe.search(text := fold(text)):
            return []
        out, at = [], 0
        for h in header.finditer(text):
            name = h["a"] or h["b"] or h["c"] or h["d"]
            m = one.fullmatch(name)
            v = value(h["n"], german(text, *h.span()))
            if m and v is not None:
                out.append((unit_of(m), -v if h["s"].strip() else v))
        while b := begin.search(text, at):
            m = amount.match(text, b.start())
            if m is None:
                at = b.end()
                continue
            at = max(m.end(), b.start() + 1)
            unit, ranged = unit_of(m), m["n2"] is not None
            if m["money"] and unit not in ("yuan", None):
                # The unit behind a currency amount belongs to something else.
                unit = None
            if unit is None and not m["money"]:
                if ranged:  # the first number had no range unit behind it: look again from the second
                    at = m.start("n2")
                else:
                    at = m.end("n1")
                continue
            unit = unit or "yuan"
            if m.start("n1") and (text[m.start("n1") - 1].isalnum() and text[m.start("n1") - 1] < "㐀" and text[m.start("n1")].isascii() and not m["money"] or text[m.start("n1") - 1] in "./" and text[m.start("n1") - 2 : m.start("n1") - 1].isdigit()):
                continue
            if not ranged and m["k1"] and m["k1"].strip() in ("m", "k") and not m["money"]:
                continue
            if m["j"] and m["j"].strip() in ("und", "and") and not re.search(r"(?:between|zwischen) ?$", text[max(0, m.start() - 9) : m.start()]):
                at = m.start("n2")
                continue
            de = german(text, *m.span())
            k1 = SCALES.get((m["k1"] or "").strip(), 1)
            first = value(m["n1"], de)
            if first is None:
                continue
            cold = unit in ("degree Celsius", "degree Fahrenheit")
            minus = lambda s: bool(s.strip()) and (cold or s.strip() in ("minus", "零下", "负"))
            if ranged:
                k2 = SCALES.get((m["k2"] or "").strip(), 1)
                second = value(m["n2"], de)
                if second is None:
                    continue
                k1 = k1 if m["k1"] else k2
                out += [(unit, first * k1 * (-1 if minus(m["s1"]) else 1)), (unit, second * k2 * (-1 if minus(m["s2"]) else 1))]
                continue
            v = first * k1 * (-1 if minus(m["s1"]) else 1)
            while unit in _COMPOUNDS and (t := tail.match(text, at)) and (small := unit_of(t)) in _COMPOUNDS[unit] and (more := value(t["n"], de)) is not None:
                v, unit, at = v * ways[unit][1] / ways[small][1] + more, small, t.end()
            out.append((unit, v))
        return out

    return amounts
