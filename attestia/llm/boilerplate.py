"""Lines of web pages that are not part of the main body.

Template deduction by equivalence classes: a page is its lines, and lines (digits and the site's own name masked) of
one host that occur on exactly the same pages form a class. A class is valid if its lines keep one order on all its
pages and no other class crosses it: two classes either lie apart or one lies in a single gap of the other. The valid
classes, nested this way, and single lines with twice the support are the host's template; what lies between two
template lines of a page is a slot. Slots hold the body, or teasers: those opened by a "related" or "most read" line,
and lists of titles below an advertisement's label or between template lines. A line right below the template or
other furniture that many pages of the collection share, on any host, continues that block. Phrases serve hosts with
too few pages to deduce anything, and name the kind of a slot.

Support counts distinct stories (the longest line of a page), so a story printed on several pages does
not make its own lines a template. All counting is by aggregation on hashed lines; nothing is collected but the
template lines themselves while they are few enough to be shipped.

Defined results: null and blank texts have no lines; a text of one line is body unless it is furniture
throughout; repeated rows give a line once.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestia.session import written

from .shared import map_words

MIN_STORIES = 4
#: Stories of the collection that make a line common.
COMMON_STORIES = 8
#: Template and common lines that are shipped to the workers (8 bytes each); beyond that they are joined.
MOST_SHIPPED = 2_000_000

# Words of navigation bars (en, de, fr, zh).
NAV = set(
    "home news business science culture travel opinion video podcasts events jobs shop weather archive subscribe contact sports sport politics world tech technology health "
    "startseite nachrichten wirtschaft wissen kultur reise meinung stellen abo wetter archiv kontakt veranstaltungen politik "
    "accueil actualités économie sciences voyages opinions vidéo emploi boutique météo archives abonnement politique société "
    "首页 新闻 财经 科学 文化 旅游 评论 视频 播客 活动 招聘 商城 天气 档案 订阅 联系我们 体育 国际 科技 "
    "print email save drucken merken teilen imprimer enregistrer 打印 收藏 分享 e-mail impressum datenschutz agb imprint privacy accessibility 使用条款 隐私政策 网站地图 confidentialité".split()
) | {"terms of use", "mentions légales", "plan du site", "reject all", "manage settings", "accept all"}
# Furniture phrases as patterns of a whole sentence or line; N stands for a site's or company's name.
PHRASES = r"""
sponsored( content)?|advertisement|anzeige|werbung|publicité|sponsorisé|广告|赞助内容
back to top|nach oben|zum seitenanfang|haut de page|retour en haut|返回顶部
follow us on our channels|folgen sie uns.*|suivez-nous.*|关注我们.*
(terms of use|mentions légales|impressum|使用条款)( ?[|·/] ?.+)?|site ?map
© ?\d{4} .+|版权所有 ?©? ?\d{4} .+|copyright .{0,60}|all rights reserved|alle rechte vorbehalten|tous droits réservés|保留所有权利
skip to (main )?content|zum inhalt springen|aller au contenu|跳到(主要)?内容|跳转到.*
share this (article|page)|artikel teilen|partager (cet|l')article|partager cet article|分享本文
enter your e-?mail address|ihre e-mail-adresse.*|votre adresse e-?mail.*|(请)?输入(您的)?(电子邮箱|邮箱|电子邮件).{0,6}
[\d,.]+ (shares|comments|kommentare|commentaires|partages).*|(kommentare|comments|commentaires|评论) ?[(（]\d+[)）]|\d+(条评论|次分享).*|评论
reading time ?: ?.*|lesezeit ?: ?.*|temps de lecture ?: ?.*|阅读时间 ?[:：].*
(log in|sign in) (or register )?to comment.*|(melden sie sich|zum kommentieren|anmelden).{0,40}|connectez-vous.{0,60}|登录.{0,12}评论.*
listen to this (page|article)|(artikel|seite|beitrag) anhören|écouter (cet article|cette page)|(收听|朗读)本(文|页)
print( ?[|·/] ?.+)?|drucken( ?[|·/] ?.+)?|imprimer( ?[|·/] ?.+)?
.{2,40} (is published by|ist ein angebot (der|von)) .+|un site du groupe .+|ein angebot der .+|.{2,40}由.{2,30}(出版|运营|主办)
reject all.*|accept all.*|manage settings.*|alle akzeptieren.*|alle ablehnen.*|einstellungen verwalten.*|tout (accepter|refuser).*|gérer mes choix.*|全部(接受|拒绝).*|管理设置.*
sign up for the .+ newsletter.*|subscribe to .+|.{0,4}newsletter.{0,60}|.{2,40}-newsletter.*|inscrivez-vous à la lettre.*|abonnez-vous.{0,80}|订阅.{2,40}(简报|通讯|新闻).*|(jetzt )?(den )?.{0,12}newsletter .{0,40}(abonnieren|bestellen).*
support independent reporting ?:.*|(unterstützen|soutenez) .{0,90}|支持独立(报道|新闻).*|become a .+ member.*
no part of this page may be copied without .*|nachdruck, auch auszugsweise.*|toute reproduction.{0,80}|reproduction .{0,60}interdite.*|未经.{2,40}(书面)?许可，?不得.*
(延伸阅读|相关阅读|推荐阅读) ?[:：].+|(read (also|more)|see also|related|more on this|lesen sie auch|mehr dazu|siehe auch|à lire( aussi)?|lire aussi|voir aussi) ?: ?.+
all opinions are those of the authors.*|.{0,80}opinions are those of .*
"""
# How a notice on cookies or privacy begins; such a line is a notice as a whole.
CONSENT = r"""
(we|this (site|page)|.{2,40} (and|&) (its|\d+) .{0,6}partners) (use|uses|set|sets|store|stores) cookies|your privacy matters to .+|by continuing you agree to our .+
(wir|diese seite|.{2,40} und (ihre|\d+) .{0,8}partner) (nutzen|nutzt|verwenden|verwendet|speichern|speichert) cookies
(nous|ce site|.{2,60}) .{0,30}(utilis|dépos)(e|ent|ons) (des|les) cookies
(我们|本站|.{2,40})(与\d+家合作伙伴)?使用 ?cookie
"""
# Lines that open a list of teasers.
RELATED = r"related( articles| stories)?|trending( now)?|most (read|popular)|you may also like|more from .{2,40}|read (more|next|also)|recommended.{0,20}|mehr (zum thema|von .{2,40})|das könnte sie( auch)? interessieren|meistgelesen|auch interessant|à lire aussi|sur le même (thème|sujet)|les plus lus|plus de .{2,40}|相关(阅读|文章|报道)|热门(文章|阅读)|猜你喜欢|(更多|来自).{2,30}|sponsored( content| stories)?|gesponsert(e inhalte)?|(contenu )?sponsorisé|赞助内容"
# Labels of an advertisement; titles below one are teasers where there are several, a single one may be the article's subheading.
LABELS = r"advertisement|anzeigen?|werbung|publicité|annonce|广告"
_BREAK = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")


def make_judge():
    """not_body(lines, flags) -> numbers (from 1) of the non-blank lines that are not body."""
    furniture = re.compile("|".join(f"(?:{p})" for p in PHRASES.strip().split("\n")), re.I)
    related, label = re.compile(RELATED, re.I), re.compile(LABELS, re.I)
    consent = re.compile("|".join(f"(?:{p})" for p in CONSENT.strip().split("\n")), re.I)
    separators = re.compile(r"\s*[|·•›»]\s*|\s+[/>]\s+|\s{2,}|\t")
    ends = re.compile(r"[.!?。！？…:：;；”\"」』)）]\s*$")

    def is_nav(line: str) -> bool:
        low = line.lower().strip()
        if low in NAV:
            return True
        parts = [p for p in separators.split(low) if p]
        if len(parts) > 1:
            known = sum(p in NAV or bool(furniture.fullmatch(p.rstrip("."))) for p in parts)
            # A breadcrumb ends in the page's own title.
            return known * 2 >= len(parts) or (known >= 1 and (parts[0] in NAV or parts[1] in NAV) and len(separators.findall(low)) >= 1 and known >= len(parts) - 1)
        words = low.split()
        return len(words) > 1 and all(w in NAV for w in words)

    def is_furniture(line: str) -> bool:
        line = line.strip()
        if consent.match(line):
            return True
        if furniture.fullmatch(line.rstrip(".。！!")) and not (len(line) > 160 and line.count(". ") > 1):
            parts = [line]
        else:
            parts = [p for p in _BREAK.split(line) if p.strip()]
        return all(furniture.fullmatch(p.strip().rstrip(".。！!")) or is_nav(p.strip().rstrip(".")) for p in parts)

    def headline(text: str) -> bool:
        """A line without an end, as long as a title and no marked list entry: a teaser where it stands in a slot for them."""
        wide = sum(ch >= "\u2e80" for ch in text) * 2 > len(text)
        short, long = (14, 60) if wide else (24, 110)
        return short < len(text) <= long and not ends.search(text) and not re.match(r"[-*•–]\s|\d+[.)]\s", text)

    def not_body(lines: list[str], flags: list[bool], common: list[bool] | None = None) -> list[int]:
        out: list[int] = []
        teasers, bounded, labelled = False, False, False  # in a slot opened by a related line; below a template line; below a label
        waiting: list[int] = []  # titles below a template line, teasers if another one closes their slot
        for n, line in enumerate(lines, 1):
            text = line.strip()
            if not text:
                continue
            bare = text.rstrip(":： ")
            opens = bool(related.fullmatch(bare) and not ends.search(bare))
            # A title is no continuation: what it is depends on its slot.
            continued = bounded and not labelled and not waiting and common is not None and common[n - 1] and not headline(text)
            if opens or is_nav(text) or is_furniture(text) or flags[n - 1] or continued:
                out += [*waiting, n]
                teasers, bounded, labelled, waiting = teasers or opens, True, bool(label.fullmatch(bare)), []
            elif headline(text) and teasers:
                out.append(n)
            elif headline(text) and bounded:
                waiting.append(n)
                if labelled and len(waiting) > 1:
                    out += waiting
                    teasers, waiting = True, []
            else:
                teasers, bounded, waiting = False, False, []
        return out

    return not_body


def _supported(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., stories, pages, vector) of (by..., page, story): distinct stories, pages and the occurrence vector."""
    some = lines.groupBy(*by, "story").agg(F.count("*").alias("n"), F.sum(F.pmod("page", F.lit(1 << 40))).alias("v"))
    return some.groupBy(*by).agg(F.count("*").alias("stories"), F.sum("n").alias("pages"), F.sum("v").alias("vector"))


def _nested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, order, crossed) of each class of each page: a hash of the order of its lines, and whether another class crosses it."""
    for part in parts:
        classes, orders, crossed = [], [], []
        for lines in part.column("lines").to_pylist():
            of: dict[int, list[tuple[int, int]]] = {}
            seen = set()
            for x in lines:
                if x["line"] not in seen:  # a line that comes again counts where it comes first
                    seen.add(x["line"])
                    of.setdefault(x["class"], []).append((x["at"], x["line"]))
            places = {c: np.array([at for at, _ in m]) for c, m in of.items()}
            for c, members in of.items():
                inside = [np.searchsorted(places[c], p) for o, p in places.items() if o != c]
                # Others lie before, after, or in one gap of this class; or this class lies in one gap of theirs.
                bad = any(g.min() != g.max() for g in inside) and any(
                    g.min() != g.max() and (h := np.searchsorted(p, places[c])).min() != h.max() for g, p in zip(inside, [p for o, p in places.items() if o != c]))
                classes.append(c)
                orders.append(hash(tuple(line for _, line in members)))
                crossed.append(bad)
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(orders, pa.int64()), pa.array(crossed, pa.bool_())], names=["class", "order", "crossed"])


def template_lines(lines: DataFrame) -> DataFrame:
    """(line): the deduced template of all hosts; *lines*: (host, page, story, line, at), each line once a page."""
    often = written(_supported(lines, "host", "line").filter(F.col("stories") >= MIN_STORIES).withColumn("class", F.xxhash64("host", "vector", "pages")).select("line", "class", "stories"), "tokens")
    several = often.groupBy("class").agg(F.count("*").alias("members")).filter("members > 1").select("class")
    members = often.join(_few(several), "class", "left_semi").select("line", "class")
    placed = lines.join(_few(members), "line").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "line", "class"))).alias("lines"))
    checked = placed.select("lines").mapInArrow(_nested, "class bigint, order bigint, crossed boolean").groupBy("class").agg(F.min("order").alias("a"), F.max("order").alias("b"), F.bool_or("crossed").alias("crossed"))
    valid = checked.filter("a = b AND NOT crossed").select("class")
    return members.join(valid, "class", "left_semi").select("line").unionByName(often.filter(F.col("stories") >= 2 * MIN_STORIES).select("line")).distinct()


def _few(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table has few rows, else the table as it is."""
    return F.broadcast(df) if df.limit(MOST_SHIPPED // 2 + 1).count() <= MOST_SHIPPED // 2 else df


def _decide(shipped=None):
    """A function for mapInArrow: the lines that are not body. Lines are marked through the *shipped* hashes or by the columns flags and common."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        not_body = make_judge()
        for part in parts:
            kinds, keys, numbers = [], [], []
            marks = {}
            for name, column in (("flags", "tokens"), ("common", "shared")):
                if shipped is None:
                    marks[name] = [[x is not None for x in row] if row is not None else None for row in part.column(name).to_pylist()]
                    continue
                lists, known = part.column(column), shipped.value[name]
                flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
                hit = (known[at] == flat).tolist() if len(known) else [False] * len(flat)
                ends = np.r_[0, np.cumsum(np.array(lists.value_lengths().fill_null(0)))]
                marks[name] = [hit[a:b] for a, b in zip(ends, ends[1:])]
            for n, (kind, key, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("record_kind", "record_key", "text")))):
                lines = text.split("\n")
                flags, common = (x if x and len(x) == len(lines) else [False] * len(lines) for x in (marks["flags"][n], marks["common"][n]))
                for no in not_body(lines, flags, common):
                    kinds.append(kind)
                    keys.append(key)
                    numbers.append(no)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], names=["record_kind", "record_key", "line_no"])

    return run


_FOUND = "record_kind string, record_key string, line_no bigint"


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(record_kind, record_key, line_no) of the non-blank lines outside the main body.

    *pages*: record_kind, record_key, url, publisher, text.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1))
    src = pages.filter(F.trim("text") != "").select("record_kind", "record_key", "text", host.alias("host"), F.coalesce("publisher", F.lit("")).alias("site")).distinct()
    # Only texts with line breaks can have lines around their body; of the others all is one line.
    many = src.filter(F.contains("text", F.lit("\n")))
    mask = lambda line: F.regexp_replace(F.when(F.col("site") != "", F.replace(line, F.col("site"), F.lit("\x02"))).otherwise(line), r"\d+", "9")
    split = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    longest = F.array_max(F.transform(split, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    cut = written(
        many.withColumn("page", F.xxhash64("record_kind", "record_key", "text")).withColumn("story", F.xxhash64(longest))
        .withColumn("shared", F.transform(split, lambda x: F.when(F.length(x) > 0, F.xxhash64(mask(x)))))
        .withColumn("tokens", F.transform("shared", lambda x: F.when(x.isNotNull(), F.xxhash64("host", x)))).withColumn("host", F.xxhash64("host"))
        .select("record_kind", "record_key", "text", "host", "page", "story", "shared", "tokens"),
        "pages",
    )
    nowhere = F.xxhash64(F.lit(""))
    once = lambda c: F.filter(F.array_distinct(c), lambda t: t.isNotNull())
    exploded = cut.filter(F.col("host") != nowhere).select("host", "page", "story", F.posexplode(once("tokens")).alias("at", "line"))
    template = written(template_lines(exploded).withColumn("common", F.lit(False)), "template")
    # A line that is its page's longest is its story, not its template.
    everywhere = _supported(cut.select("page", "story", F.explode(once("shared")).alias("line")), "line").filter(F.col("stories") >= COMMON_STORIES)
    common = written(everywhere.select("line"), "common")
    single = src.filter(~F.contains("text", F.lit("\n"))).select("record_kind", "record_key", "text", *[F.lit(None).cast("array<bigint>").alias(c) for c in ("shared", "tokens")])
    if template.count() + common.count() <= MOST_SHIPPED:
        sorted_ = lambda df: np.sort(df.select("line").toArrow().column(0).to_numpy())
        shipped = pages.sparkSession.sparkContext.broadcast({"flags": sorted_(template), "common": sorted_(common)})
        return cut.select(*single.columns).unionByName(single).mapInArrow(_decide(shipped), _FOUND).distinct()
    marked = cut.select("page", "record_kind", "record_key", "text")
    for name, column, known in (("flags", "tokens", template), ("common", "shared", common)):
        words = cut.select("page", F.transform(column, lambda t: F.coalesce(t, F.lit(0).cast("bigint"))).alias("w")).dropDuplicates(["page"])
        marked = marked.join(map_words(words, "page", "w", known.select("line", F.lit(True).alias("is")), "line", "is", name), "page")
    plain = single.select("record_kind", "record_key", "text", *[F.lit(None).cast("array<boolean>").alias(c) for c in ("flags", "common")])
    return marked.select(*plain.columns).unionByName(plain).mapInArrow(_decide(), _FOUND).distinct()
