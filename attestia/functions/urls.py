"""URL and source expressions, all built in."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of sources in order of priority, their authority and host suffixes.
SOURCE_KINDS: list[tuple[str, float, tuple[str, ...]]] = [
    ("social", 0.25, ("weibo.com", "zhihu.com", "tieba.baidu.com", "reddit.com", "threads.net", "threads.com", "x.com", "twitter.com", "quora.com")),
    ("community", 0.30, ("fandom.com", "baijiahao.baidu.com", "blog.csdn.net", "jianshu.com", "blog.sciencenet.cn")),
    ("entertainment", 0.30, ("open.spotify.com", "music.163.com", "y.qq.com", "music.apple.com")),
    ("dictionary", 0.40, ("wiktionary.org",)),
    ("official", 0.90, ("gov.cn", "gov", "un.org", "who.int", "wmo.int", "ipcc.ch", "imf.org", "worldbank.org", "oecd.org", "unesco.org")),
    ("academic", 0.80, ("edu", "ac.cn", "cas.cn", "edu.cn")),
    ("science", 0.80, ("kepu.gmw.cn", "kepuchina.cn", "cast.org.cn", "sciencenet.cn")),
    ("encyclopedia", 0.45, ("wikipedia.org", "baike.baidu.com", "wikivoyage.org")),
    ("news", 0.70, ("xinhuanet.com", "news.cn", "people.com.cn", "cctv.com", "chinanews.com.cn", "chinanews.com", "thepaper.cn", "gmw.cn")),
]
UNKNOWN_AUTHORITY = 0.55
# Suffixes under which a site has three labels.
LONG_SUFFIXES = ("com.cn", "gov.cn", "edu.cn", "org.cn", "ac.cn", "net.cn", "co.uk", "org.uk")


def host(url: Column) -> Column:
    """Lower-case host; "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def site(h: Column) -> Column:
    """The registrable site of a host: its last two labels, three under LONG_SUFFIXES."""
    last = lambda n: F.substring_index(h, ".", -n)
    return F.when(last(2).isin(*LONG_SUFFIXES), last(3)).otherwise(last(2))


def source_kind(h: Column) -> Column:
    """The first kind in SOURCE_KINDS that the host or a suffix of it belongs to."""
    table = F.create_map(*[F.lit(x) for n, (kind, _, domains) in enumerate(SOURCE_KINDS) for d in domains for x in (d, f"{n}{kind}")])
    labels = F.split(h, r"\.")
    hits = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.try_element_at(table, F.array_join(F.slice(labels, -i, i), ".")))
    return F.coalesce(F.substring(F.array_min(hits), 2, 100), F.lit("unknown"))


def source_authority(kind: Column) -> Column:
    out = F.lit(UNKNOWN_AUTHORITY)
    for k, a, _ in SOURCE_KINDS:
        out = F.when(kind == k, a).otherwise(out)
    return out


# Names of metadata services, and the address ranges that are not public.
METADATA_HOSTS = ("metadata.google.internal", "metadata.google.com", "metadata.azure.com", "169.254.169.254", "100.100.100.200")
PRIVATE = (
    r"^(?:0\.|10\.|127\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.0\.[02]\.|192\.88\.99\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|22[4-9]\.|2[3-5]\d\.)[\d.]+$"
)
PRIVATE_V6 = r"^(?:::|::1|(?:0{1,4}:){7}0{0,3}1|::ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|64:ff9b:.*|100::.*)$"
_AUTHORITY = r"^(?i)(https?)://([^/?#]*)"


def _host_of(authority: Column) -> Column:
    """Host of an authority, without port and trailing dots; an IPv6 literal without its brackets."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"^\[(.*)\]$", "$1"), r"\.+$", "")


def valid_url(url: Column) -> Column:
    """http(s), a host that is neither local nor a metadata service, no credentials or control characters, port absent, 80 or 443, no private literal address."""
    authority = F.lower(F.regexp_extract(url, _AUTHORITY, 2))
    h, port, v6 = _host_of(authority), F.regexp_extract(authority, r":(\d*)$", 1), authority.startswith("[")
    inside = h.isin("localhost", *METADATA_HOSTS) | h.rlike(r"\.(?:localhost|local|internal)$") | h.startswith("metadata.")
    literal = F.when(v6, authority.rlike(r"^\[[0-9a-f:.]+\](?::\d*)?$") & h.contains(":") & ~h.rlike(PRIVATE_V6)).otherwise(~h.rlike(PRIVATE) & ~h.contains("["))
    ok = (F.regexp_extract(url, _AUTHORITY, 1) != "") & (h != "") & ~authority.contains("@") & port.isin("", "80", "443") & ~inside & literal & ~url.rlike(r"[\x00-\x20\x7F]")
    return F.coalesce(ok, F.lit(False))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing dot, "/" for an empty path, no fragment; null where the URL is not valid."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?i)(https?://[^/?#]*)", 1)), r"\.+((?::\d*)?)$", "$1")
    rest = F.regexp_replace(bare, r"^(?i)https?://[^/?#]*", "")
    return F.when(valid_url(url), F.concat(head, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))
