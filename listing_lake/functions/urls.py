"""URL expressions: resolve, normalise, host canonicalisation, photo links."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listing_lake.functions.text import blank_to_null, extract, found, let, strip

# --- fixed values: must equal the stored data's rules -------------------------------------------
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "fbclid", "gclid", "dclid", "msclkid",
)
# Shops whose m./www./bare hosts are one shop: canonical host -> hosts.
SHOP_HOSTS = {
    "m.figurepresso.com": ("m.figurepresso.com", "figurepresso.com", "www.figurepresso.com"),
    "ttabbaemall.co.kr": ("ttabbaemall.co.kr", "www.ttabbaemall.co.kr", "m.ttabbaemall.co.kr"),
    "comics-art.co.kr": ("comics-art.co.kr", "www.comics-art.co.kr", "m.comics-art.co.kr"),
    "maniahouse.co.kr": ("maniahouse.co.kr", "www.maniahouse.co.kr", "m.maniahouse.co.kr"),
    "herotime.co.kr": ("herotime.co.kr", "www.herotime.co.kr", "m.herotime.co.kr"),
    "dokidokigoods.co.kr": ("dokidokigoods.co.kr", "www.dokidokigoods.co.kr", "m.dokidokigoods.co.kr"),
    "artplex.co.kr": ("artplex.co.kr", "www.artplex.co.kr", "m.artplex.co.kr"),
    "ittanstore.com": ("ittanstore.com", "www.ittanstore.com", "m.ittanstore.com"),
}
PRODUCT_ID_PARAM = "product_no"
PRODUCT_ID_PATH = r"^/product/(?!detail\.html)(?:[^/]+/)*?(\d+)(?:/category/\d+)?(?:/display/\d+)?/?$"
PRODUCT_URL = "/product/detail.html?product_no={id}"
MAX_URL_LENGTH = 2000
LAZY_ATTRS = ("data-src", "data-original", "data-lazy-src", "data-lazy", "data-echo", "ec-data-src", "src")
TEMPLATE_TOKEN = r"(?i)\{\$|%7B%24"
NOT_A_PHOTO = (
    r"(?i)(?:^|[/_.\-=])(?:logo|icon|ico|favicon|sprite|blank|spacer|pixel|placeholder|"
    r"no[_-]?(?:image|img|photo|thumb)|dummy|loading|ogp|ogimage|share-image|default)(?:[/_.\-?=&]|$)"
    r"|\.(?:svg|ico)(?:$|[?#])"
)
UNTITLED = "(제목 없음)"
UNTITLED_STATUS_HOSTS = ("x.com", "twitter.com", "www.x.com", "www.twitter.com")
UNTITLED_HOME_HOSTS = ("laftel.net", "www.laftel.net")
# Manual shops, first match wins: host suffix, path prefix, source label, shop.
MANUAL_SHOPS = (
    ("laftel.net", "", "Laftel Store", "Laftel"),
    ("brand.naver.com", "/kotobukiyamall", "Kotobukiya Mall (Naver)", "코토부키야 몰(네이버)"),
    ("smartstore.naver.com", "/megahousemall", "Mega House Mall (Naver)", "메가하우스 몰(네이버)"),
)
# ------------------------------------------------------------------------------------------------

_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_AUTHORITY = _AFTER_SCHEME + r"//([^/?#]*)"
_PATH = _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"
_HOST_PORT = r"^(?:\[[^\[\]@]+\]|[^:\[\]@]+)(?::(\d*))?$"


@dataclass(frozen=True)
class UrlParts:
    """Columns for the pieces of a URL that already lost its line breaks."""

    scheme: Column
    authority: Column
    path: Column
    query: Column

    @property
    def host(self) -> Column:
        """Lower-case host without port."""
        return F.lower(F.regexp_replace(self.authority, r":\d*$", ""))

    @property
    def usable(self) -> Column:
        """http(s) with a host, no credentials and a port below 65536."""
        port = F.regexp_extract(self.authority, _HOST_PORT, 1)
        return (
            self.scheme.isin("http", "https")
            & self.authority.rlike(_HOST_PORT)
            & ((port == "") | F.coalesce(port.try_cast("int") <= 65535, F.lit(False)))
        )


def parts(url: Column) -> UrlParts:
    return UrlParts(
        scheme=F.lower(F.regexp_extract(url, _SCHEME, 1)),
        authority=F.regexp_extract(url, _AUTHORITY, 1),
        path=F.regexp_extract(url, _PATH, 1),
        query=F.regexp_extract(url, _QUERY, 1),
    )


def with_parts(url: Column, body: Callable[[UrlParts], Column]) -> Column:
    """`body` over the pieces of a URL that are split once."""
    p = parts(url)
    split = F.struct(
        p.scheme.alias("scheme"), p.authority.alias("authority"), p.path.alias("path"), p.query.alias("query"))
    return let(split, lambda s: body(UrlParts(s["scheme"], s["authority"], s["path"], s["query"])))


def tidy(url: Column) -> Column:
    """Trim, and drop the control characters a URL reader ignores."""
    return F.regexp_replace(F.translate(strip(url), "\t\r\n", ""), r"^[\x00-\x20]+", "")


def _drop_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments (RFC 3986 5.2.4) with an array used as a stack."""
    segments = F.split(path, "/", -1)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments, empty,
        lambda done, seg: F.when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(seg == ".", done).otherwise(F.array_append(done, seg)),
    )
    last = F.element_at(segments, -1)
    closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    whole = F.regexp_replace(F.concat(F.lit("/"), F.array_join(F.concat(kept, closing), "/")), "^//", "/")
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), whole).otherwise(path)


def resolve(ref: Column, base: Column | None) -> Column:
    """Absolute form of `ref` seen from the page `base` (RFC 3986 5.2)."""
    if base is None:
        return tidy(ref)
    return let(tidy(ref), lambda r: let(tidy(base), lambda b: with_parts(
        r, lambda rp: with_parts(b, lambda bp: _resolved(r, rp, b, bp)))))


def _resolved(ref: Column, r: UrlParts, base: Column, b: UrlParts) -> Column:
    own_scheme = (r.scheme != "") & (r.scheme != b.scheme)
    has_authority = ref.rlike(_AFTER_SCHEME + "//")
    query_mark = ref.rlike(r"(?s)^[^#]*\?")
    tail = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    # Empty path: keep the base path, and its query unless the reference brings one.
    stay = F.concat(
        b.path,
        F.when(~query_mark & (b.query != ""), F.concat(F.lit("?"), b.query)).otherwise(""),
        tail,
    )
    folder = F.regexp_replace(b.path, r"(?s)[^/]*$", "")
    joined = F.regexp_replace(F.concat(F.lit("/"), folder, r.path), "/{2,}", "/")
    target = F.when(F.startswith(r.path, F.lit("/")), r.path).otherwise(joined)
    authority = F.concat(b.scheme, F.lit("://"), b.authority)
    return (
        F.when(ref == "", base)
        .when(own_scheme | (b.scheme == ""), ref)
        .when(has_authority, F.concat(b.scheme, F.lit(":"), F.regexp_replace(ref, _AFTER_SCHEME, "")))
        .when(r.path == "", F.concat(authority, stay))
        .otherwise(F.concat(authority, let(target, _drop_dots), tail))
    )


def _param_key(pair: Column) -> Column:
    key = F.split_part(pair, F.lit("="), F.lit(1))
    return F.coalesce(F.try_url_decode(key), key)


def strip_tracking(query: Column, tracking: Sequence[str] = TRACKING_PARAMS) -> Column:
    """Drop tracking parameters; the rest keeps its spelling and order."""
    kept = F.filter(F.split(query, "&", -1), lambda p: ~F.lower(_param_key(p)).isin(*tracking))
    return F.when(query == "", query).otherwise(F.array_join(kept, "&"))


def canonical_shop_url(u: UrlParts) -> Column:
    """Short product URL of a registered shop, or null when no rule applies."""
    before, after = PRODUCT_URL.split("{id}")

    def canonical_host(host: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, hosts in SHOP_HOSTS.items():
            out = F.when(host.isin(*hosts), F.lit(name)).otherwise(out)
        return out

    # The first non-blank value of the id parameter counts; another spelling falls back to the path.
    wanted = F.filter(
        F.split(u.query, "&", -1),
        lambda p: (_param_key(p) == PRODUCT_ID_PARAM) & p.rlike("=."),
    )
    number = F.coalesce(
        blank_to_null(F.regexp_extract(F.try_element_at(wanted, F.lit(1)), r"=(\d+)$", 1)),
        blank_to_null(F.regexp_extract(u.path, PRODUCT_ID_PATH, 1)),
    )
    return let(let(u.host, canonical_host), lambda host: F.when(
        host.isNotNull(), F.concat(u.scheme, F.lit("://"), host, F.lit(before), number, F.lit(after))))


def normalize_url(url: Column, base: Column | None = None, tracking: Sequence[str] = TRACKING_PARAMS) -> Column:
    """The one URL identity of a listing; null when the link cannot be stored."""

    def cleaned(u: UrlParts) -> Column:
        path = F.when((u.path == "") | F.startswith(u.path, F.lit("/")), u.path).otherwise(F.concat(F.lit("/"), u.path))
        query = strip_tracking(u.query, tracking)
        clean = F.struct(
            u.scheme.alias("scheme"), F.lower(u.authority).alias("authority"), path.alias("path"), query.alias("query"))
        return F.when(u.usable, let(clean, lambda s: spelled(UrlParts(s["scheme"], s["authority"], s["path"], s["query"]))))

    def spelled(u: UrlParts) -> Column:
        plain = F.concat(
            u.scheme, F.lit("://"), u.authority, u.path,
            F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(""),
        )
        return F.coalesce(canonical_shop_url(u), plain)

    return let(resolve(url, base), lambda absolute: with_parts(absolute, cleaned))


def doc_id(url_norm: Column) -> Column:
    return F.sha2(url_norm, 256)


def content_id(storage_category: Column, doc: Column) -> Column:
    return F.concat_ws(":", storage_category, doc)


def http_url(url: Column) -> Column:
    """The trimmed URL when it is a plain absolute http(s) link, else null."""
    return let(strip(url), lambda value: F.when(
        (value != "") & (F.length(value) <= MAX_URL_LENGTH) & with_parts(value, lambda u: u.usable), value))


def _unescape(c: Column) -> Column:
    """The character references that occur inside links."""
    out = c
    for pattern, text in (
        (r"&#(?:39|x0*27);|&apos;", "'"), (r"&#(?:34|x0*22);|&quot;", '"'), (r"(?i)&#(?:47|x0*2f);", "/"),
        (r"(?i)&#(?:58|x0*3a);", ":"), (r"(?i)&#(?:61|x0*3d);", "="), (r"(?i)&#(?:63|x0*3f);", "?"),
        (r"&lt;", "<"), (r"&gt;", ">"), (r"&nbsp;", " "), (r"&#(?:38|x0*26);|&amp;?", "&"),
    ):
        out = F.regexp_replace(out, pattern, text)
    return out


def photo_url(value: Column, base: Column | None = None, deny: Column | None = None) -> Column:
    """Absolute link of a photo; null for empty values, templates and site chrome."""

    def chrome(target: Column) -> Column:
        bad = target.rlike(NOT_A_PHOTO)
        if deny is not None:
            bad = bad | F.coalesce(
                F.exists(deny, lambda d: found(target, F.concat(F.lit("(?i)"), d))), F.lit(False))
        return bad

    def usable(raw: Column) -> Column:
        good = (raw != "") & ~raw.rlike(r"(?i)^(?:data|javascript|blob):") & ~raw.rlike(TEMPLATE_TOKEN)
        target = lambda u: F.concat(u.path, F.when(u.query != "", F.concat(F.lit("?"), u.query)).otherwise(""))
        return F.when(good, let(http_url(resolve(raw, base)), lambda url: F.when(
            ~let(with_parts(url, target), chrome), url)))

    return let(_unescape(strip(value)), usable)


def allowed(text: Column, allow: Column, deny: Column, ignore_case: bool = False) -> Column:
    """Some allow pattern matches (when there is any) and no deny pattern does."""
    flag = F.lit("(?i)" if ignore_case else "")

    def hit(patterns: Column) -> Column:
        return F.coalesce(F.exists(patterns, lambda p: found(text, F.concat(flag, p))), F.lit(False))

    return ((F.coalesce(F.size(allow), F.lit(0)) <= 0) | hit(allow)) & ~hit(deny)


def click_url(href: Column, data_href: Column, data_url: Column, onclick: Column, base: Column) -> Column:
    """Link of a rendered element: its attributes in order, else an address inside the click handler."""
    direct = [
        normalize_url(F.when((c != "") & ~F.startswith(F.lower(c), F.lit("javascript:")), c), base)
        for c in (href, data_href, data_url)
    ]
    absolute = F.regexp_extract(onclick, r"https?://[^\s'\"<>]+", 0)
    quoted = F.regexp_extract(onclick, r"['\"](/[^'\"\s<>]*)['\"]", 1)
    handler = F.when(absolute != "", absolute).when(quoted != "", quoted)
    return F.coalesce(*direct, normalize_url(handler, base))


def untitled_leftover(url: Column, title: Column) -> Column:
    """Placeholder-titled status posts and bare home pages that should not be kept."""
    u = parts(tidy(url))
    status = u.host.isin(*UNTITLED_STATUS_HOSTS) & F.contains(u.path, F.lit("/status/"))
    home = u.host.isin(*UNTITLED_HOME_HOSTS) & u.path.isin("", "/")
    return F.coalesce((title == UNTITLED) & (status | home), F.lit(False))


def page_url(url: Column, param: Column, page: Column) -> Column:
    """Listing URL of page N: the parameter replaced at the end of the query; page 1 is untouched."""
    head = F.regexp_extract(url, r"(?s)^[^?#]*", 0)
    query = F.regexp_extract(url, _QUERY, 1)
    fragment = F.regexp_extract(url, r"(?s)#.*$", 0)

    def encode(c: Column) -> Column:
        coded = F.url_encode(F.coalesce(F.try_url_decode(c), c))
        return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & (_param_key(p) != param))
    coded = F.transform(
        kept,
        lambda p: F.concat(
            encode(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="),
            encode(F.regexp_replace(p, r"(?s)^[^=]*=?", "")),
        ),
    )
    last = F.concat(encode(param), F.lit("="), page.cast("string"))
    rebuilt = F.concat(head, F.lit("?"), F.array_join(F.array_append(coded, last), "&"), fragment)
    return F.when(param.isNull() | (param == "") | (page <= 1), url).otherwise(rebuilt)


def manual_shop(url: Column) -> Column:
    """struct(source, shop) of the first matching manual shop, else null."""
    u = parts(url)
    out = F.lit(None).cast("struct<source:string,shop:string>")
    for suffix, prefix, source, shop in reversed(MANUAL_SHOPS):
        hit = ((u.host == suffix) | F.endswith(u.host, F.lit("." + suffix))) & F.startswith(u.path, F.lit(prefix))
        out = F.when(hit, F.struct(F.lit(source).alias("source"), F.lit(shop).alias("shop"))).otherwise(out)
    return out


def apply_host_rules(df: DataFrame, rules: DataFrame, url_norm: str = "url_norm", out: str = "url_canonical") -> DataFrame:
    """Host canonicalisation from a rules table (host, canonical_host, id_param, path_regex, template).

    The rules join on the host; whether they are broadcast is the optimiser's call from their size.
    """
    u = parts(F.col(url_norm))
    value = F.try_element_at(
        F.filter(F.split(u.query, "&", -1), lambda p: _param_key(p) == F.col("_r.id_param")), F.lit(1),
    )
    from_query = F.regexp_extract(value, r"=(\d+)$", 1)
    from_path = extract(u.path, F.col("_r.path_regex"), 1)
    number = F.when(from_query != "", from_query).when(from_path != "", from_path)
    short = F.concat(
        u.scheme, F.lit("://"), F.col("_r.canonical_host"), F.replace(F.col("_r.template"), F.lit("{id}"), number),
    )
    return (
        df.withColumn("_host", u.host)
        .join(rules.select(F.col("host").alias("_host"), F.struct(*[c for c in rules.columns if c != "host"]).alias("_r")),
              "_host", "left")
        .withColumn(out, F.coalesce(short, F.col(url_norm)))
        .drop("_host", "_r")
    )
