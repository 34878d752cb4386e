"""Functions on URLs and on attributes and metadata of pages, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vellumix.functions.text import WS, bound, extension, replaced, squeeze, strip_tags, text_of, trim_ws

#: Fixed values.
INPUT_TYPES = {".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".pdf": "pdf", ".md": "md", ".markdown": "md", ".xml": "xml", ".zip": "zip"}
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp")
CONTENT_TYPES = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp",
    "image/svg+xml": ".svg", "image/webp": ".webp", "image/tiff": ".tiff", "image/x-emf": ".emf", "image/x-wmf": ".wmf",
    "image/emf": ".emf", "image/wmf": ".wmf",
}
SITE_HOSTS = ("mp.weixin.qq.com", "zhihu.com", "csdn.net", "jianshu.com", "juejin.cn", "segmentfault.com", "sspai.com", "cnblogs.com")
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")


def host(url: Column | str) -> Column:
    """The lower-cased host, or nothing for what is no URL."""
    return F.lower(F.regexp_extract(text_of(url), r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]+)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host_within(host_: Column, domain: str) -> Column:
    return (host_ == domain) | host_.endswith(f".{domain}")


def leaf_name(url: Column | str) -> Column:
    """The last path segment, decoded, or the host."""
    leaf = F.regexp_extract(path(url), r"([^/]+)/*\z", 1)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(leaf, r"\+", "%2B")), leaf)
    return F.when(host(url) == "", text_of(url)).when(leaf == "", host(url)).otherwise(decoded)


def input_type(value: Column | str) -> Column:
    """url, a document type by extension, or null."""
    value = trim_ws(text_of(value))
    ext = extension(value)
    kinds = F.coalesce(*[F.when(ext == e, F.lit(t)) for e, t in INPUT_TYPES.items()])
    return F.when(value.rlike(r"(?i)\Ahttps?://"), F.lit("url")).otherwise(kinds)


def image_extension(url: Column | str) -> Column:
    ext = extension(path(url))
    return F.when(ext.isin(*IMAGE_EXTENSIONS), ext).otherwise(".jpg")


def content_type_extension(mime: Column | str) -> Column:
    kind = F.lower(trim_ws(F.element_at(F.split(text_of(mime), ";"), 1)))
    return F.coalesce(*[F.when(kind == m, F.lit(e)) for m, e in CONTENT_TYPES.items()], F.lit(".png"))


def _v4(text: Column) -> Column:
    part = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    parts = F.split(text, r"\.")
    value = sum((F.element_at(parts, i + 1).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(text.rlike(rf"\A{part}(?:\.{part}){{3}}\z"), value)


def private_v4(address: Column | str) -> Column:
    """Whether an IPv4 address is in a private or reserved range; what is no address counts as private."""
    return F.coalesce(_reserved_v4(_v4(text_of(address))), F.lit(True))


def _reserved_v4(value: Column) -> Column:
    hits = F.lit(False)
    for cidr in PRIVATE_V4:
        base, bits = cidr.split("/")
        start = sum(int(p) << (24 - 8 * i) for i, p in enumerate(base.split(".")))
        hits = hits | value.between(start, start + (1 << (32 - int(bits))) - 1)
    return hits


def _v6(text: Column) -> Column:
    """The eight groups of an IPv6 address as numbers, or null; one with a dotted end has that end as two groups."""
    return bound(F.regexp_replace(F.lower(text), r"(?<=[0-9a-f:.])%[0-9a-z.:-]+\z", ""), _groups)


def _groups(text: Column) -> Column:
    dotted = _v4(F.regexp_extract(text, r"\A.*:([0-9.]+)\z", 1))
    low = F.concat(F.lower(F.hex(F.shiftright(dotted, 16))), F.lit(":"), F.lower(F.hex(dotted.bitwiseAND(0xFFFF))))
    text = F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_extract(text, r"\A(.*:)[0-9.]+\z", 1), low)).otherwise(text)
    none = F.array().cast("array<string>")
    groups = lambda half: F.when(half.isNull() | (half == ""), none).otherwise(F.split(half, ":"))

    def filled(halves: Column) -> Column:
        missing = F.lit(8) - F.size(groups(halves[0])) - F.size(groups(F.get(halves, F.lit(1))))
        fits = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing > 0))
        return F.when(fits, F.concat(groups(halves[0]), F.array_repeat(F.lit("0"), missing), groups(F.get(halves, F.lit(1)))))

    numbers = lambda whole: F.when(F.forall(whole, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")), F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long")))
    return bound(F.split(text, "::"), lambda halves: bound(filled(halves), numbers))


def _reserved_v6(g: Column) -> Column:
    """Unspecified, loopback, unique local and link local, or a private IPv4 address inside (mapped, compatible, 6to4, NAT64)."""
    zeros = lambda first, count: F.forall(F.slice(g, first, count), lambda x: x == 0)
    joined = lambda i: F.shiftleft(g[i], 16).bitwiseOR(g[i + 1])
    inner = (
        F.when(zeros(1, 5) & g[5].isin(0, 0xFFFF), joined(6)).when(g[0] == 0x2002, joined(1))
        .when((g[0] == 0x64) & (g[1] == 0xFF9B) & zeros(3, 4), joined(6))
    )
    local = (zeros(1, 7) & g[7].isin(0, 1)) | (g[0].bitwiseAND(0xFE00) == 0xFC00) | (g[0].bitwiseAND(0xFFC0) == 0xFE80)
    return local | F.coalesce(bound(inner, _reserved_v4), F.lit(False))


def private_address(address: Column | str) -> Column:
    """Whether an IPv4 or IPv6 address, bracketed or not, is private or reserved; what is no address counts as private."""
    def judged(text: Column) -> Column:
        v6 = bound(_v6(text), lambda g: F.when(g.isNotNull(), _reserved_v6(g)))
        return F.coalesce(bound(_v4(text), _reserved_v4), v6, F.lit(True))

    return bound(F.regexp_replace(text_of(address), r"\A\[|\]\z", ""), judged)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, or null; the first of several counts."""
    found = rf"""(?is)\A<[^<>]*?[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    has = tag.rlike(found)
    return F.when(has, F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)]))


def meta_content(html: Column, key: str, value: str) -> Column:
    """content of the first meta element whose attribute `key` is `value`."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    fits = F.filter(tags, lambda t: attribute(t, key) == value)
    return attribute(F.try_element_at(fits, F.lit(1)), "content")


def element_text(html: Column, tag: str) -> Column:
    """Squeezed text of the first element of a kind, markup off."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return squeeze(strip_tags(inner))


def first_text(*candidates: Column) -> Column:
    """The first candidate that has text after squeezing."""
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in candidates], F.lit(""))


def title(html: Column, fallback: str = "untitled") -> Column:
    """og:title, the first h1, the title element, or a default."""
    return F.coalesce(F.nullif(first_text(meta_content(html, "property", "og:title"), element_text(html, "h1"), element_text(html, "title")), F.lit("")), F.lit(fallback))


def language(html: Column) -> Column:
    root = F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0)
    return first_text(attribute(root, "lang"), meta_content(html, "http-equiv", "content-language"), meta_content(html, "property", "og:locale"))


def site_name(html: Column, url: Column) -> Column:
    return first_text(meta_content(html, "property", "og:site_name"), meta_content(html, "name", "application-name"), host(url))


def author(html: Column) -> Column:
    """The first author candidate that is no address."""
    found = [squeeze(meta_content(html, k, v)) for k, v in (("name", "author"), ("property", "article:author"), ("name", "twitter:creator"))]
    return F.coalesce(*[F.when((c != "") & ~c.rlike(r"(?i)\Ahttps?://"), c) for c in found], F.lit(""))


def description(html: Column) -> Column:
    return first_text(meta_content(html, "name", "description"), meta_content(html, "property", "og:description"))


def fallback_content(html: Column) -> tuple[Column, Column]:
    """Inner HTML of the first article, main or body with content, and which it was; for pages without nested such elements."""
    inner = {tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1) for tag in ("article", "main", "body")}
    filled = {tag: c.rlike(rf"[^{WS}]") for tag, c in inner.items()}
    content = F.when(filled["article"], inner["article"]).when(filled["main"], inner["main"]).when(filled["body"], inner["body"]).otherwise("")
    label = F.when(filled["article"], "fallback:article").when(filled["main"], "fallback:main").when(filled["body"], "fallback:body").otherwise("fallback:empty")
    return content, label


def attribute_tokens(value: Column) -> Column:
    """Lower-case tokens of a class or id, cut at case changes and at anything but letters and digits."""
    value = F.lower(replaced(text_of(value), ("([a-z0-9])([A-Z])", "$1 $2")))
    return F.filter(F.split(value, "[^a-z0-9]+"), lambda t: t != "")
