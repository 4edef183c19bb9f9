"""Column expressions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, parameters that are never tracking, social and marketplace hosts, hosts a fetcher must not reach.
TRACKING = "fbclid gclid dclid msclkid yclid mc_cid mc_eid igshid ref_src ref_url _ga _gl".split()
MEANINGFUL = "id sku page p category cat product product_id item item_id q query search sort order".split()
SOCIAL = ("facebook.com fb.com fb.me instagram.com instagr.am twitter.com x.com t.co linkedin.com lnkd.in youtube.com youtu.be tiktok.com vimeo.com twitch.tv wa.me api.whatsapp.com whatsapp.com t.me telegram.me m.me line.me "
          "linktr.ee beacons.ai beacons.page carrd.co foodpanda.pk foodpanda.com ubereats.com doordash.com grubhub.com zomato.com swiggy.com booking.com airbnb.com tripadvisor.com amazon.com daraz.pk ebay.com etsy.com yelp.com yellowpages.com").split()
FORBIDDEN_SUFFIXES = (".local", ".internal", ".localhost", ".lan", ".home")
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata.goog", "100.100.100.200", "192.0.0.192")
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty text where there is none."""
    return F.regexp_extract(url, PARTS, k)


def host(url: Column) -> Column:
    """The host, lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    pieces = F.split(path, "/")
    last = F.element_at(pieces, -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(pieces, 2, F.size(pieces)), none, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def canonical(url: Column) -> Column:
    """Lower scheme and host, no default port, no dot segments, no tracking parameters, sorted query, no fragment."""
    scheme, authority, path, query = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 3), part(url, 4)
    port = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    name = lambda kv: F.lower(F.element_at(F.split(kv, "=", 2), 1))
    tracking = lambda n: ~n.isin(*MEANINGFUL) & (n.isin(*TRACKING) | n.startswith("utm_"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~tracking(name(kv))), lambda kv: F.when(kv.contains("="), kv).otherwise(F.concat(kv, F.lit("="))))
    ordered = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.regexp_replace(kv, "^[^=]*=", "").alias("v")))), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(scheme, F.lit("://"), port, F.when(path == "", "/").otherwise(_without_dots(path)), F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.when(url.rlike(PARTS), whole).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """An absolute http(s) URL from a link on a page; null for other schemes and bare fragments."""
    root = F.concat(F.lower(part(base, 1)), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    return (F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href)).when(href.rlike("^(#|$)") | href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(root, part(base, 3), href)).otherwise(F.concat(root, folder, href)))


def website_kind(url: Column) -> Column:
    """own, social or none, by host and its parent domains."""
    text = F.trim(F.coalesce(url, F.lit("")))
    name = F.regexp_replace(host(F.when(text.contains("://"), text).otherwise(F.concat(F.lit("http://"), text))), r"^www\.", "")
    valid = (F.length(name) <= 253) & name.rlike(r"^([a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$")
    social = name.rlike(r"(^|\.)(" + "|".join(s.replace(".", r"\.") for s in SOCIAL) + ")$")
    return F.when((text == "") | ~valid, "none").when(social, "social").otherwise("own")


def unsafe_reason(url: Column) -> Column:
    """Why a fetcher must not open a URL, or null: scheme, user, host, suffix, metadata endpoint, address range."""
    h = host(url)
    n = F.transform(F.slice(F.split(h, r"\."), 1, 4), lambda p: p.try_cast("int"))
    ip = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    a, b, c = (F.get(n, F.lit(k)) for k in range(3))
    ranges = (F.when(a == 127, "loopback").when((a == 169) & (b == 254), "link_local").when(a.between(224, 239), "multicast").when(a >= 240, "reserved").when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
              .when((a == 0) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)), "reserved"))
    reason = F.when(F.coalesce(url, F.lit("")) == "", "empty URL").when(~F.lower(part(url, 1)).isin("http", "https"), "scheme not allowed").when(part(url, 2).contains("@"), "userinfo in URL").when(h == "", "no hostname")
    for s in FORBIDDEN_SUFFIXES:
        reason = reason.when((h == s[1:]) | h.endswith(s), f"forbidden hostname suffix: {s}")
    return reason.when(h.isin(*METADATA_HOSTS), "cloud metadata endpoint").when(ip & ranges.isNotNull(), F.concat(F.lit("IP literal in "), ranges, F.lit(" range")))
