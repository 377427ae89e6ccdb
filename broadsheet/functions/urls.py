"""URL column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, hosts and paths that hold no articles, file endings.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "_ga", "mc_cid", "mc_eid")
SKIP_DOMAINS = ("t.me", "telegram.me", "twitter.com", "x.com", "instagram.com")
MAP_AND_STORE_HOSTS = ("maps.app.goo.gl", "maps.google.com", "maps.google.ru", "2gis.ru", "2gis.com", "waze.com", "play.google.com", "apps.apple.com")
FILE_ENDINGS = (
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "ico", "mp4", "avi", "mov", "wmv", "flv", "mp3", "wav", "ogg", "flac", "zip", "rar", "tar", "gz", "pdf", "doc", "docx", "xls", "xlsx",
)
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
IMAGE_HOST_MARKS = ("telegram.space/file/", "cdn.telegram", "imgur.com/", "i.imgur.com/", "images.", "img.", "static.", "media.", "photo")

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def domain_of(url: Column) -> Column:
    """Lower-case authority with its port; '' where there is no scheme, null for null."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether the text has any of the marks, as a substring: 'x.com' is also in 'netflix.com'."""
    found = F.lit(False)
    for mark in marks:
        found |= F.contains(text, F.lit(mark))
    return found


def is_valid_article_url(url: Column) -> Column:
    """http(s), a host with a dot, and a path that isn't a media file or an archive."""
    host_ok = F.contains(domain_of(url), F.lit("."))
    return F.coalesce(url.rlike("^https?://") & host_ok & ~F.lower(path_of(url)).rlike(rf"\.({'|'.join(FILE_ENDINGS)})$"), F.lit(False))


def is_skipped(url: Column) -> Column:
    return contains_any(F.lower(url), SKIP_DOMAINS)


def is_map_or_store(url: Column) -> Column:
    host, path = domain_of(url), F.lower(path_of(url))
    maps = (F.contains(host, F.lit("google.com")) | F.contains(host, F.lit("yandex"))) & F.contains(path, F.lit("/maps"))
    return contains_any(host, MAP_AND_STORE_HOSTS) | maps


def without_tracking(url: Column) -> Column:
    """The URL without fragment and tracking parameters; other parameters as they are. Not http(s) and no authority: null."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    clean = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.when(domain_of(url) != "", clean)


def looks_like_image(url: Column) -> Column:
    return F.lower(F.substring_index(url, "?", 1)).rlike(rf"\.({'|'.join(IMAGE_ENDINGS)})$")


def is_image_url(url: Column) -> Column:
    """By file ending or by a known image host."""
    low = F.lower(url)
    return low.rlike("^https?://") & (low.rlike(rf"\.({'|'.join((*IMAGE_ENDINGS, 'svg'))})$") | contains_any(low, IMAGE_HOST_MARKS))


def channel_name(url: Column) -> Column:
    """The channel of a messenger URL, or the first path part of anything else."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://(www\.)?", "")
    found = F.regexp_extract(bare, r"(?:t|telegram)\.me/(?:s/)?([^/?#]+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(bare, r"^([^/?#]*)", 1))


def channel_image(url: Column) -> Column:
    """An absolute image URL of a messenger page; its CDN's file paths under the main host."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit("https://t.me"), url)).otherwise(url)
    path = F.regexp_extract(full, r"cdn\d*\.t\.me/file/(.*)", 1)
    return F.when(path != "", F.concat(F.lit("https://t.me/file/"), path)).when(full.rlike("^https?://"), full)


def is_content_image(url: Column) -> Column:
    """Not an emoji, avatar or icon, and with an image ending or on the messenger's CDN."""
    low = F.lower(url)
    out = contains_any(low, ("/img/emoji/", "/userpic/", "/channel_photo/", "/profile_photo/", "16x16", "32x32", "50x50", "64x64", "thumb", "icon", "avatar"))
    return ~out & contains_any(low, (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg", "t.me", "cdn.telegram"))
