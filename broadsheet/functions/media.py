"""Media column functions over arrays of structs and over markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_images(content: Column) -> Column:
    """The images of markup: array<struct<url, thumbnail_url, type, filename, source>>, numbered from 1."""
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?i)<img[^>]+src=[\"']([^\"']+)[\"'][^>]*>"), 1)
    return F.transform(
        found,
        lambda u, i: F.struct(
            F.replace(u, F.lit("&amp;"), F.lit("&")).alias("url"), F.replace(u, F.lit("&amp;"), F.lit("&")).alias("thumbnail_url"), F.lit("image").alias("type"),
            F.concat(F.lit("content_image_"), (i + 1).cast("string"), F.lit(".jpg")).alias("filename"), F.lit("content_html").alias("source"),
        ),
    )


def of_type(media: Column, kind: str) -> Column:
    return F.filter(media, lambda m: m["type"] == kind)


def images_or_fallback(media: Column, image_url: Column) -> Column:
    """URLs of images, or the plain image URL where there is none."""
    urls = F.transform(of_type(media, "image"), lambda m: m["url"])
    return F.when(F.size(urls) > 0, urls).when(image_url.isNotNull(), F.array(image_url)).otherwise(F.array().cast("array<string>"))


def primary_image(media: Column, image_url: Column) -> Column:
    return F.try_element_at(images_or_fallback(media, image_url), F.lit(1))


def counts(media: Column) -> Column:
    return F.struct(*[F.size(of_type(media, k)).alias(f"{k}s") for k in ("image", "video", "document")])


def distinct_by_url(media: Column) -> Column:
    """The first entry of each URL, in order."""
    return F.filter(media, lambda m, i: F.array_position(F.transform(media, lambda x: x["url"]), m["url"]) == i + 1)


def links(markup: Column) -> Column:
    """Addresses in src and href attributes of media elements and links: array<struct<url, type>> by file ending, first of each."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?i)<(?:img|video|source|audio|embed|iframe|a)\b[^>]*?\b(?:src|href)=[\"']([^\"']+)[\"']"), 1))
    path = lambda u: F.lower(F.substring_index(F.substring_index(u, "?", 1), "#", 1))
    kind = lambda u: (
        F.when(path(u).rlike(r"\.(jpe?g|png|gif|webp|bmp|svg)$"), "image").when(path(u).rlike(r"\.(mp4|webm|avi|mov|mkv)$"), "video").when(path(u).rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip)$"), "document").otherwise("link")
    )
    return F.transform(found, lambda u: F.struct(u.alias("url"), kind(u).alias("type")))
