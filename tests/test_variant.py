"""JSON of differing shapes: threads, JSON-LD, raw fields, against Python's own JSON; composite labels."""

from __future__ import annotations

import json

import pytest
from broadsheet.functions import html as H
from broadsheet.functions import variant as V
from broadsheet.operators import dedup as Q
from pyspark.sql import functions as F

LONG = "a comment that is long enough"


def comment(body, author="x", **more):
    return {"kind": "t1", "data": {"body": body, "author": author, **more}}


def listing(post, comments=()):
    return [{"kind": "Listing", "data": {"children": [{"kind": "t3", "data": post}]}}, {"kind": "Listing", "data": {"children": list(comments)}}]


def threads(spark, documents):
    df = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "i int, j string")
    return [r.t for r in df.select("i", V.thread(F.col("j")).alias("t")).orderBy("i").collect()]


def test_threads(spark):
    post = {"title": "T", "selftext": " own ", "is_self": True, "author": "me", "created_utc": 1704067200.0, "url": "https://x/y"}
    said = [comment(LONG), comment("short"), comment(LONG, "AutoModerator"), comment(LONG, distinguished="moderator"), {"kind": "more", "data": {}}, comment("[removed]" + " " * 20), comment(None), comment(LONG + "2", None, replies=listing({}, [comment(LONG)])[1]), comment(3), 7, comment("late " * 9)]
    own, linked, image, shown = threads(
        spark, [listing(post, said), listing(post | {"is_self": False}, said), listing(post | {"selftext": "", "is_self": False, "post_hint": "image"}, said), listing(post | {"preview": {"images": [{"source": {"url": "https://p?a&amp;b"}}]}})]
    )
    below = f"\n\nКомментарии:\n{LONG}\n\n{LONG}2"
    assert own.content == "T\n\nown" and own.author == "me" and own.published == "2024-01-01T00:00:00Z" and own.description == "own" and own.image is None and own.link is None
    assert linked.content == "T\n\nown" + below and linked.link == "https://x/y"
    assert image.content == "T" + below and image.image == "https://x/y" and image.link is None and shown.image == "https://p?a&b"
    many = threads(spark, [listing({"title": "T"}, [comment(f"{LONG}{i}") for i in range(9)])])[0].content
    assert many.count(LONG) == 5 and f"{LONG}5" not in many


@pytest.mark.parametrize("document", [None, "", "broken", "[]", "{}", "[1, 2]", listing({}), listing({"title": " "}), [{"data": {"children": []}}], [{"data": 3}, None]])
def test_threads_without_a_post(spark, document):
    assert threads(spark, [document]) == [None]


def test_posts_with_odd_fields(spark):
    assert [t.content for t in threads(spark, [listing({"title": "T", "selftext": 3, "is_self": "maybe", "url": None, "created_utc": "x"}), [listing({"title": "U"})[0]], listing({"title": "V"}, ["x", None])])] == ["T", "U", "V"]


def test_json_ld_as_the_parser_has_it(spark):
    ld = lambda o: f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>'
    pages = [
        ld({"datePublished": "2024-01-02", "image": {"url": "/i"}, "author": {"name": "Ann"}}), ld([{"@type": "B"}, {"dateCreated": "x", "image": "a"}]), ld("{bad") + ld({"@graph": [{"@graph": [{"datePublished": "deep"}]}, {"datePublished": 5}]}),
        None, "", ld("[]"), ld({"datePublished": "  ", "dateCreated": "c"}), "<script>{}</script>", ld({"@graph": {"datePublished": "one"}}),
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").withColumn("o", V.json_ld(F.col("h")))
    got = df.select("i", V.published(F.col("o")).alias("p"), V.image(F.col("o")).alias("m"), V.author(F.col("o")).alias("a")).orderBy("i").collect()
    for page, row in zip(pages, got, strict=True):
        want = H.page_fields(page, None)
        assert (row.p, row.a) == (want["published"], want["author"]), page
    assert got[8].p is None and got[0].m == "/i" and got[1].m == "a"
    plan = df.select(V.published(F.col("o")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


RAW = [
    None, "", "no json", "[]", "{}", {"k": 1}, {"ad_type": "x"}, {"is_advertisement": True}, {"is_advertisement": "false"}, {"is_advertisement": ""}, {"is_advertisement": 0}, {"is_advertisement": 0.0}, {"is_advertisement": -2.5}, {"is_advertisement": None},
    {"is_advertisement": []}, {"is_advertisement": [0]}, {"is_advertisement": {}}, {"is_advertisement": {"a": 1}}, {"advertising_detection": None}, {"is_advertisement": 1, "ad_confidence": 0.5, "ad_type": "t", "ad_reasoning": "r", "ad_markers": ["a", {"b": 1}]},
    {"is_advertisement": 1, "ad_confidence": "0.25"}, {"is_advertisement": 1, "ad_confidence": "high", "ad_type": "t"}, {"is_advertisement": 1, "ad_confidence": None}, {"is_advertisement": 1, "ad_confidence": ""}, {"is_advertisement": 1, "ad_confidence": True},
    {"is_advertisement": 1, "ad_confidence": [1], "ad_type": "t"}, {"is_advertisement": 1, "ad_confidence": 3}, {"is_advertisement": 1, "ad_type": None, "ad_markers": None},
]


def merged(raw):
    """By Python's own truth and float()."""
    out = {"is_advertisement": None, "ad_confidence": 0.125, "ad_type": "own", "ad_reasoning": None, "ad_markers": "[]", "ad_processed": False}
    if isinstance(raw, dict) and ("advertising_detection" in raw or "is_advertisement" in raw):
        out["is_advertisement"] = bool(raw.get("is_advertisement", False))
        new = {k: raw[k] for k in ("ad_type", "ad_reasoning") if k in raw}
        if "ad_markers" in raw:
            new["ad_markers"] = json.dumps(raw["ad_markers"], separators=(",", ":"))
        if "ad_confidence" in raw:
            try:
                new["ad_confidence"] = float(raw["ad_confidence"] or 0.0)
            except (TypeError, ValueError):
                return out
        out |= new | {"ad_processed": True}
    return out


def test_ad_fields(spark):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(RAW)], "i int, raw string")
    fields = V.ad_fields(F.col("raw"), F.lit(None).cast("boolean"), F.lit(0.125), F.lit("own"), F.lit(None).cast("string"), F.lit("[]"), F.lit(False))
    for raw, row in zip(RAW, df.select("i", fields.alias("f")).orderBy("i").collect(), strict=True):
        assert row.f.asDict() == merged(raw), raw


def test_composite_labels(spark):
    labels = [(1, "Tech|Science"), (2, "Tech / Unknown"), (3, "A and B"), (4, "Tech"), (5, None), (6, "Tech, Science | Other"), (7, "|"), (8, "tech/SCIENCE"), (9, "Tech|Tech"), (10, "Science & Tech"), (11, "Tech.and.Science")]
    bridge = spark.createDataFrame([(i, 9) for i in range(1, 13)] + [(4, 8)], "article_id long, category_id long")
    names = spark.createDataFrame([(1, "Tech"), (2, "Science"), (3, "Other")], "id long, name string")
    labelled = spark.createDataFrame(labels, "id long, label string")
    got = sorted(tuple(r) for r in Q.backfilled(bridge, labelled, names).collect())
    # The first separator in their order divides a label, whatever others it has.
    assert got == sorted([(1, 1), (1, 2), (2, 1), (3, 3), (4, 8), (4, 9), (5, 9), (6, 3), (7, 3), (8, 3), (9, 1), (10, 1), (10, 2), (11, 9), (12, 9)])
    assert sorted(r.article_id for r in Q.backfilled(bridge, labelled, names.where("name <> 'Other'")).collect()) == [1, 1, 2, 4, 4, 5, 9, 10, 10, 11, 12]
