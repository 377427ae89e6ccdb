"""Queries: pages, messages, digests, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.domain import Domain
from broadsheet.functions import extraction as E
from broadsheet.functions import html as H
from broadsheet.functions import text as X
from broadsheet.functions import variant as V
from broadsheet.operators import digest as G

from .registry import plan


def _page(d: Domain):
    return d.spread("pages").select("page_id", "url", "html").withColumn("p", H.page("html", "url"))


def _content(d: Domain):
    return d.spread("pages").select("page_id", E.content("html", F.lit(None).cast("string")).alias("c"))


plan("o234_page_metadata")(lambda d: _page(d).select("page_id", "p.title", "p.description", "p.author", "p.published"))
plan("o233_json_ld_date")(lambda d: _page(d).select("page_id", "p.published"))
plan("o235_primary_images")(lambda d: _page(d).select("page_id", "p.image"))
plan("o236_alternative_links")(lambda d: _page(d).select("page_id", F.array_join("p.alternatives", " ").alias("links")))
plan("o237_selected_content")(lambda d: _content(d).select("page_id", "c.strategy", F.md5("c.content").alias("h"), F.length("c.content").alias("chars")))
plan("o238_scored_candidates")(lambda d: d.spread("pages").select("page_id", F.posexplode(E.scored("html")).alias("place", "c")).select("page_id", "place", "c.score", F.length("c.text").alias("chars")))
plan("o240_extraction_cascade")(
    lambda d: d.spread("pages").select("page_id", E.content("html", F.when(F.col("page_id") % 3 == 0, "article p")).alias("c")).select("page_id", "c.strategy", F.length("c.content").alias("chars"))
)
plan("o239_without_boilerplate")(lambda d: d.spread("pages").select("page_id", E.main_text("html").alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("h")))
plan("o008_page_items")(lambda d: d.spread("pages").select("page_id", F.explode(H.items("html", "url")).alias("i")).select("page_id", "i.title", "i.link", F.length("i.description").alias("chars")))
plan("o172_chat_markup")(lambda d: d.spread("pages").select("page_id", F.md5(H.chat_html("html")).alias("h")))
plan("o173_short_markup")(lambda d: d.spread("pages").select("page_id", E.short_markup(1000)("html").alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("h")))


def _channel(d: Domain):
    """Conversations as channel pages, one a conversation."""
    turn = F.concat(
        F.lit('<div class="tgme_widget_message" data-post="c/'), F.col("turn").cast("string"), F.lit('"><div class="tgme_widget_message_text">'), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit('</div>'), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<i class="photo" style="width:9px;background-image:url(\'https://cdn.example/'), F.col("turn").cast("string"), F.lit(".jpg\')\"></i>"))).otherwise(""),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('<video src="https://cdn.example/'), F.col("turn").cast("string"), F.lit('.mp4"></video>'))).otherwise(""), F.lit('<a class="tgme_widget_message_date" href="https://t.me/c/'), F.col("turn").cast("string"), F.lit('"><time datetime="2024-01-02T03:04:05+00:00"></time></a></div>'),
    )
    return d.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("m")))), lambda x: x["m"]), "").alias("html"))


plan("o007_channel_messages", "SELECT conv_id, turn AS message FROM conversations WHERE (length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) >= 20 OR turn % 2 = 0 OR turn % 3 = 0)")(
    lambda d: _channel(d).select("conv_id", F.explode(H.messages("html")).alias("m")).select("conv_id", F.col("m.message_id").cast("long").alias("message"))
)
plan("o241_message_articles", "SELECT conv_id, turn AS message, concat('https://t.me/c/', turn) AS url, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS h FROM conversations WHERE (length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) >= 20 OR turn % 2 = 0 OR turn % 3 = 0)")(
    lambda d: _channel(d).select("conv_id", F.explode(H.messages("html")).alias("m")).select("conv_id", F.col("m.message_id").cast("long").alias("message"), "m.url", F.md5("m.text").alias("h"))
)
plan(
    "o232_message_media",
    """SELECT conv_id, turn AS message, kind, url FROM (SELECT DISTINCT conv_id, turn FROM conversations) c,
       (VALUES ('image', 2, '.jpg'), ('video', 3, '.mp4')) k(kind, every, ending), LATERAL (SELECT concat('https://cdn.example/', c.turn, k.ending) AS url) WHERE turn % every = 0""",
)(
    lambda d: _channel(d).select("conv_id", F.explode(H.messages("html")).alias("m")).select("conv_id", F.col("m.message_id").cast("long").alias("message"), F.explode("m.media").alias("x"))
    .select("conv_id", "message", F.col("x.type").alias("kind"), "x.url").distinct()
)
def _threads(d: Domain):
    """Conversations as threads in JSON: the first turn is the post, the others are its comments, some by bots or moderators, some with answers."""
    turns = d.table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    listing = lambda kind, children: F.struct(F.lit("Listing").alias("kind"), F.struct(F.transform(children, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("data"))).alias("children")).alias("data"))
    first, key = F.element_at("t", 1), F.col("conv_id")
    post = F.struct(
        F.concat(F.lit("Thread "), key.cast("string")).alias("title"), F.when(key % 3 != 0, first["text"]).otherwise("").alias("selftext"), (key % 2 == 0).alias("is_self"), F.when(key % 5 == 0, "image").alias("post_hint"),
        F.concat(F.lit("https://t.example/"), key.cast("string"), F.when(key % 7 == 0, ".JPG").otherwise("/page")).alias("url"), first["role"].alias("author"), (key * 60 + 1704067200).alias("created_utc"),
    )
    comment = lambda c: F.struct(
        c["text"].alias("body"), F.when(c["turn"] % 4 == 3, "AutoModerator").otherwise(c["role"]).alias("author"), F.when(c["turn"] % 5 == 4, "moderator").alias("distinguished"),
        F.when(c["turn"] % 3 == 1, listing("t1", F.array(F.struct(F.repeat(c["text"], F.lit(2)).alias("body"))))).alias("replies"),
    )
    document = F.concat(F.lit("["), F.to_json(listing("t3", F.array(post))), F.lit(","), F.to_json(listing("t1", F.transform(F.slice("t", 2, 1 << 30), comment))), F.lit("]"))
    return turns.select("conv_id", document.alias("document"))


_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format
plan(
    "o242_thread_articles",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t),
       c AS (SELECT conv_id, {_STRIPPED("text")} AS body, n FROM n WHERE n BETWEEN 2 AND 11 AND length({_STRIPPED("text")}) > 20 AND turn % 4 <> 3 AND turn % 5 <> 4 AND lower(role) NOT IN ('automoderator', 'automod', 'bot')),
       f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n) <= 5),
       b AS (SELECT conv_id, concat(chr(10), chr(10), 'Комментарии:', chr(10), string_agg(body, chr(10) || chr(10) ORDER BY n)) AS below FROM f GROUP BY 1),
       p AS (SELECT n.*, concat('Thread ', conv_id) AS title, CASE WHEN conv_id % 3 <> 0 THEN {_STRIPPED("text")} ELSE '' END AS own, coalesce(below, '') AS below FROM n LEFT JOIN b USING (conv_id) WHERE n = 1)
       SELECT conv_id, role AS author, strftime(to_timestamp(1704067200 + conv_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS published,
         CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 THEN concat('https://t.example/', conv_id, CASE WHEN conv_id % 7 = 0 THEN '.JPG' ELSE '/page' END) END AS image,
         CASE WHEN conv_id % 2 <> 0 AND conv_id % 5 <> 0 THEN concat('https://t.example/', conv_id, CASE WHEN conv_id % 7 = 0 THEN '.JPG' ELSE '/page' END) END AS link,
         md5(CASE WHEN conv_id % 2 = 0 AND own <> '' THEN concat(title, chr(10), chr(10), own) WHEN conv_id % 5 = 0 OR own = '' THEN concat(title, below) ELSE concat(title, chr(10), chr(10), own, below) END) AS h FROM p""",
)(lambda d: _threads(d).select("conv_id", V.thread(F.col("document")).alias("a")).select("conv_id", "a.author", "a.published", "a.image", "a.link", F.md5("a.content").alias("h")))
#: JSON-LD put into the heads of pages: an object, a list, a graph, broken JSON before an object.
_LD = """CASE page_id % 5
    WHEN 0 THEN concat('<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2024-01-', 10 + page_id % 20, '", "author": {"name": "A', page_id, '"}, "image": "/i.png", "articleBody": "', url, '"}</script>')
    WHEN 1 THEN concat('<script id=x type=''application/ld+json''>[{"@type": "BreadcrumbList", "datePublished": 7}, {"@type": "Article", "dateCreated": "2023-02-', 10 + page_id % 20, '", "author": [{"name": "B', page_id, '"}], "image": [{"url": "/l.png"}]}]</script>')
    WHEN 2 THEN concat('<SCRIPT TYPE="application/ld+json"> {"@context": "https://schema.org", "@graph": [{"@type": "WebSite", "image": " "}, {"@type": "Article", "author": "C', page_id, '", "datePublished": "2022-03-', 10 + page_id % 20, '", "image": {"url": "/g.png"}}]} </SCRIPT>')
    WHEN 3 THEN concat('<script type="application/ld+json">{"datePublished": "broken", </script><script type="application/ld+json">{"datePublished": "2021-04-', 10 + page_id % 20, '", "image": ["/m.png", "/n.png"]}</script>') ELSE '' END"""
plan(
    "o233_json_ld_fields",
    """SELECT page_id, CASE WHEN k < 4 THEN concat(['2024-01-', '2023-02-', '2022-03-', '2021-04-'][k + 1], 10 + page_id % 20) END AS published, CASE WHEN k < 3 THEN concat(['A', 'B', 'C'][k + 1], page_id) END AS author,
         ['/i.png', '/l.png', '/g.png', '/m.png', NULL][k + 1] AS image, CASE WHEN k = 0 THEN url END AS body FROM (SELECT *, page_id % 5 AS k FROM pages)""",
)(
    lambda d: d.spread("pages").select("page_id", V.json_ld(F.concat(F.expr(_LD), F.coalesce("html", F.lit("")))).alias("o")).select(
        "page_id", V.published(F.col("o")).alias("published"), V.author(F.col("o")).alias("author"), V.image(F.col("o")).alias("image"), V.article_body(F.col("o")).alias("body")
    )
)


def _lists(d: Domain):
    """Articles on list pages, some ten a page."""
    head = F.concat(F.lit("<article><h2><a href='/"), F.col("id").cast("string"), F.lit("'>"), X.escape_html(F.col("title")), F.lit("</a></h2><time datetime='"), F.date_format("published_at", "yyyy-MM-dd"), F.lit("'>then</time><p>about it</p></article>"))
    return d.articles.where("title IS NOT NULL").groupBy(F.concat("source", F.lit("-"), (F.col("id") % 5).cast("string")).alias("page")).agg(
        F.concat(F.lit("<body><nav><a href=/x>menu</a></nav><main>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", head.alias("m")))), lambda x: x["m"]), "\n"), F.lit("</main></body>")).alias("html")
    )


plan(
    "o008_list_items",
    f"""WITH a AS (SELECT id, concat(source, '-', id % 5) AS page, {_STRIPPED("regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")} AS title, published_at FROM articles)
        SELECT page, title, concat('https://', page, '.example/', id) AS link, strftime(published_at, '%Y-%m-%d') AS published FROM a WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY page, lower(title) ORDER BY id) = 1""",
)(
    lambda d: _lists(d).select("page", F.explode(H.items("html", F.concat(F.lit("https://"), "page", F.lit(".example/list")))).alias("i")).select("page", "i.title", "i.link", "i.published")
)
_BYTES = "CASE page_id % 5 WHEN 0 THEN encode(html, 'UTF-8') WHEN 1 THEN encode(html, 'UTF-16') WHEN 2 THEN encode(regexp_replace(html, '[^\\\\x00-\\\\xff]', '?'), 'ISO-8859-1') WHEN 3 THEN encode(html, 'UTF-8') ELSE unhex(concat('EFBBBF', hex(encode(html, 'UTF-8')))) END"
_DECLARED = "CASE page_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN NULL WHEN 2 THEN 'iso-8859-1' WHEN 3 THEN 'no-such-set' END"
plan("o011_decoded", "SELECT page_id, md5(CASE WHEN page_id % 5 = 2 THEN regexp_replace(html, '[^\\x00-\\x{FF}]', '?', 'g') ELSE html END) AS h FROM pages")(
    lambda d: d.spread("pages").select("page_id", H.decode_bytes(F.expr(_BYTES), F.expr(_DECLARED)).alias("t")).select("page_id", F.md5("t").alias("h"))
)

_BLOCK = "concat('<b>', category, '</b>', chr(10), trim(summary_text), chr(10))"
plan(
    "o247_combined_digest",
    f"""SELECT date, concat('<b>', date, '</b>', chr(10), chr(10), string_agg({_BLOCK}, chr(10) ORDER BY articles_count DESC, category, id), chr(10), chr(10), sum(articles_count), ' / ', count(*)) AS message,
        CAST(length(date) + 7 + sum(length(category) + length(trim(summary_text))) + length(concat(chr(10), sum(articles_count), ' / ', count(*))) AS BIGINT) AS chars, CAST(sum(articles_count) AS BIGINT) AS articles, count(*) AS categories
        FROM daily_summaries WHERE length(trim(summary_text)) >= 20 GROUP BY date""",
)(lambda d: G.combined(d.daily_summaries))
plan(
    "o245_split_digest",
    """WITH RECURSIVE s AS (SELECT date, category, trim(summary_text) AS t, row_number() OVER (PARTITION BY date ORDER BY articles_count DESC, category, id) AS k, count(*) OVER (PARTITION BY date) AS n,
                              sum(articles_count) OVER (PARTITION BY date) AS articles, length(category) + length(trim(summary_text)) + 4 AS room, length(date) + 9 AS head FROM daily_summaries WHERE length(trim(summary_text)) >= 20),
       f AS (SELECT date, k, 1 AS part, head + room AS size FROM s WHERE k = 1
             UNION ALL SELECT s.date, s.k, part + CASE WHEN size + room + 80 > 3600 THEN 1 ELSE 0 END, room + CASE WHEN size + room + 80 > 3600 THEN head ELSE size END FROM f JOIN s ON s.date = f.date AND s.k = f.k + 1),
       g AS (SELECT date, part, string_agg(concat('<b>', category, '</b>', chr(10), t, chr(10)), chr(10) ORDER BY k) AS body, count(*) AS m, any_value(n) AS n, any_value(articles) AS articles FROM f JOIN s USING (date, k) GROUP BY 1, 2),
       p AS (SELECT *, max(part) OVER (PARTITION BY date) AS parts FROM g)
       SELECT date, part, parts, concat('<b>', date, '</b>', chr(10), chr(10), body, chr(10), chr(10), CASE WHEN part = parts THEN concat(articles, ' / ', n) ELSE concat(part, ': ', m, ' / ', n) END) AS message FROM p""",
)(lambda d: G.split(d.daily_summaries))
plan(
    "o246_split_texts",
    """WITH RECURSIVE t AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
       l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t WHERE length(text) > 1000),
       f AS (SELECT r, k, 0 AS part, length(line) + 1 AS size FROM l WHERE k = 1
             UNION ALL SELECT l.r, l.k, part + CASE WHEN size + length(line) + 1 > 1000 THEN 1 ELSE 0 END, length(line) + 1 + CASE WHEN size + length(line) + 1 > 1000 THEN 0 ELSE size END FROM f JOIN l ON l.r = f.r AND l.k = f.k + 1),
       p AS (SELECT r, part, regexp_replace(string_agg(line, chr(10) ORDER BY k), '[ \\t\\n\\x0B\\f\\r]+$', '') AS piece FROM f JOIN l USING (r, k) GROUP BY 1, 2)
       SELECT doc_id, 0 AS part, md5(text) AS h FROM t WHERE length(text) <= 1000 UNION ALL SELECT doc_id, part, md5(piece) FROM p JOIN t USING (r)""",
)(lambda d: G.split_lines(d.table("documents").select("doc_id", F.col("text").alias("t")), "t", 1000).select("doc_id", "part", F.md5("piece").alias("h")))
plan("o131_within_budget", "SELECT id, source_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(length(title) + 20) OVER (PARTITION BY source_id ORDER BY published_at, id ROWS UNBOUNDED PRECEDING) AS running FROM articles) WHERE running <= 5000")(
    lambda d: G.within_budget(d.articles.select("id", "source_id", "published_at", (F.length("title") + 20).cast("long").alias("n")), "source_id", ["published_at", "id"], "n", 5000).select("id", "source_id", "running")
)
plan(
    "o248_balanced_halves",
    """WITH RECURSIVE c AS (SELECT lang, source, count(*) AS n FROM articles GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source NULLS FIRST) AS k FROM c),
       f AS (SELECT lang, source, k, 1 AS half, n AS a, 0::BIGINT AS b FROM s WHERE k = 1
             UNION ALL SELECT s.lang, s.source, s.k, CASE WHEN a <= b THEN 1 ELSE 2 END, CASE WHEN a <= b THEN a + n ELSE a END, CASE WHEN a <= b THEN b ELSE b + n END FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang AND s.k = f.k + 1)
       SELECT lang, source AS name, half FROM f""",
)(lambda d: G.balanced_halves(d.articles.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "lang", "source", "n"))
plan("o013_json_feed", "SELECT id, url FROM articles")(
    lambda d: d.articles.select(F.to_json(F.struct("id", "url", "title", "published_at")).alias("j")).select(F.from_json("j", "id bigint, url string").alias("r")).select("r.*")
)
