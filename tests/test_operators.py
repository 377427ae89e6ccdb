from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta
from unittest import mock

import pytest
from broadsheet.operators import dedup as Q
from broadsheet.operators import digest as G
from broadsheet.operators import feed as O
from broadsheet.operators import ranking as R
from broadsheet.sources import feeds, storage
from broadsheet.streaming import state as S
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_ads_are_three_valued(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_advertisement boolean")
    assert [r.id for r in df.where(O.not_advertisement()).collect()] == [2]


def test_search_tokens(spark):
    df = spark.createDataFrame([(1, "Привет мир", None, None), (2, None, "hello", "x 50% off"), (3, "a", "b", "c")], "id int, title string, summary string, content string")
    ids = lambda q: sorted(r.id for r in df.where(O.matches(q)).collect())
    assert ids("ПРИВЕТ") == [1] and ids("he%o off") == [2] and ids("a b c") == [1, 2, 3] and ids("nothing") == []


def test_source_lists(spark):
    articles = spark.createDataFrame([(1, 1), (2, 2)], "id int, source_id long")
    sources = spark.createDataFrame([(1, "abc"), (2, "def")], "id long, name string")
    ids = lambda x: [r.id for r in O.from_sources(articles, sources, x).collect()]
    assert ids("1,def") == [1] and sorted(ids("abc,def")) == [1, 2]


def test_runs(spark):
    flags = [True, True, True, False, True]
    df = spark.createDataFrame([("d", i, f) for i, f in enumerate(flags)] + [("e", 0, False)], "domain string, i int, ok boolean")
    got = {r.domain: (r.consecutive_successes, r.consecutive_failures, r.is_stable) for r in R.last_runs(df, ["domain"], "ok", ["i"]).collect()}
    assert got == {"d": (1, 0, False), "e": (0, 1, False)}


def test_runs_against_a_model(spark):
    random.seed(4)
    rows = [(random.choice(["d", "d", "d", "e", None]), i, random.choice([True, True, False, None])) for i in range(400)]
    want, held = {}, {}
    for domain, i, ok in rows:
        last, n = held.get(domain, (None, 0))
        held[domain] = (ok, n + 1 if ok is not None and ok == last else 1)
        want[i] = held[domain][1]
    df = spark.createDataFrame(rows, "domain string, i int, ok boolean").repartition(6)
    assert {r.i: r.run_length for r in R.runs(df, ["domain"], "ok", ["i"]).collect()} == want


def test_budget_against_a_model(spark):
    random.seed(4)
    rows = [(random.choice(["a", "a", "b", None]), i, random.choice([1, 5, 20, None])) for i in range(300)]
    want, held = {}, {}
    for g, i, n in rows:
        held[g] = held.get(g, 0) + (n or 0)
        if held[g] <= 300:
            want[i] = held[g]
    df = spark.createDataFrame(rows, "g string, i int, n long").repartition(6)
    assert {r.i: r.running for r in G.within_budget(df, "g", ["i"], "n", 300).collect()} == want


def test_frequent_keys_are_in_no_window(spark):
    """Windows are over ranges of a key's rows or over numbers of ranges, never over a key alone."""
    df = spark.createDataFrame([("d", 1, True, 1)], "g string, i int, ok boolean, n long")
    at = spark.createDataFrame([(1, 1, "a", datetime(2024, 1, 1))], "id long, source_id int, title string, fetched_at timestamp_ntz")
    hashed = at.select("id", F.col("title").alias("hash"), F.col("fetched_at").alias("at"))
    for out in (R.runs(df, ["g"], "ok", ["i"]), G.within_budget(df, "g", ["i"], "n", 9), Q.without_recent_titles(at), Q.upsert(df, df, ["g"], "i"), Q.window_duplicates(hashed)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for window in re.findall(r"Window \[.*", plan):
            assert "__part" in window, window
        assert "collect_list" not in plan and "MapInPandas" not in plan


def test_snapshot_diff(spark):
    item = lambda ids: spark.createDataFrame([(i, f"h{i}") for i in ids], "i int, h string")
    assert [r.i for r in Q.new_items(item([2, 3]), item([1, 2]), "h").collect()] == [3]


def test_greedy_keeps_what_a_dropped_row_does_not_mark(spark):
    rows = [(1, 1, 1, "t1", ["u1"]), (1, 2, 2, "t1", ["u2"]), (1, 3, 3, "t2", ["u2"]), (1, 4, 4, "", ["u9"]), (1, 5, 5, "", ["u8"]), (2, 1, 6, "t1", ["u1"])]
    df = spark.createDataFrame(rows, "source_id int, seq int, id long, title string, urls array<string>")
    assert sorted(r.id for r in Q.greedy_by_source(df).collect()) == [1, 3, 4, 5, 6]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4), st.lists(st.integers(0, 5), min_size=1, max_size=2)), max_size=25))
def test_greedy_against_a_model(spark, drawn):
    for folded in (Q.FOLDED, 0, 3):  # all by folding, all in rounds, rounds and then the rest
        with mock.patch.object(Q, "FOLDED", folded):
            _greedy(spark, drawn)


def _greedy(spark, drawn):
    rows = [(s, i, i, f"t{t}", [f"u{u}" for u in us]) for i, (s, t, us) in enumerate(drawn)]
    seen, want = defaultdict(set), []
    for s, _, i, t, us in rows:
        keys = {t, *us}
        if not seen[s] & keys:
            seen[s] |= keys
            want.append(i)
    df = spark.createDataFrame(rows, "source_id int, seq int, id long, title string, urls array<string>")
    assert sorted(r.id for r in Q.greedy_by_source(df).collect()) == want


def test_greedy_rounds_over_a_large_group_and_a_chain(spark):
    large = [(1, i, i, "same", [f"u{i}", f"u{i + 1}"] if i % 3 else [f"v{i}"]) for i in range(3000)]
    chain = [(2, i, 10_000 + i, "", [f"w{i}", f"w{i + 1}"]) for i in range(300)]
    df = spark.createDataFrame(large + chain, "source_id int, seq int, id long, title string, urls array<string>").repartition(8)
    with mock.patch.object(Q, "FOLDED", 10):
        assert sorted(r.id for r in Q.greedy_by_source(df).collect()) == [0, *range(10_000, 10_300, 2)]


def test_window_duplicates_against_a_model(spark):
    random.seed(8)
    t = datetime(2024, 1, 1)
    rows = [(i, random.choice(["h", "h", "h", "g", "f", None]), random.choice([None, *[t + timedelta(hours=random.randint(0, 2000)) for _ in range(9)]])) for i in range(600)]
    want, last = {}, {}
    for i, h, at in sorted(rows, key=lambda r: (r[2] or t, r[0])):
        timed = h is not None and at is not None
        want[i] = timed and h in last and at - last[h] < timedelta(hours=24)
        if timed and not want[i]:
            last[h] = at
    df = spark.createDataFrame(rows, "id long, hash string, at timestamp_ntz").repartition(5)
    assert {r.id: r.duplicate for r in Q.window_duplicates(df).collect()} == want


def test_window_duplicates(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "h", t + timedelta(hours=h)) for i, h in enumerate((0, 23, 25, 48, 49))], "id long, hash string, at timestamp_ntz")
    assert {r.id: r.duplicate for r in Q.window_duplicates(df).collect()} == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_remap_collision(spark):
    df = spark.createDataFrame([(1, 5, 0.5, "x"), (1, 3, 0.9, "y"), (2, 5, None, "X")], "article_id long, category_id long, confidence double, ai_category string")
    got = sorted((r.article_id, r.category_id, r.ai_category) for r in Q.remap(df, "x", 3).collect())
    assert got == [(1, 3, "x"), (2, 3, "X")]


def test_label_cascade(spark):
    labels = spark.createDataFrame([(x,) for x in ("Tech", "Foo", "FOO", "europe", "eu", "Central Europe", "zzz", "", None)], "label string")
    mapping = spark.createDataFrame([("Foo", "Business")], "ai_category string, fixed_category string")
    rules = spark.createDataFrame([("europe", "International", 0), ("cent", "Money", 1)], "key string, target string, priority int")
    got = {r.label: (r.category, r.mapping_source) for r in Q.map_labels(labels, mapping, rules, ["Tech"]).collect()}
    assert got == {
        "Tech": ("Tech", "valid"), "Foo": ("Business", "exact"), "FOO": ("Business", "lower"), "europe": ("International", "rule"), "eu": ("International", "partial"),
        "Central Europe": ("International", "partial"), "zzz": ("Other", "fallback"), "": ("Other", "fallback"), None: ("Other", "fallback"),
    }


def test_labels_by_part_against_a_model(spark):
    random.seed(6)
    said = {"".join(random.choices("abcé ", k=random.randint(1, 9))).strip() for _ in range(300)} - {""}
    rules = [("".join(random.choices("abcé ", k=random.randint(1, 7))), f"t{i}", i) for i in range(60)]
    rows, keys = spark.createDataFrame([(s, s) for s in said] + [("\U0001f600a", "\U0001f600a")], "label string, __low string"), spark.createDataFrame(rules, "key string, target string, priority int")
    want = {s: min((p, t) for k, t, p in rules if k in s or s in k) for s in {*said, "\U0001f600a"} if any(k in s or s in k for k, _, _ in rules)}
    assert want and {r.label: (r.priority, r.target) for r in Q.first_by_part(rows, keys).collect()} == want
    some = Q.first_by_part(rows, keys.unionByName(spark.createDataFrame([("", "all", -1)], keys.schema))).groupBy("label").agg(F.min("priority").alias("p")).collect()
    assert {r.label for r in some} == {*said, "\U0001f600a"} and {r.p for r in some} == {-1}
    assert Q.first_by_part(rows, keys.where("false")).count() == 0 and Q.first_by_part(rows.where("false"), keys).count() == 0
    plan = Q.first_by_part(rows, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" not in plan.lower()


def summaries(spark, sizes):
    return spark.createDataFrame([(i, "2024-01-01", f"c{i}", "x" * n, 100 - i) for i, n in enumerate(sizes)], "id long, date string, category string, summary_text string, articles_count long")


def test_digest_split(spark):
    one = G.split(summaries(spark, [100, 100])).collect()
    assert [(r.part, r.parts) for r in one] == [(1, 1)] and one[0].message.startswith("<b>2024-01-01</b>\n\n<b>c0</b>")
    many = sorted(G.split(summaries(spark, [3000, 3000, 50, 5000, 30, 0])).collect(), key=lambda r: r.part)
    assert [r.part for r in many] == [1, 2, 3, 4] and "c2" in many[1].message and len(many[2].message) > 3600


def test_digest_of_rows_without_category_or_count(spark):
    rows = [(1, "2024-01-01", None, "y" * 30, None), (2, "2024-01-01", "c", "z" * 30, 3), (3, "2024-01-01", "c", None, 3)]
    (r,) = G.split(spark.createDataFrame(rows, "id long, date string, category string, summary_text string, articles_count long")).collect()
    assert r.message == f"<b>2024-01-01</b>\n\n<b>c</b>\n{'z' * 30}\n\n<b></b>\n{'y' * 30}\n\n\n3 / 2"


def test_line_split(spark):
    df = spark.createDataFrame([(1, "aaa\nbbb\nccccccccccccc\nd"), (2, "short")], "i int, t string")
    got = [(r.i, r.piece) for r in G.split_lines(df, "t", 8).orderBy("i", "part").collect()]
    assert got == [(1, "aaa\nbbb"), (1, "ccccccccccccc"), (1, "d"), (2, "short")]


RSS = """<rss><channel><item><title>A</title><link>https://a/1</link><description>d</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0200</pubDate><enclosure url="https://a/i.jpg" type="image/jpeg"/><category>x</category></item>
<item><title>no link</title></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://b/1"/><summary>&lt;img src="https://b/z.png"&gt;</summary><updated>2024-01-01T00:00:00Z</updated></entry></feed>'


def test_feed_entries():
    (a,), (b,) = feeds.feed_entries(RSS), feeds.feed_entries(ATOM)
    assert (a["title"], a["link"], a["image"], a["tags"]) == ("A", "https://a/1", "https://a/i.jpg", ["x"])
    assert (b["title"], b["link"], b["image"]) == ("No title", "https://b/1", "https://b/z.png")
    assert feeds.feed_entries("<broken") == [] and feeds.feed_entries(None) == []


def test_entries_without_a_default_title(spark):
    xml = "<rss><channel>" + "".join(f"<item>{t}<link>{i}</link></item>" for i, t in enumerate(("", "<title/>", "<title> </title>", "<title>t</title>"))) + "</channel></rss>"
    assert [e["title"] for e in feeds.feed_entries(xml)] == ["No title", "No title", "No title", "t"]
    got = spark.createDataFrame([(xml,), (None,), ("<rss",)], "xml string").select(F.inline(feeds.entries_as_they_are("xml")))
    assert [r.title for r in got.collect()] == [None, "", "", "t"]


def test_sources_whose_addresses_are_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "c.xml").write_text("<rss")
    rows = [(f"file://{tmp_path}/a.xml", 1), (str(tmp_path / "b.xml"), 2), (str(tmp_path / "b.xml"), 2), (str(tmp_path / "c.xml"), 3), (str(tmp_path / "missing.xml"), 4), (None, 5)]
    addresses = spark.createDataFrame(rows, "address string, source int")
    got = feeds.read_addresses(addresses.repartition(3), "rss")
    assert sorted(r.link for r in got.collect()) == ["https://a/1", "https://b/1", "https://b/1"] and got.columns == ["source", *feeds.ENTRY.names]
    assert feeds.read_addresses(addresses.limit(0), "telegram").count() == 0
    kinds = spark.createDataFrame([("RSS",), ("page",), ("fax",), (None,)], "t string").select(feeds.reader_of(F.col("t")))
    assert [r[0] for r in kinds.collect()] == ["feed", "page", None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    got = feeds.read_sources(spark, "rss", [str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), str(tmp_path / "missing.xml")])
    assert sorted(r.link for r in got.collect()) == ["https://a/1", "https://b/1"]
    assert sorted(r.link for r in feeds.read_landed(spark, str(tmp_path)).collect()) == ["https://a/1", "https://b/1"]


def test_written_feed_parses_back(spark, tmp_path):
    rows = [(1, "A & B \x01<c>", "https://a/1?x=1&y=2", None, datetime(2024, 1, 1)), (2, None, "https://a/2", "s", None), (3, "new", "https://a/3", "", datetime(2024, 2, 1)), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, url string, summary string, published_at timestamp_ntz").repartition(4)
    folder = tmp_path / "feed"
    for limit, links in ((5, ["https://a/3", "https://a/1?x=1&y=2", "https://a/2"]), (1, ["https://a/3"])):
        feeds.write_feed(df, f"file://{folder}", "T & t", "https://a", limit)
        (written,) = folder.iterdir()  # the one before has gone, and nothing half written is left
        found = feeds.feed_entries(written.read_bytes())
        assert [e["link"] for e in found] == links
    assert found[0]["published"] == "Thu, 01 Feb 2024 00:00:00 -0000"
    feeds.write_feed(df.where("false"), str(folder), "T", "https://a")
    assert feeds.feed_entries(next(folder.iterdir()).read_bytes()) == []


def test_a_failed_feed_leaves_what_was_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "https://a/1", None, datetime(2024, 1, 1))], "id long, title string, url string, summary string, published_at timestamp_ntz")
    feeds.write_feed(df, str(tmp_path), "T", "https://a")
    with pytest.raises(Exception, match="broken"):
        feeds.write_feed(df.withColumn("title", F.raise_error(F.lit("broken"))), str(tmp_path), "T", "https://a")
    assert [e["link"] for p in tmp_path.glob("*.xml") for e in feeds.feed_entries(p.read_bytes())] == ["https://a/1"]


def test_stream_of_sources_reads_what_has_changed(spark, tmp_path):
    """A source that is missing stops nothing and is read when it is there; sources that stay as they are are not read again."""
    def feed(name, *links):
        (tmp_path / name).write_text("<rss><channel>" + "".join(f"<item><title>t</title><link>{x}</link></item>" for x in links) + "</channel></rss>")

    folder, addresses = str(tmp_path / "state"), [str(tmp_path / n) for n in ("a.xml", "b.xml", "c.xml")]

    def arrived():
        out = S.run_available(feeds.stream_sources(spark, "rss", addresses).select("source", "link"), "append", folder).collect()
        last = max((r.batch for r in out), default=None)
        return len(out), sorted(r.link for r in out if r.batch == last)

    feed("a.xml", "a1", "a2")
    feed("b.xml", "b1")
    assert arrived() == (3, ["a1", "a2", "b1"])
    assert arrived()[0] == 3
    feed("b.xml", "b2", "b1")
    feed("c.xml", "c1")
    assert arrived() == (6, ["b1", "b2", "c1"])
    (tmp_path / "a.xml").unlink()
    assert arrived()[0] == 6


def test_dead_letters(spark, tmp_path):
    folder = str(tmp_path / "q")
    df = spark.createDataFrame([(1, "u", "http", 2, None, None, "e"), (2, "u", "parse", 0, None, None, "e")], storage.DEAD_LETTER)
    storage.append_dead_letters(df, folder)
    queue = storage.read_dead_letters(spark, folder)
    stay, archived = storage.after_retry(queue, queue.where("false"), "2024-01-31 00:00:00")
    assert [r.id for r in stay.collect()] == [2] and [r.id for r in archived.collect()] == [1]


def test_snapshots(spark, tmp_path):
    for stamp in ("s1", "s2", "s3"):
        storage.snapshot({"t": spark.range(5)}, str(tmp_path), stamp)
    files = storage.snapshot_files(spark, str(tmp_path))
    assert [r.snapshot for r in storage.history(files).collect()] == ["s3", "s2", "s1"]
    assert [r.snapshot for r in storage.expired(files, 2).collect()] == ["s1"]


def test_state_goes_on_between_runs(spark, tmp_path):
    folder, inbox = str(tmp_path / "state"), str(tmp_path / "in")
    t = datetime(2024, 1, 1)
    schema = "id long, hash string, at timestamp_ntz"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        return {r.id: r.duplicate for r in S.run_available(S.first_within(spark.readStream.schema(schema).parquet(inbox)), "append", folder).collect()}

    assert arrive([(1, "a", t), (2, "a", t + timedelta(hours=1))]) == {1: False, 2: True}
    assert arrive([(3, "a", t + timedelta(hours=23)), (4, "a", t + timedelta(hours=25)), (5, "b", t)]) == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_new_items_of_snapshots(spark, tmp_path):
    """Only the snapshot before counts, over batches too; a page's state is its last snapshot."""
    folder, inbox, t = str(tmp_path / "state"), str(tmp_path / "in"), datetime(2024, 1, 1)
    schema = "page string, snapshot timestamp_ntz, hash string, title string, batch string"

    def arrive(*snapshots):
        rows = [(page, t + timedelta(days=day), h, "t", "x") for page, day, hashes in snapshots for h in hashes]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        out = S.run_available(S.new_on_page(spark.readStream.schema(schema).parquet(inbox)), "append", folder).collect()
        last = max(r.batch for r in out)
        return sorted((r.page, (r.snapshot - t).days, r.hash) for r in out if r.batch == last), spark.read.format("statestore").option("stateVarName", "hashes").load(f"{folder}/state").count()

    assert arrive(("p", 0, "ab"), ("p", 1, "bcc"), ("q", 0, "z")) == ([("p", 0, "a"), ("p", 0, "b"), ("p", 1, "c"), ("q", 0, "z")], 3)
    # a is gone from the last snapshot and new again; d goes on with snapshot 1; the old snapshot of q is not looked at
    assert arrive(("p", 1, "d"), ("p", 2, "abd"), ("q", -1, "y"))[0] == [("p", 1, "d"), ("p", 2, "a")]
    assert arrive(("p", 3, "a"), ("q", 1, "zy"))[0] == [("q", 1, "y")]


def test_login_locks(spark, tmp_path):
    """Five failures lock for five minutes; attempts meanwhile do not count; a success or the end of the lock starts anew; the state goes on between runs."""
    folder, inbox = str(tmp_path / "state"), str(tmp_path / "in")
    t, schema = datetime(2024, 1, 1), "id long, address string, at timestamp_ntz, success boolean"

    def arrive(rows):
        spark.createDataFrame([(i, a, t + timedelta(seconds=s), ok) for i, a, s, ok in rows], schema).write.mode("append").parquet(inbox)
        return {r.id for r in S.run_available(S.login_locks(spark.readStream.schema(schema).parquet(inbox)), "append", folder).collect() if r.locked}

    first = [(i, "a", i, False) for i in range(5)] + [(10 + i, "b", i, i == 3) for i in range(7)] + [(5, "a", 60, True)]
    assert arrive(first) == {5}
    assert arrive([(6, "a", 200, False), (7, "a", 304, False), (8, "a", 305, False), (20, "c", 0, False)]) == {5, 6}


def test_timed_state_ends(spark, tmp_path):
    """Failures that did not lead to a lock are forgotten, and state of keys that nothing is heard of any more goes when the watermark has passed its end."""
    t, schema = datetime(2024, 1, 1), "id long, address string, at timestamp_ntz, success boolean"
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(rows):
        spark.createDataFrame([(i, a, t + timedelta(days=d), ok) for i, a, d, ok in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        out = S.run_available(S.login_locks(spark.readStream.schema(schema).parquet(inbox), 3, 600, "1 day", "2 days"), "append", folder)
        held = spark.read.format("statestore").option("stateVarName", "value").load(f"{folder}/state")
        return {r.id for r in out.collect() if r.locked}, held.count()

    locked, held = arrive([(i, f"a{i}", 0.0, False) for i in range(40)] + [(90, "b", 0, False), (91, "b", 0.001, False)])
    assert locked == set() and held == 41
    # The third failure comes more than two days after the second: it is a first one again.
    locked, held = arrive([(92, "b", 2.1, False), (93, "b", 2.2, False), (94, "b", 2.3, True), (95, "c", 9, False)])
    assert locked == set()
    locked, held = arrive([(96, "c", 9.1, False)])
    assert locked == set() and held <= 2
    assert arrive([(97, "c", 9.2, False), (98, "c", 9.2001, True)]) == ({98}, 1)


def test_state_of_first_rows_ends(spark, tmp_path):
    t, schema = datetime(2024, 1, 1), "id long, hash string, at timestamp_ntz"
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(rows):
        spark.createDataFrame([(i, h, t + timedelta(hours=x)) for i, h, x in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        out = S.run_available(S.first_within(spark.readStream.schema(schema).parquet(inbox), 24, "1 day"), "append", folder)
        return {r.id for r in out.collect() if r.duplicate}, spark.read.format("statestore").option("stateVarName", "value").load(f"{folder}/state").count()

    assert arrive([(i, f"h{i}", 0) for i in range(30)] + [(50, "h0", 23)]) == ({50}, 30)
    assert arrive([(51, "h1", 24), (52, "h2", 23.9), (53, "late", 200)])[0] == {50, 52}
    assert arrive([(54, "late", 201)]) == ({50, 52, 54}, 1)


def test_late_windows(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in (0, 1, 5, 30 % 24)], "ts timestamp_ntz").write.parquet(inbox)
    stream = S.late_windows(spark.readStream.schema("ts timestamp_ntz").parquet(inbox), "ts", "1 hour", "2 hours")
    out = S.run_available(stream, "append", str(tmp_path / "s")).select(F.col("window.start").alias("w"), "n").collect()
    assert {r.w.hour: r.n for r in out}[0] == 2


def test_copy_between_databases(spark):
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    source, target = {"url": "jdbc:derby:memory:one;create=true", **driver}, {"url": "jdbc:derby:memory:two;create=true", **driver}
    spark.createDataFrame([(1, "7"), (2, "8")], "id int, n string").write.format("jdbc").options(**source, dbtable="t", createTableColumnTypes="n varchar(20)").save()
    storage.copy_table(spark, source, target, "t", casts={"n": "int"}, key="id", bounds=(1, 2))
    assert sorted((r[0], r[1]) for r in spark.read.format("jdbc").options(**target, dbtable="t").load().collect()) == [(1, 7), (2, 8)]


def _databases(spark, name):
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    source, target = {"url": f"jdbc:derby:memory:{name}1;create=true", **driver}, {"url": f"jdbc:derby:memory:{name}2;create=true", **driver}
    put = lambda rows, schema, table: spark.createDataFrame(rows, schema).write.format("jdbc").options(**source, dbtable=table).mode("append").save()
    get = lambda table: sorted(map(tuple, spark.read.format("jdbc").options(**target, dbtable=table).load().collect()), key=repr)
    return source, target, put, get


def test_tables_are_copied_in_the_order_of_their_references(spark):
    source, target, put, get = _databases(spark, "refs")
    put([(i, i % 3 - 1 if i % 4 else None, ['{"b": [1, 2.50], "a": null}', "{broken", "", None][i % 4]) for i in range(1, 41)], "id long, flag short, doc string", "parent")
    put([(i, i % 40 + 1) for i in range(1, 101)], "id long, parent_id long", "child")
    put([], "id long, flag short", "nothing")
    storage.execute(
        spark, target,
        'CREATE TABLE parent ("id" BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, "flag" BOOLEAN, "doc" CLOB)',
        'CREATE TABLE child ("id" BIGINT PRIMARY KEY, "parent_id" BIGINT NOT NULL REFERENCES parent)', 'CREATE TABLE nothing ("id" BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, "flag" BOOLEAN)',
        'INSERT INTO parent VALUES (7, true, \'from a copy that was cut off\')',
    )
    tables = {"child": storage.Table("id", ("parent", "elsewhere")), "nothing": storage.Table("id", numbered=True), "parent": storage.Table("id", ("parent",), ("doc",), True)}
    report = storage.copy_tables(spark, source, target, tables, partitions=3, batch=10)
    assert sorted(report) == [("child", 100, 100), ("nothing", 0, 0), ("parent", 40, 40)] and [r[0] for r in report].index("parent") < [r[0] for r in report].index("child")
    want = {i: ((i % 3 != 1) if i % 4 else None, ['{"a":null,"b":[1,2.5]}', "{broken", "", None][i % 4]) for i in range(1, 41)} | {7: (True, "from a copy that was cut off")}
    assert {r[0]: r[1:] for r in get("parent")} == want and len(get("child")) == 100
    assert storage.copy_tables(spark, source, target, tables) == report  # nothing twice
    storage.execute(spark, target, 'INSERT INTO parent ("doc") VALUES (\'next\')')
    assert max(get("parent"), key=lambda r: r[0]) == (41, None, "next")
    for database in (source, target):
        storage.drop_memory_database(spark, database)


def test_copies_without_a_key(spark):
    source, target, put, get = _databases(spark, "keyless")
    put([(1, 5), (1, 5), (None, 0), (2, None)], "id long, flag int", "t")
    storage.execute(spark, target, 'CREATE TABLE t ("id" BIGINT, "flag" BOOLEAN)')
    assert storage.copy_tables(spark, source, target, {"t": storage.Table()}) == [("t", 4, 4)]
    assert get("t") == sorted([(1, True), (1, True), (None, False), (2, None)], key=repr)
    with pytest.raises(ValueError):
        storage.copy_tables(spark, source, target, {"t": storage.Table()})


def test_circles_of_references_are_errors():
    from graphlib import CycleError

    with pytest.raises(CycleError):
        storage.in_order({"a": storage.Table(references=("b",)), "b": storage.Table(references=("a",))})


def test_components(spark):
    from broadsheet.shared import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101)] + [(200 + i, 200) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(60)}}


@pytest.mark.parametrize("shape", ["path", "ring", "comb"])
def test_components_of_long_chains(spark, shape):
    """2,000 nodes in random order settle in about log2(n) rounds, however far apart the ends are."""
    import random

    from broadsheet import shared

    n, rng = 2000, random.Random(shape)
    ids = rng.sample(range(-(10**15), 10**15), n)
    edges = [(ids[i], ids[i + 1]) for i in range(n - 1)]
    if shape == "ring":
        edges.append((ids[-1], ids[0]))
    if shape == "comb":
        edges = [(ids[i], ids[i + 1]) for i in range(n // 2 - 1)] + [(ids[i], ids[n // 2 + i]) for i in range(n // 2)]
    got = shared.components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted([(i, min(ids)) for i in ids] + [(7, 7)])


def test_category_names_that_differ_in_case(spark):
    categories = spark.createDataFrame([(1, "Tech"), (2, "tech"), (3, "Other")], "id long, name string")
    bridge = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "article_id long, category_id long")
    assert sorted(map(tuple, O.category_counts(bridge, categories).collect())) == [("other", 0), ("tech", 3)]


def test_item_hashes(spark):
    """The same as the hash of Python's sorted JSON."""
    import hashlib
    import json

    items = [("T", "https://a.b/?x=1&y", "d" * 150), ('q"\\', None, "a\nb\tc\x08\x0c\r"), ("été 日本 😀\x7f\x00", "/l", None), ("", "", "")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "i int, t string, l string, d string")
    got = [r[0] for r in df.orderBy("i").select(Q.item_hash(F.col("t"), F.col("l"), F.col("d"))).collect()]
    assert got == [hashlib.md5(json.dumps({"title": t or "", "link": x or "", "description": (d or "")[:100]}, sort_keys=True).encode()).hexdigest() for t, x, d in items]


def test_upsert_ties(spark):
    old, new = spark.createDataFrame([(1, 5, "old")], "k int, at int, v string"), spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (1, 5, "a")], "k int, at int, v string")
    for order in (new, new.orderBy("v"), new.orderBy(F.desc("v"))):
        assert [r.v for r in Q.upsert(old, order, ["k"], "at").collect()] == ["c"]


def test_merge_by_url(spark):
    existing = spark.createDataFrame([(1, "u1", "T1", "C1", None, False), (2, "u2", "T2", None, "s", True), (3, "u3", "T3", "C3", "s", False), (4, "u4", "T4", "C4", None, None)], "id long, url string, title string, content string, summary string, processed boolean")
    incoming = spark.createDataFrame([(1, ["u1", "x"], "N", ""), (2, ["u2"], "N", "N"), (3, ["u3", "u1"], "M", None), (4, [None, "", "u3"], None, "N"), (5, ["zz"], "N", "N")], "seq long, urls array<string>, title string, content string")
    assert {r.id: (r.title, r.content) for r in Q.merge_by_url(existing, incoming, ["title", "content"]).collect()} == {1: ("M", "C1"), 3: ("T3", "N")}


def test_merge_by_a_frequent_url(spark):
    old = spark.createDataFrame([(i, "u", None, False, f"o{i}") for i in range(5, 60)] + [(1, "v", "s", True, "kept"), (2, None, None, False, "n")], "id long, url string, summary string, processed boolean, title string")
    new = spark.createDataFrame([(i, ["u", "v"] if i == 7 else ["u"] if i % 2 else [None, ""], f"t{i}" if i < 90 else "") for i in range(100)], "seq long, urls array<string>, title string")
    assert [tuple(r) for r in Q.merge_by_url(old, new, ["title"]).collect()] == [(5, "t89")]


def test_list_page_fallback(spark):
    base = "https://a.b/list/?q=1"
    pages = {
        1: [("https://a.b/list#x", "d"), ("https://a.b/1", "d")], 2: [("https://a.b/list#x", "d"), ("", "d"), ("https://a.b/1", "d")], 3: [("https://a.b/1", "d"), ("https://a.b/1/?z", "d")], 4: [("https://a.b/1", "d" * 5001)],
        5: [("https://a.b/1", "d" * 5000)], 6: [(None, None)], 7: [("https://a.b/1", "d"), ("https://a.b/2", "d" * 9000)],
    }
    df = spark.createDataFrame([(p, base, link, text) for p, xs in pages.items() for link, text in xs], "page int, base string, link string, description string")
    assert {r.page: r.is_fallback for r in Q.list_page_fallback(df).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False}


def test_recent_titles(spark):
    t = datetime(2024, 1, 10)
    rows = [(1, 1, "A", t), (2, 1, "a", t + timedelta(hours=168)), (3, 1, "A", t + timedelta(hours=337)), (4, 2, "a", t), (5, 1, "b", t), (6, 1, "B", t - timedelta(hours=900)), (7, None, "a", t), (8, 1, None, t), (9, 1, None, t)]
    df = spark.createDataFrame(rows, "id long, source_id int, title string, fetched_at timestamp_ntz")
    assert sorted(r.id for r in Q.without_recent_titles(df).collect()) == [1, 3, 4, 5, 7, 8, 9]
