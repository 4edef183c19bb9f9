"""Literal cases and properties of single operators."""

import datetime
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import html as H
from assayer.functions import text as T
from assayer.functions import urls as U
from assayer.operators import alerts, cleaning, markup, pages, quality, trust, versions

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "code", "amount"), [("C$10", "USD", 10.0), ("£1,234.50", "GBP", 1234.5), ("24.99 eur $", "EUR", 24.99), ("Free", None, None), ("-3", None, -3.0), ("", None, None), (None, None, None)])
def test_currency(spark, text, code, amount):
    assert one(spark, T.currency_of, text) == code
    assert one(spark, T.amount_of, text) == amount


@pytest.mark.parametrize(("text", "day"), [("22/13/2026", "2026-13-22"), ("2024-99-99x", "2024-99-99"), ("5.7.24", "2024-07-05"), ("soon", None), (None, None)])
def test_dates(spark, text, day):
    assert one(spark, T.normalize_date, text) == day
    assert one(spark, lambda c: T.is_real_date(T.normalize_date(c)), text) is (text == "5.7.24")


@pytest.mark.parametrize(("text", "phone"), [("+92 300-1234567", "+923001234567"), ("0300 1234567", "+923001234567"), ("+12", None), ("000", None), ("", None)])
def test_phones(spark, text, phone):
    assert one(spark, lambda c: T.normalize_phone(c, "PK"), text) == phone


@pytest.mark.parametrize(("url", "wanted"), [("HTTP://A.Example:80/x/../b/./c?utm_a=1&b=2&a=1#f", "http://a.example/b/c?a=1&b=2"), ("https://a.example", "https://a.example/"), ("https://a.example/?q=", "https://a.example/?q="), ("https://a.example/a/..", "https://a.example/"), ("no url", "no url")])
def test_canonical(spark, url, wanted):
    assert one(spark, U.canonical, url) == wanted
    assert one(spark, lambda c: U.canonical(U.canonical(c)), url) == wanted


@pytest.mark.parametrize(("url", "kind"), [("https://www.facebook.com/x", "social"), ("m.facebook.com", "social"), ("https://notfacebook.com", "own"), ("10.0.0.1", "none"), ("", "none"), (None, "none")])
def test_websites(spark, url, kind):
    assert one(spark, U.website_kind, url) == kind


def test_pii_needs_digits_of_the_whole_value(spark):
    assert one(spark, cleaning.pii_kind, "card 4111 1111 1111 1111") == "credit_card"
    assert one(spark, cleaning.pii_kind, "4111 1111 1111 1111 and 4222 2222 2222 2222") != "credit_card"


def test_consensus_tie_goes_to_fewer_sources(spark):
    rows = [(1, "r", "name", "a", "x", 0.5, None), (2, "r", "name", "b", "y", 0.25, "g"), (3, "r", "name", "c", "y", 0.25, "g"), (4, "r", "name", "d", "", 0.9, None)]
    found = trust.triangulate(spark.createDataFrame(rows, "seq long, record_id string, field_name string, source_domain string, value string, trust_score double, independence_group string")).first()
    assert (found.consensus_value, found.total_clusters, len(found.conflicts)) == ("x", 2, 1)
    assert found.confidence == pytest.approx(0.5 * 0.6)


def test_consensus_without_trust_counts_sources(spark):
    rows = [(1, "r", "name", "a", "x", 0.0, "g"), (2, "r", "name", "b", "x", 0.0, "g"), (3, "r", "name", "c", "y", 0.0, None)]
    found = trust.triangulate(spark.createDataFrame(rows, "seq long, record_id string, field_name string, source_domain string, value string, trust_score double, independence_group string")).first()
    assert found.consensus_value == "x" and found.confidence == pytest.approx(2 / 2 * 0.6)


def test_consensus_compares_forms(spark):
    rows = [(1, "r", "product_url", "a", "https://A.example:443/p?utm_source=x", 0.5, None), (2, "r", "product_url", "b", "https://a.example/p#top", 0.5, None), (3, "r", "product_url", "c", "https://a.example/q", 0.5, None),
            (4, "r", None, "a", "X  y", 0.5, None), (5, "r", None, "b", " x Y", 0.5, None), (6, "r", "cost", "a", " \t", 0.5, None), (7, "r", "size", "a", "$2", 0.5, None), (8, "r", "size", "b", "2.0", 0.5, None)]
    df = spark.createDataFrame(rows, "seq long, record_id string, field_name string, source_domain string, value string, trust_score double, independence_group string")
    got = {r.field_name: (r.consensus_value, r.normalized_value, r.n_sources, r.n_conflicts) for r in trust.consensus(df, {"size": "currency"}).collect()}
    assert got == {"product_url": ("https://A.example:443/p?utm_source=x", "https://a.example/p", 2, 1), None: ("X  y", "x y", 2, 0), "size": ("$2", "2.0000", 2, 0)}


@FEW
@given(st.lists(st.tuples(st.sampled_from("rs"), st.sampled_from("abc"), st.sampled_from(["1", "2", "$2.00"]), st.sampled_from([0.25, 0.5])), min_size=1, max_size=8), st.randoms())
def test_consensus_does_not_depend_on_row_order(spark, rows, random):
    rows = [(k, r, "price", s, v, w, None) for k, (r, s, v, w) in enumerate(rows)]
    schema = "seq long, record_id string, field_name string, source_domain string, value string, trust_score double, independence_group string"
    mixed = rows[:]
    random.shuffle(mixed)
    get = lambda x: sorted(map(str, trust.triangulate(spark.createDataFrame(x, schema)).collect()))
    assert get(rows) == get(mixed)


def test_changes_keep_the_last_row_and_ignore_noise(spark):
    schema = "seq long, title string, price string, note string, updated_at string"
    old = spark.createDataFrame([(1, "a", "$1", "x", "1"), (2, "a", "$2", "x", "1"), (3, "b", "$5", "Hi  there", "1"), (4, None, "$9", "x", "1"), (5, "c", "1", "x", "1")], schema)
    new = spark.createDataFrame([(1, "a", "€2", "x", "2"), (2, "b", "$5", " hi there ", "2"), (3, "d", "1", "x", "2")], schema)
    assert {r.identity: r.change_type for r in versions.classify_changes(old, new).collect()} == {"a": "UNCHANGED", "b": "UNCHANGED", "c": "REMOVED", "d": "NEW"}


@FEW
@given(st.lists(st.tuples(st.integers(0, 9), st.text(max_size=4)), max_size=12), st.randoms())
def test_digest_is_free_of_order(spark, rows, random):
    mixed = rows[:]
    random.shuffle(mixed)
    get = lambda x, n: versions.dataset_digest(spark.createDataFrame(x, "a int, b string").repartition(n)).first()
    assert get(rows, 1) == get(mixed, 3)


def test_gate(spark):
    ok = spark.createDataFrame([(True, 1.0, [], "publish")], "passed boolean, score double, failed_rules array<string>, action string")
    bad = spark.createDataFrame([("zscore", "x", "critical", 9.0)], "kind string, field string, severity string, measure double")
    assert quality.publication_gate(ok, bad).first().state == "QUARANTINED"
    assert quality.publication_gate(ok, bad.limit(0)).first().state == "READY"
    with pytest.raises(ValueError, match="justification"):
        quality.override_gate(ok, " ")


def test_cooldown_counts_from_the_last_fired(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("r", "k", k, at + datetime.timedelta(seconds=s), 60) for k, s in enumerate((0, 50, 70, 100, 131))]
    got = alerts.alert_cooldown(spark.createDataFrame(rows, "rule_id string, scope_key string, seq long, at timestamp, cooldown_seconds int"))
    assert sorted(r.seq for r in got.collect()) == [0, 2, 4]


PAGE = """<html><head><script>var t="</p>";</script></head><body><!-- c --><nav><a href="/n">n</a></nav><div class="item big"><b>one<p class=price>$1<p>two</div>
<div class="item"><p class="price" style="display:none">$2</p></div><span class="sr-only">Price 3</span><span class="sr-only"> </span><input type="hidden" name="trap"></body></html>"""


def test_selectors():
    root = H.parse(PAGE)
    assert [n.text() for n in H.select(root, "div.item > p.price, div b .price")] == ["$1", "$2"]
    assert H.select(root, "[type=hidden]")[0].attrs["name"] == "trap"
    clean = pages.clean_html(PAGE)
    assert "nav" not in clean and "<!--" not in clean and "class" not in clean and "script" not in clean
    html, reasons = pages.sanitize_html(PAGE)
    assert reasons == {"html_comment": 1, "tag_script": 1, "hidden_input": 1, "display_none": 1, "empty_accessibility_class": 1}
    assert "Price 3" in html and "$2" not in html


def test_extract_fields_falls_back(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    spec = pages.Selector("p", "css", ".none", fallbacks=(pages.Selector("p", "css", ".price"),))
    rows = {r.page_id: r for r in pages.extract_fields(df, [spec]).collect()}
    assert (rows[1].p, rows[1].p_rung, rows[2].p, rows[2].p_rung) == ("$1", 1, None, -1)


def test_read_usage_stream(spark, tmp_path):
    from assayer.plans.streams import drained
    from assayer.sources.readers import read_usage_stream

    (tmp_path / "a.json").write_text('{"event_id": "1", "quantity": 2, "occurred_at": "2024-01-01T00:00:00Z"}\nbroken\n{"event_id": "2"}\n')
    rows = {r.event_id: r for r in drained(read_usage_stream(spark, str(tmp_path))).collect()}
    assert float(rows["1"].quantity) == 2 and float(rows["2"].quantity) == 0 and rows["2"].metadata == "{}"


def test_every_product_of_a_page(spark):
    block = '<script type="application/ld+json">{}</script>'.format
    product = '{{"@type": "Product", "name": "{0}", "offers": [{{"price": "{1}"}}]}}'.format
    items = ", ".join(f'{{"@type": "ListItem", "item": {product(f"L{k}", k)}}}' for k in range(20))
    rows = [(1, block('{"@type": "ItemList", "itemListElement": [' + items + "]}")),
            (2, block('{"@graph": [{"@type": "WebSite", "name": "Shop"}, {"@type": "Organization", "name": "Org"}, ' + product("G", 5) + "]}") + block("[" + product("A", 1) + ", [" + product("B", 2) + "]]")),
            (3, block('{"@graph": [{"@type": "WebSite", "name": "Shop"}]}') + '<meta property="og:title" content="M">'), (4, block("{broken")), (5, None),
            (6, block('{"@type": ["Product", "Thing"], "name": "T"}') + '<meta property="price" content="9">'), (7, block('{"@type": "Product", "sku": "1"}'))]
    got = markup.extract_structured(spark.createDataFrame(rows, "page_id long, html string"), {"name": ("name", "og:title"), "price": ("offers.0.price", "price")})
    found = sorted((r.page_id, r.name or "", "" if r.price is None else f"{r.price:g}", r.method or "") for r in got.collect())
    assert found == sorted([(1, f"L{k}", str(k), "jsonld") for k in range(20)] + [(2, "G", "5", "jsonld"), (2, "A", "1", "jsonld"), (2, "B", "2", "jsonld"), (3, "M", "", "meta"), (4, "", "", ""), (5, "", "", ""), (6, "T", "", "jsonld"), (7, "", "", "")])


def test_templates_with_any_number_of_slots(spark):
    from itertools import product

    from assayer.sources.readers import expand_url_templates

    rows = [(1, "h/{1..2}/{a, b}/{1..5:2}-{x,y}{0..1}{k}"), (2, "{-1..1}"), (3, "plain"), (4, None), (5, "{8000000000..8000000001}")]
    got = sorted((r.id, r.url) for r in expand_url_templates(spark.createDataFrame(rows, "id long, template string")).collect())
    wanted = [(1, f"h/{a}/{b}/{c}-{d}{e}k") for a, b, c, d, e in product("12", "ab", "531", "xy", "01")]
    assert got == sorted(wanted + [(2, "-1"), (2, "0"), (2, "1"), (3, "plain"), (5, "8000000000"), (5, "8000000001")])
    for wrong in ("a{3..1}", "{1..5:0}"):
        with pytest.raises(Exception, match="range"):
            expand_url_templates(spark.createDataFrame([(1, wrong)], "id long, template string")).collect()
    for wide in ("{1..999999999}{1..999999999}", "{1..99999999999999999999}", "{1..101}{1..100}"):
        with pytest.raises(Exception, match="too many URLs"):
            expand_url_templates(spark.createDataFrame([(1, wide)], "id long, template string")).collect()


@pytest.mark.parametrize(("path", "wanted"), [
    ("//li/b", ["one", "two"]), ("/ul/li[1]/b", ["one"]), ("//li[last()]/b/text()", ["two"]), ("//*[@class='p q']/@id", ["k"]), ("//li[contains(@class, 'q')]//i", ["x", "y"]), ("//b[text()='two']", ["two"]), ("//i[2]", ["y"]), ("//li[@id]/i", ["x", "y"]), ("//u", [])])
def test_xpath(path, wanted):
    root = H.parse('<ul><li class="p q" id="k"><b>one</b><i>x</i><i>y</i></li><li><b>two</b></li></ul>')
    assert H.xpath(root, path) == wanted


def test_wrong_xpath():
    for path in ("//li[position() > 1]", "//li/following-sibling::li"):
        with pytest.raises(ValueError, match="unknown XPath"):
            H.xpath(H.parse("<li>1</li><li>2</li>"), path)


@pytest.mark.parametrize(("selector", "wanted"), [("li:nth-child(2)", ["2"]), ("li:first-child, li:last-child", ["1", "4"]), ("li + li", ["2", "3", "4"]), ("li.a ~ li", ["3", "4"]), ("[data-x^=ab]", ["3"]), ("[data-x$='c']", ["3"]), ("[data-x*=b]", ["3"]), ("[class~=b]", ["2"]), ("ul > li.b", ["2"])])
def test_selectors_of_siblings_places_and_attributes(selector, wanted):
    root = H.parse('<ul><li>1</li><li class="a b">2</li><li data-x="abc">3</li><li>4</li></ul>')
    assert [n.text() for n in H.select(root, selector)] == wanted


def test_pages_with_thousands_of_open_tags(spark):
    deep = "<div>" * 5000 + "<p class=price>$1</p><a href='/x'>go</a><script>s</script>"
    df = spark.createDataFrame([(1, deep), (2, None), (3, "")], "page_id long, html string")
    rows = {r.page_id: r for r in pages.extract_fields(df, [pages.Selector("p", "css", "div .price"), pages.Selector("h", "html", "body"), pages.Selector("x", "xpath", "//a/@href")]).collect()}
    assert (rows[1].p, rows[1].x, rows[2].p, rows[3].p_rung) == ("$1", "/x", None, -1)
    assert pages.extract_tree(df, "a", [pages.Selector("t", "text", "."), pages.Selector("r", "regex", "href=.([^'\"]*)")]).count() == 1
    clean = {r.page_id: r.html for r in pages.clean_pages(df).collect()}
    assert clean[1].count("<div>") == clean[1].count("</div>") == 5000 and "script" not in clean[1] and clean[2] == clean[3] == ""
    assert {r.page_id: dict(r.reasons) for r in pages.sanitize_pages(df).collect()}[1] == {"tag_script": 1}
    assert markup.page_security_report(df).count() == 3


def test_cleaning_twice_changes_nothing(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        once, (shown, _) = pages.clean_html(r.html), pages.sanitize_html(r.html)
        assert pages.clean_html(once) == once and not any(t in once for t in ("<nav", "<script", "<!--", "class=", "<footer"))
        assert pages.sanitize_html(shown) == (shown, {})


def test_selector_kinds_and_nested_specs(spark):
    page = """<ul><li class="p"><b>one</b><i class="r"><u>good</u><s>5</s></i><i class="r"><u>bad</u></i></li><li class="p"><b>two</b></li></ul><li class="next"><a href="/2">n</a></li>
<script>window.__NUXT__ = {"a": {"b": [{"c": "x};"}, {"@type": "T", "c": 7}]}};</script>"""
    data = '<script id="__NEXT_DATA__" type="application/json">{"props": {"ids": ["q", 2]}}</script>'
    df = spark.createDataFrame([(1, page), (2, data), (3, None)], "page_id long, html string")
    S = pages.Selector
    specs = [S("more", "pagination", ""), S("c", "embedded_json", "a.b.c"), S("t", "embedded_json", "a.b.T.c"), S("ids", "embedded_json", "props.ids", pick="all")]
    got = {r.page_id: (r.more, r.c, r.t, r.ids) for r in pages.extract_fields(df, specs).collect()}
    assert got == {1: ("/2", "x};", "7", None), 2: (None, None, None, '["q", "2"]'), 3: (None, None, None, None)}
    tree = [S("name", "text", "b"), S("reviews", "css", ".r", pick="all", children=(S("word", "text", "u"), S("stars", "text", "s"))), S("top", "css", ".none", fallbacks=(S("f", "css", ".r"),), children=(S("word", "text", "u"),))]
    rows = {r["name"]: r for r in pages.extract_tree(df, "li.p", tree).collect()}
    assert [tuple(x) for x in rows["one"].reviews] == [("good", "5"), ("bad", None)] and rows["one"].top.word == "good"
    assert rows["two"].reviews == [] and rows["two"].top is None and len(rows) == 2
    for wrong in ({"kind": "xslt"}, {"kind": "csss"}, {"kind": "css", "pick": "last"}):
        with pytest.raises(ValueError, match="unknown"):
            S(name="x", expression="//a", **wrong)


def test_contacts(spark):
    from assayer.operators import texts

    rows = [(1, "call 123 4567, 12 345 678 or +92 300 1234567; born 2024-01-05 a@b.org"), (2, "0300-1234567 and 0300-1234567, then\t+1 (555)\t123 4567"), (3, None), (4, "")]
    got = {r.k: (r.redacted, r.has_pii) for r in texts.redact_contacts(spark.createDataFrame(rows, "k long, text string")).collect()}
    assert got[1] == ("call 123 4567, 12 345 678 or <PHONE_1>; born 2024-01-05 <EMAIL_1>", True)
    assert got[2] == ("<PHONE_1> and <PHONE_1>, then\t<PHONE_2>", True) and got[4] == ("", False)


@pytest.mark.parametrize(("text", "hints", "wanted"), [
    ("all shoes", None, ("auto", "optional", 5, "xlsx")), ("just this one page", None, ("none", "none", 5, "xlsx")), ("up to 900 pages as json", None, ("auto", "optional", 500, "json")), ("first 1 page with reviews", None, ("none", "required", 1, "xlsx")),
    ("3 page list", None, ("none", "none", 3, "xlsx")), (None, None, ("none", "none", 5, "xlsx")), ("all", ("none", "required", "12"), ("none", "required", 12, "xlsx")), ("all 9 pages", ("", "", "many"), ("auto", "optional", 9, "xlsx")), ("x", ("auto", "", "0"), ("auto", "optional", 5, "xlsx"))])
def test_prompts(spark, text, hints, wanted):
    from assayer.operators import texts

    df = spark.createDataFrame([(text, hints)], "text string, hints struct<pagination: string, detail_pages: string, max_pages: string>")
    row = df.select(*(c.alias(n) for n, c in texts.prompt_tags(F.col("text"), F.col("hints")).items())).first()
    assert tuple(row)[:4] == wanted


def test_crawl_takes_links_in_any_form(spark):
    from assayer.operators import crawl

    edges = spark.createDataFrame([("https://S.example/a?utm_source=z", "https://s.example/b"), ("https://s.example/b#x", "HTTPS://s.example:443/c"), ("https://s.example/c", "ftp://s.example/d"), ("https://s.example/c", "https://s.example/a")], "from_url string, url string")
    seeds = spark.createDataFrame([("https://s.example/a",), ("ftp://s.example/z",)], "url string")
    assert {(r.url[-1], r.depth) for r in crawl.crawl_bfs(edges, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert crawl.crawl_bfs(edges, seeds, 5, policy=crawl.LinkPolicy(max_depth=1)).count() == 2
    assert crawl.crawl_bfs(edges, seeds, 5, policy=crawl.LinkPolicy(exclude=("b$",))).count() == 1


def test_targets_fail_after_their_last_attempt_only(spark):
    from assayer.operators import crawl

    rows = [("a", 1, False, False), ("a", 2, False, False), ("a", 3, True, False), ("b", 1, False, False), ("b", 2, False, False), ("b", 3, False, False), ("b", 4, True, False), ("c", 1, False, False), ("d", 1, True, True), ("d", 2, True, False)]
    got = {r.url: (r.state, r.attempts, r.delay_seconds) for r in crawl.frontier_states(spark.createDataFrame(rows, "url string, seq long, ok boolean, blocked boolean")).collect()}
    assert got == {"a": ("PROCESSED", 3, None), "b": ("FAILED", 3, None), "c": ("RETRY_WAIT", 1, 1.0), "d": ("POLICY_REFUSED", 1, None)}
    finished = spark.createDataFrame([(s, None) for s in crawl.STATES], "state string, retry_at timestamp")
    assert {r.state for r in crawl.frontier_resume(finished).collect()} == {"DISCOVERED", "QUEUED", "RETRY_WAIT"}
    assert all(r.pending for r in crawl.frontier_stats(finished).collect()) and not any(r.pending for r in crawl.frontier_stats(finished.where("state in ('FAILED', 'PROCESSED')")).collect())


def test_streams_in_two_micro_batches_with_late_rows(spark, tmp_path):
    """Micro-batches in time order give the batch twin's rows; rows behind the watermark are left out; state ends."""
    from assayer.plans.streams import drained
    from assayer.streaming import keyed

    start = datetime.datetime(2024, 1, 1)
    schema = "task_id string, seq long, at timestamp, kind string, rule_id string, scope_key string, cooldown_seconds int"
    row = lambda t, k, s, gap=60: (t, k, start + datetime.timedelta(seconds=s), "job_failed", "r", t, gap)
    first = [row("a", 1, 0), row("a", 2, 50), row("b", 3, 55), row("a", 4, 70), row("a", 5, 70)]
    second = [row("a", 6, 100), row("a", 7, 131), row("b", 8, 90_000), row("a", 9, 90_001)]
    third = [row("a", 10, 200), row("a", 11, 90_010)]  # the first of these is a day late
    folder = f"{tmp_path}/in"
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in sorted(p for p in (tmp_path / "in").iterdir() if p.name.startswith("part") and p.suffix == ".parquet" and not p.name.startswith("part-9")):
            if not f.name.startswith("x"):
                f.rename(f.with_name(f"x{k}.parquet"))
    import os
    for k in range(3):
        os.utime(f"{folder}/x{k}.parquet", (k + 1_700_000_000, k + 1_700_000_000))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/x*")
    on_time = spark.createDataFrame([r for r in first + second + third if r[1] != 10], schema)
    got = drained(keyed.alert_cooldown_stream(stream())).collect()
    assert sorted(r.seq for r in got) == sorted(r.seq for r in alerts.alert_cooldown(on_time).collect()) == [1, 3, 4, 7, 8, 9]
    got = {r.seq: r.recent_failures for r in drained(keyed.repeated_failures_stream(stream(), 100)).collect()}
    wanted = {r.seq: r.recent_failures for r in alerts.with_recent_failures(on_time.withColumnsRenamed({}), 100).collect()}
    assert got == wanted and got[4] == got[5] == 4 and got[9] == 1 and 10 not in got


def test_cooldown_jumps_equal_a_row_by_row_fold():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        at = np.sort(rng.integers(0, 300, 40))
        gap = np.repeat(rng.choice([0, 5, 30, 90], 8), 5)
        kept, last = alerts.fires(at, gap, None)
        wanted, before = [], None
        for t, g in zip(at, gap, strict=True):
            wanted.append(before is None or g <= 0 or t - before >= g)
            before = t if wanted[-1] else before
        assert kept.tolist() == wanted and last == before


def test_places_within_a_hot_key(spark):
    from assayer.operators.ranks import numbered

    rows = [("hot", k * 7919 % 1009, 1) for k in range(1009)] + [("cold", 5, 2), (None, 9, 3), (None, 4, 1)]
    got = numbered(spark.createDataFrame(rows, "k string, o long, b long"), "k", [F.asc("o")], "n", {"total": "b"}).collect()
    assert {(r.k, r.o): (r.n, r.total) for r in got} == {**{("hot", k): (k + 1, k + 1) for k in range(1009)}, ("cold", 5): (1, 2), (None, 4): (1, 1), (None, 9): (2, 4)}
    assert numbered(spark.createDataFrame([], "k string, o long"), "k", [F.asc("o")]).count() == 0


def test_sitemap_limits_are_told(spark):
    from assayer.sources.readers import sitemap_urls

    urls = "".join(f"<url><loc>https://a/{k}</loc></url>" for k in range(5))
    rows = [("i", "<sitemapindex>" + "".join(f"<sitemap><loc>c{k}</loc></sitemap>" for k in range(3)) + "</sitemapindex>"), ("c0", f"<urlset>{urls}</urlset>"), ("c1", "<urlset></urlset>"), ("w", f"<urlset>{urls}</urlset>")]
    got = sitemap_urls(spark.createDataFrame(rows, "sitemap_url string, xml string"), 2, 4).collect()
    assert sorted((r.root, r.warning) for r in got if r.warning) == [("i", "children beyond 2 left out"), ("i", "entries beyond 4 left out"), ("w", "entries beyond 4 left out")]
    assert sorted(r.root for r in got if r.url) == ["i"] * 4 + ["w"] * 4


def test_links_in_ordinary_markup(spark):
    from assayer.operators import crawl

    page = """<a href=/u>1</a><a href="/q?a=1&amp;b=2">2</a><!-- <a href="/gone">3</a> --><a title="x>y" href="/late">4</a><a href = '/s p'>5</a><a href='/x"y'>6</a><a data-href="/no">7</a><style>a[href="/css"]{}</style>
<noscript><a href="/ns">8</a></noscript><div style="visibility: hidden"><a href="/v">9</a></div><a href="/twice" href="/second">10</a><a\nhref="/nl">11</a><A HREF=/cut"""
    df = spark.createDataFrame([(1, "https://a.example/dir/p", page), (2, "https://b.example/", None), (3, None, "<a href=/x>x</a><a href=https://c.example/y>y</a>")], "page_id long, url string, html string")
    got = sorted(r.url for r in crawl.page_links(df).collect())
    assert got == sorted([f"https://a.example{p}" for p in ("/u", "/q?a=1&b=2", "/late", "/s p", '/x"y', "/twice", "/nl")] + ["https://c.example/y"])
    assert {r.url[-3:] for r in crawl.page_links(df, hidden=True).collect()} >= {"/ns", "e/v"}


def test_elements_equal_the_tree_of_every_page(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {}
    for r in markup.page_elements(given, ("a", "meta", "title", "li")).collect():
        got.setdefault(r.page_id, []).append((r.tag, dict(r.attrs), r.text))
    for r in given.collect():
        assert got[r.page_id] == [(n.tag, n.attrs, n.text()) for n in H.parse(r.html).walk() if n.tag in ("a", "meta", "title", "li")]


def test_source_of_elements(spark):
    html = "<p>\n<b>one <i>two</b> three<p>four<a href=x>y<a href=z>w</p>&lt;<img src=i><td>"
    root = H.parse(html)
    assert [(n.tag, html[n.start : n.end]) for n in root.walk()] == [
        ("p", "<p>\n<b>one <i>two</b> three"), ("b", "<b>one <i>two</b>"), ("i", "<i>two"), ("p", "<p>four<a href=x>y<a href=z>w</p>"), ("a", "<a href=x>y"), ("a", "<a href=z>w"), ("img", "<img src=i>"), ("td", "<td>")]
    many = "<a href=/x><b>" * 20_000
    df = spark.createDataFrame([(1, "https://a.example/", many)], "page_id long, url string, html string")
    assert markup.page_elements(df, ("a",)).where("length(source) <= 123 and text = ''").count() == 20_000


def test_meta_in_any_order_and_case(spark):
    rows = [(1, '<meta content="M1" property="og:title"><meta content=5 name=price>'), (2, "<meta NAME='Price' CONTENT='1,234.5 USD'><meta property=og:title>"), (3, "<!-- <meta property='og:title' content='x'> -->"), (4, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: (r.name, r.price, r.method) for r in markup.extract_structured(df, {"name": (("name", "headline"), (("property", "og:title"),)), "price": ("offers.price", "price")}).collect()}
    assert got == {1: ("M1", 5.0, "meta"), 2: (None, 1234.5, "meta"), 3: (None, None, None), 4: (None, None, None)}
    only = {r.page_id: r.method for r in markup.extract_structured(df, ["title", "price"]).collect()}
    assert only == {1: None, 2: None, 3: None, 4: None}  # a title alone makes no record, and price has other names there


def test_domain_report_without_rows(spark):
    pages_ = spark.createDataFrame([(1, "https://a.example/", "<p>x</p>")], "page_id long, url string, html string")
    records = spark.createDataFrame([], "page_id long, method string, note string")
    row = markup.domain_security_report(pages_, records, cleaning.null_injections(records)).first()
    assert (row.domain, row.pages, row.stripped, row.records, row.records_after_guard, row.guarded) == ("a.example", 1, 0, 0, 0, False)
    lost = spark.createDataFrame([(9, "css", "fine")], "page_id long, method string, note string")
    rows = {r.domain: r.records for r in markup.domain_security_report(pages_, lost, cleaning.null_injections(lost)).collect()}
    assert rows == {"a.example": 0, None: 1}


@pytest.mark.parametrize(("xml", "wanted"), [
    ("<urlset><url><loc>https://a.example/?x=1&amp;y=2</loc></url></urlset>", ("urlset", ["https://a.example/?x=1&y=2"], [])), ("<urlset><url><loc><![CDATA[https://c.example/]]></loc></url></urlset>", ("urlset", ["https://c.example/"], [])),
    ("<urlset><!-- <url><loc>https://gone/</loc></url> --></urlset>", ("urlset", [], [])), ('<sm:urlset xmlns:sm="x"><sm:url><sm:loc>u</sm:loc></sm:url></sm:urlset>', ("urlset", ["u"], [])), ("<rss/>", ("empty", [], [])), (None, ("empty", [], [])), (" \n", ("empty", [], [])),
    ("<urlset><url>", ("malformed", [], [])), ('<?xml version="1.0" encoding="ISO-8859-1"?><urlset><url><loc>\u00fc</loc><loc> </loc></url><url/></urlset>', ("urlset", ["\u00fc"], [])), ("<sitemapindex><sitemap><loc/></sitemap><sitemap><loc> c </loc></sitemap></sitemapindex>", ("index", [], ["c"])), ("<urlset>\x00</urlset>", ("malformed", [], []))])
def test_sitemaps_are_xml(xml, wanted):
    from assayer.sources.readers import parse_sitemap

    kind, entries, children = parse_sitemap(xml)
    assert (kind, [e["url"] for e in entries], children) == wanted


def test_url_files(spark, tmp_path):
    from assayer.sources.readers import read_url_list

    (tmp_path / "u.csv").write_text("name,URL\na,https://A.example/x\nb,https://a.example/x\nc,ftp://a.example\nd,\n")
    (tmp_path / "u.txt").write_text("# c\n\nhttps://a.example/\nnothing\n")
    for name, wanted in (("u.csv", (3, 1, 1, 1)), ("u.txt", (2, 1, 1, 0))):
        urls, counts = read_url_list(spark, str(tmp_path / name))
        assert urls.count() == 1 and tuple(counts.first()) == wanted
    (tmp_path / "e.txt").write_text("")
    assert tuple(read_url_list(spark, str(tmp_path / "e.txt"))[1].first()) == (0, 0, 0, 0)


def test_limits_within_a_hot_key(spark):
    """One key with all rows: the same rows as a running sum in one window, and no partition is scanned that need not be."""
    import itertools

    from assayer.operators import crawl, metering

    rows = [("hot", k, k % 5, k % 3) for k in range(2000)] + [("cold", 1, 900, 0), ("cold", 2, 1, 0), (None, 1, 3, 3), (None, 2, None, 0)]
    df = spark.createDataFrame(rows, "crawl_id string, seq long, bytes long, seconds long")
    for most in ((10**9, 10**9, 10**9), (700, 10**9, 10**9), (10**9, 801, 10**9), (10**9, 10**9, 1), (10**9, 900, 50), (0, 1, 1)):
        wanted = []
        for key, group in itertools.groupby(rows, key=lambda r: r[0]):
            n = b = s = 0
            for r in group:
                if n < most[0] and b < most[1] and s < most[2]:
                    wanted.append(r)
                n, b, s = n + 1, b + (r[2] or 0), s + r[3]
        assert sorted((str(r.crawl_id), r.seq) for r in crawl.crawl_budget_cut(df, *most).collect()) == sorted((str(r[0]), r[1]) for r in wanted)
    usage = df.selectExpr("crawl_id as job_id", "timestamp_seconds(seq) as at", "seq", "bytes * 100 as tokens", "0.0001D as usd", "0 as credits", "1 as pages", "seconds")
    for budget in (metering.Budget(), metering.Budget(max_usd=0.0503), metering.Budget(max_pages=1999), metering.Budget(max_tokens=10**7, max_usd=9, max_seconds=2000), metering.Budget(max_tokens=10**7, max_usd=9)):
        limits = {"tokens": budget.max_tokens, "usd": budget.max_usd, "pages": budget.max_pages, "seconds": budget.max_seconds}
        got = {r.job_id: (r.trip_seq, r.reason, r.warned) for r in metering.budget_trip(usage, budget).collect()}
        for key, group in itertools.groupby(rows, key=lambda r: r[0]):
            total, hit, warned = dict.fromkeys(limits, 0), None, False
            for r in group:
                for c, v in (("tokens", (r[2] or 0) * 100), ("usd", 0.0001), ("pages", 1), ("seconds", r[3])):
                    total[c] += v
                over = [c for c in limits if total[c] >= limits[c] - (1e-9 if c == "usd" else 0)]
                if over:
                    hit = (r[1], f"max_{over[0]}")
                    break
                warned |= any(c != "seconds" and round(min(1, total[c] / limits[c]), 4) >= 0.8 for c in limits)
            assert got[key] == (*(hit or (None, None)), warned), (key, budget)
    with pytest.raises(Exception, match="negative"):
        metering.budget_trip(usage.withColumn("usd", F.lit(-1.0))).collect()


def test_robots_meet_a_host_once(spark):
    from assayer.operators import crawl

    robots = spark.createDataFrame([("h.example", "User-agent: *\n" + "\n".join(f"Disallow: /d{k}" for k in range(300)) + "\nAllow: /d7/ok")], "host string, text string")
    urls = spark.range(5000).selectExpr("concat('https://h.example/d', id, if(id = 7, '/ok', '')) as url").unionAll(spark.createDataFrame([("https://h.example/d7",)] * 3, "url string"))
    got = crawl.robots_filter(urls, robots).collect()
    assert len(got) == 5003 and sum(r.allowed for r in got) == 1 + sum(not any(str(k).startswith(str(d)) for d in range(300)) for k in range(5000) if k != 7)
    assert crawl.robots_rules(robots).selectExpr("size(rules) as n").first().n == 301


def test_a_crawl_stops_at_its_pages(spark):
    from unittest import mock

    from assayer.operators import crawl

    edges = spark.range(4000).selectExpr("concat('https://s.example/', cast((id - 1) div 3 as bigint)) as from_url", "concat('https://s.example/', id) as url")
    seeds = spark.createDataFrame([("https://s.example/0",)], "url string")
    plain = type(seeds.write).saveAsTable
    with mock.patch.object(type(seeds.write), "saveAsTable", autospec=True, side_effect=plain) as tables:
        rows = crawl.crawl_bfs(edges, seeds, 50, max_pages=30).collect()
    assert sorted((r.depth, r.url) for r in rows)[:4] == [(0, "https://s.example/0"), (1, "https://s.example/1"), (1, "https://s.example/2"), (1, "https://s.example/3")]
    assert [sum(r.depth == d for r in rows) for d in range(5)] == [1, 3, 9, 17, 0] and tables.call_count == 5  # links, seeds, three depths of the eight there are
    assert len(crawl.crawl_bfs(edges, seeds, 50).collect()) == 4000 and not [t for t in spark.catalog.listTables() if "assayer_crawl" in t.name]


def test_messages_of_all_conditions(spark):
    rows = [("job_failed", "{}", "", "", None, None, "job (unknown) failed"), ("quality_below", '{"quality_score": 0.125}', "", "", 0.5, None, "quality score 0.12 below threshold 0.50"), ("record_count_drop", '{"records": 3}', "", "", 20.7, None, "record count 3 below threshold 20"),
            ("circuit_breaker_trip", "{}", "", "", None, None, "circuit breaker tripped: unspecified"), ("circuit_breaker_trip", '{"reason": "max_usd"}', "", "", None, None, "circuit breaker tripped: max_usd"), ("self_healing_event", '{"rung": 2}', "", "d", None, None, "self-healing fired at rung 2 on d"),
            ("self_healing_event", None, "", "", None, None, "self-healing fired at rung ? on page"), ("schema_change", '{"added": ["a", "b"], "removed": []}', "", "", None, None, "schema changed (added=['a', 'b'], removed=[])"), ("budget_threshold", '{"pct": 0.855}', "", "", 0.8, None, "budget at 86% (threshold 80%)"),
            ("unexpected_removals", '{"removed": 7}', "", "", 5.0, None, "7 unexpected removals (threshold 5)"), ("source_conflict_spike", "{}", "", "", 0.0, None, "source conflicts 0 met/exceeded 0"), ("repeated_job_failure", "{}", "j", "", None, 4, "4 failures in window (threshold 3)"), ("else", "{}", "", "", None, None, None)]
    df = spark.createDataFrame(rows, "c string, p string, j string, d string, t double, n long, wanted string")
    for r in df.select("wanted", alerts.message(*map(F.col, "cpjdtn")).alias("m")).collect():
        assert r.m == r.wanted


def test_two_writers_of_one_delivery(spark, tmp_path):
    """The second to commit takes the first's place; what failed before its commit is done again; readers see whole folders only."""
    from unittest import mock

    from assayer.sources import writers

    df, other = spark.range(10).toDF("k"), spark.range(99).toDF("k")
    target, ledger = f"{tmp_path}/out", f"{tmp_path}/ledger"
    first = {}
    plain = writers.commit

    def slow(spark_, path, value):
        if not first:
            first["done"] = None
            first["done"] = writers.write_idempotent(other, target, ledger, "a/b: key")  # another writer is done while this one has staged
        return plain(spark_, path, value)

    with mock.patch.object(writers, "commit", slow):
        place, written = writers.write_idempotent(df, target, ledger, "a/b: key")
    assert first["done"] == (place, True) and not written and spark.read.parquet(place).count() == 99
    assert len([p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]) == 1
    with mock.patch.object(writers, "commit", side_effect=RuntimeError("lost")), pytest.raises(RuntimeError):
        writers.write_idempotent(df, target, ledger, "two")
    place, written = writers.write_idempotent(df, target, ledger, "two")
    assert written and spark.read.parquet(place).count() == 10 and writers.write_idempotent(other, target, ledger, "two") == (place, False)
    assert writers.write_idempotent(df.limit(0), target, ledger, "none") == ("", False)


def test_an_update_rewrites_its_bucket_only(spark, tmp_path):
    from unittest import mock

    from assayer.sources import keyed_tables as K

    path, table = f"{tmp_path}/t", spark.range(1000).selectExpr("id", "0L as seq", "concat('v', id) as name", "id as first")
    K.create_table(table, path, ["id"], 32)
    before = K._current(spark, path)[1]["parts"]
    update = spark.createDataFrame([(7, 1, "new", -1)], "id long, seq long, name string, first long")
    touched = K.upsert_table(update, path, "seq", keep=["first"])
    after = K._current(spark, path)[1]["parts"]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == {str(touched[0])}
    rows = {r.id: (r.seq, r.name, r["first"]) for r in K.read_table(spark, path).collect()}
    assert len(rows) == 1000 and rows[7] == (1, "new", 7) and rows[8] == (0, "v8", 8)
    plain, raced = K.commit, []

    def late(spark_, place, value):  # another writer commits between this one's read and its commit
        if not raced:
            raced.append(1)
            K.upsert_table(spark.createDataFrame([(7, 2, "theirs", -1), (5000, 1, "added", 3)], update.schema), path, "seq", keep=["first"])
        return plain(spark_, place, value)

    with mock.patch.object(K, "commit", late):
        K.upsert_table(spark.createDataFrame([(7, 3, "ours", -1)], update.schema), path, "seq", keep=["first"])
    rows = {r.id: (r.seq, r.name, r["first"]) for r in K.read_table(spark, path).collect()}
    assert rows[7] == (3, "ours", 7) and rows[5000] == (1, "added", 3) and len(rows) == 1001
    K.remove_unused(spark, path)
    assert {r.id: r.seq for r in K.read_table(spark, path).collect()} == {k: v[0] for k, v in rows.items()}
    assert K.upsert_table(update.limit(0), path, "seq") == []
    with pytest.raises(ValueError, match="there is a table"):
        K.create_table(table, path, ["id"])
    with pytest.raises(ValueError, match="no table"):
        K.read_table(spark, f"{tmp_path}/none")


def test_replays_are_written_once(spark, tmp_path):
    """An id that comes again after forty days, in its own batch twice, or in a batch that is tried again, is there once."""
    from assayer.streaming import usage

    at = lambda day: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    schema, target = "event_id string, occurred_at timestamp, v long", f"{tmp_path}/out"
    for rows in ([("a", at(0), 1), ("b", at(0), 2), ("a", at(0), 1)], [("c", at(40), 3)], [("a", at(0), 1), ("d", at(40), 4), (None, None, 5)], [("a", at(0), 1), ("d", at(40), 4), (None, None, 5)]):
        usage.append_once(spark.createDataFrame(rows, schema), target)
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5]
    moved = spark.createDataFrame([("a", at(41), 9)], schema)
    usage.append_once(moved, target, anywhere=True)
    assert spark.read.parquet(target).where("event_id = 'a'").count() == 1


def test_incident_numbers_outlive_their_state(spark, tmp_path):
    """Lists, times and severity as in the batch twin; a key that was silent for longer than `forget` goes on with its next number."""
    import os

    from assayer.plans.streams import drained
    from assayer.streaming import keyed

    start = datetime.datetime(2024, 1, 1)
    row = lambda seq, s, severity, job, ends=0, key="k": ("c", key, start + datetime.timedelta(seconds=s), seq, severity, job, "d", ends)
    schema = "client_id string, dedup_key string, at timestamp, seq long, severity string, job_id string, domain string, ends int"
    files = [[row(1, 0, "info", "j2"), row(2, 5, "critical", "j1"), row(3, 5, None, "", 1)], [row(4, 50_000, "info", "j9", key="open")], [row(5, 200_000, "info", "x", key="other")], [row(6, 400_000, "warning", "j3"), row(7, 400_001, "info", "j9b", key="open")]]
    for k, rows in enumerate(files):
        folder = tmp_path / f"p{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
        (tmp_path / "in").mkdir(exist_ok=True)
        next(folder.glob("part-*.parquet")).rename(tmp_path / "in" / f"x{k}.parquet")
        os.utime(tmp_path / "in" / f"x{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {}
    for r in sorted(drained(keyed.incident_stream(stream, forget=60, late="1 minute"), "update").collect(), key=lambda r: r._batch):
        got[r.dedup_key, r.number] = (r.occurrences, r.severity, r.jobs, r.domains, r.started_at, r.ended_at)
    everything = spark.createDataFrame([r for f in files for r in f], schema)
    twin = alerts.incidents(everything.where("ends = 0"), everything.where("ends = 1").select("client_id", "dedup_key", "at"))
    assert got == {(r.dedup_key, r.number): (r.occurrences, r.severity, r.jobs, r.domains, r.started_at, r.ended_at) for r in twin.collect()}
    assert set(got) == {("k", 1), ("k", 2), ("open", 1), ("other", 1)} and got["open", 1][:3] == (2, "info", ["j9", "j9b"])


def _files_in_order(spark, folder, files: list[list[tuple]], schema: str):
    """A stream that takes one file a micro-batch."""
    import os

    (folder / "in").mkdir()
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{k}")
        next((folder / f"p{k}").glob("part-*.parquet")).rename(folder / "in" / f"x{k}.parquet")
        os.utime(folder / "in" / f"x{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_frontier_stream_takes_its_targets_by_bucket(spark, tmp_path):
    """Python is called once a bucket, not once a target; attempts, ends, late rows and forgetting over micro-batches, with many targets in a bucket and with few."""
    from assayer.plans.streams import drained
    from assayer.streaming import keyed

    row = lambda url, seq, s, ok=False, blocked=False: (url, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), seq, ok, blocked)
    files = [
        [row("a", 1, 0), row("b", 2, 1, True, True), row("c", 3, 2, None, None), row("d", 5, 4), row("d", 4, 3, True), row(None, 6, 5), row("e", 8, 5, True), row("e", 7, 5)],
        [row("a", 9, 20), row("b", 10, 21, True), *(row(f"n{k}", 100 + k, 22, k % 3 == 0) for k in range(300))],
        [row("a", 12, 40, True), row("a", 11, 40)],
        [row("z", 13, 10_000)],
        [row("c", 14, 6, True), row("a", 15, 10_001, True)],  # c is late; a was forgotten
    ]
    stream = _files_in_order(spark, tmp_path, files, "url string, at timestamp, seq long, ok boolean, blocked boolean")
    for buckets in (2, keyed.BUCKETS):
        found = keyed.frontier_stream(stream, forget=60, late="1 minute", buckets=buckets)
        assert re.search(r"FlatMapGroupsInPandasWithState \S+\(_bucket#|FlatMapGroupsInPandasWithState[^\n]*\[_bucket#", found._jdf.queryExecution().analyzed().toString())
        got = {(r._batch, r.url): (r.state, r.attempts, r.delay_seconds) for r in drained(found, "update").collect()}
        few = {k: v for k, v in got.items() if not (k[1] or "").startswith("n")}
        assert few == {
            (0, "a"): ("RETRY_WAIT", 1, 1.0), (0, "b"): ("POLICY_REFUSED", 1, None), (0, "c"): ("RETRY_WAIT", 1, 1.0), (0, "d"): ("PROCESSED", 1, None), (0, None): ("RETRY_WAIT", 1, 1.0), (0, "e"): ("PROCESSED", 2, None),
            (1, "a"): ("RETRY_WAIT", 2, 2.0), (1, "b"): ("POLICY_REFUSED", 1, None), (2, "a"): ("FAILED", 3, None), (3, "z"): ("RETRY_WAIT", 1, 1.0), (4, "a"): ("PROCESSED", 1, None),
        }
        assert {k[1]: v[0] for k, v in got.items() if k not in few} == {f"n{k}": "PROCESSED" if k % 3 == 0 else "RETRY_WAIT" for k in range(300)}


def test_a_late_row_does_not_close_an_open_incident(spark, tmp_path):
    """Nor does it touch its neighbours in the bucket: both go on as they were."""
    from assayer.plans.streams import drained
    from assayer.streaming import keyed

    row = lambda seq, s, key, ends=0: ("c", key, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), seq, "info", f"j{seq}", "d", ends)
    files = [[row(1, 0, "k"), row(2, 0, "closed"), row(3, 1, "closed", 1)], [row(4, 10_000, "x")], [row(5, 1, "k")], [row(6, 20_000, "x")], [row(9, 20_001, "x")], [row(7, 20_002, "k"), row(8, 20_002, "closed")]]
    stream = _files_in_order(spark, tmp_path, files, "client_id string, dedup_key string, at timestamp, seq long, severity string, job_id string, domain string, ends int")
    rows = drained(keyed.incident_stream(stream, forget=60, late="1 minute", buckets=1), "update").collect()
    last = {(r.dedup_key, r.number): (r.occurrences, r.jobs, r.status) for r in sorted(rows, key=lambda r: r._batch)}
    assert last == {("k", 1): (2, ["j1", "j7"], "open"), ("closed", 1): (1, ["j2"], "resolved"), ("closed", 2): (1, ["j8"], "open"), ("x", 1): (3, ["j4", "j6", "j9"], "open")}


def test_script_family_reads_a_text_twice(spark):
    from assayer.operators import texts

    samples = ["", "12 34 !?", "abc", "Ünï × ÷ ɏ", "привет мир", "你好世界 hi", "ab你好", "Καλη abcd", "กขค한글עברית नम", "ﷺ العربية", "x\U0001F600я", "ɐͯĀ"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(samples)], "k long, x string").repartition(2)
    found = df.withColumn("s", texts.script_family(F.col("x"))).select("k", "s.script", "s.share")
    for r in found.collect():
        counts = {name: len(re.sub(f"[^{chars}]", "", samples[r.k])) for name, chars in texts.SCRIPTS.items()}
        best, total = max(counts, key=counts.get), sum(counts.values())
        assert (r.script, r.share) == ((best, counts[best] / total) if total else ("unknown", 0.0))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(x#", plan)) == 2


def test_triangulate_moves_its_votes_once(spark):
    rows = [(k, f"r{k % 7}", "price" if k % 2 else "name", f"s{k % 11}", f"${k % 3 + 10}.50", (k % 5) / 4, f"g{k % 4}" if k % 3 else None) for k in range(200)] + [(999, None, "name", "s", "x", 0.5, None)]
    seen = spark.createDataFrame(rows, "seq long, record_id string, field_name string, source_domain string, value string, trust_score double, independence_group string")
    found = trust.triangulate(seen)
    for df in (seen, seen.withColumn("field_name", F.lit("price"))):
        plan = trust.triangulate(df)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 1
    lists = {(r.record_id, r.field_name): r for r in found.collect()}
    plain = [r for r in trust.consensus(seen).collect() if r.record_id]
    assert len(plain) == len(lists) == 14
    for r in plain:
        both = lists[r.record_id, r.field_name]
        assert (both.consensus_value, both.normalized_value, both.total_clusters, len(both.conflicts)) == (r.consensus_value, r.normalized_value, r.total_clusters, r.n_conflicts)
        assert both.confidence == pytest.approx(r.confidence) and len(both.winning_sources) == r.n_sources


def test_page_jobs_hold_a_few_pages_at_a_time():
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    page = "<p>" + "x" * 2000 + "</p>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(3003)), pa.array([page] * 3000 + [None, "", page * 2000])], ["page_id", "html"])
    for run in (pages.clean_pages(Rows()), pages.sanitize_pages(Rows()), pages.extract_fields(Rows(), [pages.Selector("p", "css", "p")])):
        found = list(run(iter([batch, batch.slice(0, 0)])))
        assert [k for part in found for k in part.column("page_id").to_pylist()] == list(range(3003))
        assert max(part.num_rows for part in found) <= pages.SLICE // len(page) + 3
