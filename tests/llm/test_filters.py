"""URL templates and personal data against plain versions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenequality.llm import pii
from scenequality.llm import url_templates as urls
from scenequality.llm.common import table
from scenequality.llm.queries import URL_RULES, op7_url_templates

DATA = "/root/testdata/sf0.01"


def plain_url(url):
    """Host, path and rule text of a url."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com", "http://example.com/en/",
       "x://É.net/fr/a?b", "http://a.net#f/fr/", "http://anet/fr/", "http://com/x", "a://b://c/d", "http://ex\nample.org/p\nq"]


def test_parts_and_rules(spark):
    rows = [(i, u, "taken") for i, u in enumerate(ODD)] + [(None, ODD[4], "taken"), (0, ODD[0], "taken")]
    pages = spark.createDataFrame(rows, "page_id long, url string, template string")
    found = urls.filter_urls(pages, URL_RULES).collect()
    want = []
    for i, u, _ in rows:
        host, path, rule = plain_url(u)
        want.append((i, host, path, rule.text if rule else None, rule.verdict if rule else "allow"))
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found], key=repr) == sorted(want, key=repr)
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, []).collect()} == {"allow"}


def test_rules_on_the_table(spark):
    pages = {r.page_id: r.url for r in table(spark, DATA, "pages").collect()}
    found = op7_url_templates(spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path, rule = plain_url(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert rule is None or r.verdict == rule.verdict


def test_templates_generalise_merge_and_reject(spark):
    rows = []
    for k in range(60):
        rows += [("h.net", f"/ads/{k}/x", "block"), ("h.net", f"/bet/{k}/x", "block" if k else None)]
        rows += [("h.net", f"/news/{k}", "allow"), ("h.net", f"/post/{k}", None), ("h.net", f"/rare{k}", None)]
        rows += [("i.net", f"/de/{k}", None), ("i.net", f"/en/{k}", None)]
    tree = urls.url_templates(spark.createDataFrame(rows, "host string, path string, label string"))
    found = {(r.path, r.template) for r in tree.collect()}
    assert ("/ads/3/x", "/{ads|bet}/*/x") in found and ("/bet/0/x", "/{ads|bet}/*/x") in found
    assert ("/news/5", "/news/*") in found and ("/post/5", "/post/*") in found and ("/rare7", "/*") in found
    assert ("/de/7", "/{de|en}/*") in found
    purity = {r.template: r.purity for r in urls.template_purity(tree).collect()}
    assert purity["/{ads|bet}/*/x"] > 0.9 and purity["/news/*"] < 0.2 and purity["/post/*"] is None
    deep = spark.createDataFrame([("h", "/" + "/".join("abcdefgh"), None)] * 50, "host string, path string, label string")
    assert {r.template for r in urls.url_templates(deep).collect()} == {"/a/b/c/d/e/f/g/h"}


# ---------------------------------------------------------------- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [
        (kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(kind, m[0])
    ]


def spans_of(rows):
    return sorted(((r.doc_id, r.text, [tuple(s) for s in r.base]) for r in rows), key=repr)


def test_base_spans_of_odd_texts(spark):
    texts = ["a@b.c", "x a@b.co@d.ef,a@b.c-_x@d.e. @x.y a@b a.@.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3.4.5", None, "",
             "4111 1111-1111 1111 4111111111111112 0000000000000000 1-2", "+1 (743) 555-3824 +1+22 (3)45678 +12 (", "é🙂 a@b.cd 🙂+12345678 1.1.1.1",
             "a" * 50_000 + "@b.c " + "1 " * 20_000 + "1.2" * 5000, "+1 (743) 555-3824 " * 700, "+1 (743) 555-3824 " * 700]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base string, email string")
    found = pii.find_personal_data(docs)
    assert found.columns == ["doc_id", "text", "email", "spans", "base"]
    want = sorted(((i if i != 4 else None, t, plain_spans(t)) for i, t in enumerate(texts)), key=repr)
    assert spans_of(found.collect()) == want
    assert pii.find_personal_data(docs.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text("1203.+@ab- ()é", max_size=80), min_size=1, max_size=12))
def test_base_spans_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.select("doc_id", "text", *[pii.base_spans(F.col("text"), k).alias(k) for k in pii.KINDS]).collect()
    for r in found:
        got = [(k, m.start, m.end) for k in pii.KINDS for m in r[k]]
        assert got == plain_spans(r.text)
        assert all(m.value == r.text[m.start : m.end] for k in pii.KINDS for m in r[k])


def test_contexts_discover_identifiers(spark):
    rows = [(k, f"reach me, account {4929_0000_0000 + k}x or mail bob{k}@ex.org today") for k in range(20)]
    rows += [(100 + k, f"then mail XK-{7000 + k}-Q today, and at page {k}99") for k in range(3)]
    rows += [(200 + k, f"written at page 12{k}456 of the book") for k in range(9)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(3):
        learned = [s for s in found[100 + k].spans if s.kind == pii.LEARNED]
        assert [found[100 + k].text[s.start : s.end] for s in learned] == [f"XK-{7000 + k}-Q"]
    assert not any(s.kind == pii.LEARNED for k in range(9) for s in found[200 + k].spans)


def test_masking(spark):
    text = "é a@b.cd, +1 (743) 555-3824 1.2.3.4"
    frame = spark.createDataFrame([(text,), ("plain",), (None,)], "text string")
    spans = F.lit(None).cast(pii.SPAN)
    spans = F.when(F.col("text").contains("@"), F.expr(
        "array(named_struct('kind','email','start',2,'end',8), named_struct('kind','phone','start',10,'end',27),"
        "named_struct('kind','ip','start',20,'end',30), named_struct('kind','ip','start',28,'end',35))")).otherwise(F.array().cast(pii.SPAN))
    got = [r[0] for r in frame.select(pii.masked(F.col("text"), spans)).collect()]
    assert got == ["é [EMAIL], [PHONE]", "plain", None]


@pytest.mark.parametrize("digits, good", [("4111111111111111", True), ("4111111111111112", False), ("0", True), ("18", True)])
def test_luhn(spark, digits, good):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] is good
