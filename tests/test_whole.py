"""Queries on small tables by brute force: whole texts, equal hashes, entities."""

import html
import re

from casefile.operators import similarity
from casefile.plans import catalog


def _written(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_equal_hashes_meet_at_distance_0(spark, tmp_path):
    vectors = [[1.0 if (i >> (k // 8)) & 1 else -1.0 for i in [n] for k in range(64)] for n in (5, 5, 5, 4, 9, 200)]
    vectors[1] = [2 * x for x in vectors[1]]
    rows = [(n, v) for n, v in enumerate(vectors)]
    _written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    bits = [[x > 0 for x in v] for v in vectors]
    apart = lambda a, b: sum(x != y for x, y in zip(bits[a], bits[b], strict=True))
    want = {(a, b): apart(a, b) for a in range(6) for b in range(a + 1, 6) if apart(a, b) <= 12}
    hashed = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", catalog._sign_hash("embedding").alias("h"))
    member = {r.vec_id: r.representative for r in similarity.members(hashed, "vec_id", "h").collect()}
    pairs = {(r.a, r.b): r.distance for r in similarity.representative_pairs(hashed, "vec_id", "h", 12).collect()}
    assert member == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    # membership and the pairs of representatives give every pair again
    again = {(a, b): pairs.get((min(member[a], member[b]), max(member[a], member[b]))) for a in range(6) for b in range(a + 1, 6)}
    assert {k: d for k, d in again.items() if d is not None} == want and 0 in want.values()


def test_whole_texts(spark, tmp_path):
    texts = ["x " * 300 + "{late} {a}\n# Head\n```\ncode\n```", "short {early}", ""]
    _written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    _written(spark, tmp_path, "labels", [(0, 1)], "doc_id long, quality int")
    pages = [(0, "http://h/" + "p" * 230 + ".html", "y" * 600 + "<b>'&\""), (1, "http://h/a", "<i>")]
    _written(spark, tmp_path, "pages", pages, "page_id long, url string, html string")
    at = str(tmp_path)
    assert {r.doc_id: r.n for r in catalog.template_variables(spark, at).collect()} == {i: len(set(re.findall(r"\{(\w+)\}", t + " {a} {b_1} {a}"))) for i, t in enumerate(texts)}
    reports = {r.doc_id: r.markdown for r in catalog.report_markdown(spark, at).collect()}
    assert texts[0] in reports[0] and texts[1] in reports[1]
    assert any("code" in str(r) for r in catalog.markdown_blocks(spark, at).collect())
    forms = {r.page_id: r for r in catalog.text_forms(spark, at).collect()}
    for i, _, source in pages:
        assert forms[i].escaped == html.escape(source).replace("&#x27;", "&#39;")
    assert forms[0].filename == ("http___h_" + "p" * 230)[:195] + ".html" and forms[1].filename == "http___h_a"
    shown = {r.page_id: r.page for r in catalog.report_html(spark, at).collect()}
    assert "&lt;b&gt;" in shown[0]


def test_missing_entities_count(spark, tmp_path):
    rows = [(1, 0, "user", "write ana@site.com and bob@site.com about report"), (1, 1, "assistant", "write about report"), (2, 0, "user", "write about report"), (2, 1, "assistant", "write about report"), (3, 0, "user", "write ana@site.com about report"), (3, 1, "assistant", "write ana@site.com about report")]
    _written(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    got = {r.id: r for r in catalog.consistency_check(spark, str(tmp_path)).collect()}
    assert got["1-0"].odd == "entity:ana@site.com,entity:bob@site.com" and got["1-0"].verdict != "consistente"
    assert (got["2-0"].odd, got["2-0"].verdict) == ("", "consistente") and got["3-0"].odd == ""
