"""Sources, sinks and streaming."""

import os

from conftest import SF_SMALL
from sitelens.plans.queries import QUERIES


def tree(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def test_scan_html_files(spark, tmp_dir):
    """Every file of a tree, also below names with blanks and signs; two roots share neither site nor id."""
    from sitelens.sources.pages import scan_html_files, with_site

    one, two = os.path.join(tmp_dir, "my site+1%"), os.path.join(tmp_dir, "other", "my site+1%")
    home = "<html><head><title>Home</title></head><body><h1>Hi</h1></body></html>"
    files = {"index.html": home, "blog/my post+é.htm": "<title>Post</title>", "blog/notes.txt": "no", "a/b/c/d/five.html": "x", "a/b/c/d/e/six.html": "x"}
    tree(one, files)
    tree(two, {"index.html": home})
    first, second = (with_site(scan_html_files(spark, r)).collect() for r in (one, two))
    assert sorted(r.url.split("/", 3)[3] for r in first) == ["a/b/c/d/five.html", "blog/my post+é.htm", "index.html"]
    assert len({r.site for r in first}) == 1 and first[0].site != second[0].site
    assert not {r.page_id for r in first} & {r.page_id for r in second}
    assert all(r.is_valid_utf8 for r in first)


def test_framework_from_marker_files_of_a_root(spark, tmp_dir):
    from sitelens.sources.files import detect_framework, no_site_files, scan_site_files
    from sitelens.sources.pages import scan_html_files, with_site

    root = os.path.join(tmp_dir, "app one")
    tree(root, {"index.html": "<p>", "package.json": '{"dependencies": {"vue": "3"}}', "sub/next.config.js": "x"})
    sites = with_site(scan_html_files(spark, root))
    assert [r.framework for r in detect_framework(scan_site_files(spark, root), sites).collect()] == ["Vue"]
    assert [r.framework for r in detect_framework(no_site_files(spark), sites).collect()] == ["VanillaHtml"]


def test_sinks(spark, tmp_dir):
    from sitelens.sources.sinks import write_analysis_json, write_injected, write_report

    write_analysis_json(QUERIES["site_audit"](spark, SF_SMALL), os.path.join(tmp_dir, "json"))
    assert spark.read.json(os.path.join(tmp_dir, "json")).count() > 0
    write_injected(QUERIES["page_injected"](spark, SF_SMALL), os.path.join(tmp_dir, "inj"))
    assert spark.read.parquet(os.path.join(tmp_dir, "inj")).count() == 50
    write_report(QUERIES["site_report"](spark, SF_SMALL), os.path.join(tmp_dir, "md"), per_site_files=True)
    assert any(d.startswith("site=") for d in os.listdir(os.path.join(tmp_dir, "md")))
    write_report(QUERIES["site_report"](spark, SF_SMALL), os.path.join(tmp_dir, "mdp"))
    assert spark.read.parquet(os.path.join(tmp_dir, "mdp")).where("report_md LIKE '# SEO Analysis Report%'").count() > 0


def test_streaming_page_audit(spark, tmp_dir):
    from sitelens.streaming.audit_stream import read_page_stream, stream_page_audit, stream_site_audit

    src = os.path.join(tmp_dir, "in")
    spark.read.parquet(f"{SF_SMALL}/pages.parquet").write.parquet(src)
    q = stream_page_audit(read_page_stream(spark, src), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), trigger_once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(tmp_dir, "out")).count() == 50
    q2 = stream_site_audit(read_page_stream(spark, src), os.path.join(tmp_dir, "sites"), os.path.join(tmp_dir, "ck2"), trigger_once=True)
    q2.awaitTermination(120)
    sites = spark.read.parquet(os.path.join(tmp_dir, "sites"))
    assert sites.count() == QUERIES["site_audit"](spark, SF_SMALL).count()


def test_batch_run_materializes_and_writes(spark, tmp_dir):
    from sitelens.plans.run import run
    from sitelens.sources.pages import read_pages

    paths = run(read_pages(spark, SF_SMALL), os.path.join(tmp_dir, "out"), run_id=os.path.basename(tmp_dir))
    assert spark.read.json(paths["page_analysis"]).count() == 50
    assert spark.read.parquet(paths["page_scores"]).count() == 50
    assert spark.read.parquet(paths["page_injected"]).where("status = 'ok'").count() == 50
    sites = QUERIES["site_audit"](spark, SF_SMALL).count()
    assert spark.read.parquet(paths["site_reports"]).count() == sites
    assert spark.read.parquet(paths["site_main_injected"]).where("status = 'ok'").count() == sites
    ckpt = spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(os.path.join(ckpt.replace("file:", ""), "tables", os.path.basename(tmp_dir), "page_base"))


def test_run_writes_nothing_that_the_user_did_not_give(spark, tmp_dir):
    from conftest import one_page
    from sitelens.plans.run import run

    html = "<html lang='en'><head><title>Plain</title></head><body><p>Quiet words about boats and rivers</p></body></html>"
    page = one_page(spark, html, url="https://ab.com/")
    paths = run(page, os.path.join(tmp_dir, "out"))
    again = run(page, os.path.join(tmp_dir, "again"))  # a second run has tables of its own
    assert spark.read.json(again["page_analysis"]).count() == 1
    injected = spark.read.parquet(paths["page_injected"]).first()["html"]
    for made_up in ("seo", "acme", "555", "Main St", "info@", "og.png", "1234567890", "Official"):
        assert made_up not in injected.lower()
    assert "ab.com" in injected
    report = spark.read.parquet(paths["site_reports"]).first()["report_md"]
    assert "NextJs" not in report and "VanillaHtml" in report
    document = spark.read.json(paths["page_analysis"]).first()
    assert document["raw_text"].split() == "Quiet words about boats and rivers Plain".split()
    assert {"boats", "rivers"} <= {k["word"] for k in document["keywords"]}
    assert document["keywords"][0]["is_phrase"] is False and document["keywords"][0]["frequency"] == 1
    assert document["audit"]["has_title"] and document["audit"]["h1_count"] == 0
