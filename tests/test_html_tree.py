"""The HTML tree source: depth, bytes, round trip, commit and abort."""

import os
from pathlib import Path
from types import SimpleNamespace

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from sitelens.plans.site import generation_frames
from sitelens.sources import html_tree
from sitelens.sources.pages import scan_html_files
from sitelens.sources.sinks import write_injected_files


def put(root, path, data):
    f = Path(root, path)
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_bytes(data.encode() if isinstance(data, str) else data)


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_directories_below_the_depth_are_not_listed():
    directory, file = pafs.FileType.Directory, pafs.FileType.File
    asked = []

    def entries(path):
        asked.append(path)
        if path.count("/d") >= 3:
            raise PermissionError(path)
        return [SimpleNamespace(path=f"{path}/{n}", type=t, size=1) for n, t in (("b.html", file), ("a.htm", file), ("x.txt", file), ("C.HTML", file), ("d", directory))]

    found = [p for p, _ in html_tree.listed("/root", 3, entries)]
    assert found == ["a.htm", "b.html", "d/a.htm", "d/b.html", "d/d/a.htm", "d/d/b.html"]
    assert asked == ["/root", "/root/d", "/root/d/d"]


def test_depth_and_invalid_utf8(spark, tmp_dir):
    put(tmp_dir, "index.html", "<p>grüß</p>")
    put(tmp_dir, "a b/+c%20.htm", b"<p>\xff\xfe caf\xe9</p>")
    put(tmp_dir, "1/2/3/4/deep.html", "<p>5</p>")
    put(tmp_dir, "1/2/3/4/5/deeper.html", "<p>6</p>")
    put(tmp_dir, "empty.html", "")
    rows = {r["url"].split("/", 3)[3]: r for r in scan_html_files(spark, tmp_dir).collect()}
    assert set(rows) == {"index.html", "a b/+c%20.htm", "1/2/3/4/deep.html", "empty.html"}
    assert rows["index.html"]["html"] == "<p>grüß</p>" and rows["index.html"]["is_valid_utf8"]
    assert not rows["a b/+c%20.htm"]["is_valid_utf8"] and "�" in rows["a b/+c%20.htm"]["html"]
    assert {k for k, r in rows.items() if not r["is_valid_utf8"]} == {"a b/+c%20.htm"}
    assert scan_html_files(spark, tmp_dir, max_depth=1).count() == 2
    os.makedirs(f"{tmp_dir}/none")
    assert scan_html_files(spark, f"{tmp_dir}/none").count() == 0


def test_injected_tree_has_the_same_paths(spark, tmp_dir):
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>Quiet boats and rivers.</p></body></html>"
    paths = ["index.html", "shop/a.htm", "shop/b c.html", "x/y/z.html"]
    for p in paths:
        put(f"{tmp_dir}/in", p, page.format(p))
    pages = scan_html_files(spark, f"{tmp_dir}/in").drop("is_valid_utf8")
    injected = generation_frames(pages)["page_injected"]
    before = tree(f"{tmp_dir}/in")
    put(f"{tmp_dir}/out", "old/left.html", "from a run before")
    write_injected_files(injected, pages, f"{tmp_dir}/out")
    assert sorted(tree(f"{tmp_dir}/out")) == sorted(paths) and tree(f"{tmp_dir}/in") == before
    again = {r["url"].split("/", 3)[3]: r["html"] for r in scan_html_files(spark, f"{tmp_dir}/out").collect()}
    want = {r["url"].split("/", 3)[3]: r["html"] for r in injected.join(pages.select("page_id", "url"), "page_id").collect()}
    assert again == want and all('name="robots"' in h for h in again.values())


def test_a_failed_task_leaves_nothing(spark, tmp_dir):
    put(f"{tmp_dir}/out", "kept.html", "kept")
    rows = spark.range(8, numPartitions=4).select(F.format_string("p/%d.html", "id").alias("path"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string").alias("html"))
    for frame in (rows, spark.createDataFrame([("good.html", "x"), ("../bad.html", "x")], "path string, html string")):
        with pytest.raises(Exception):
            html_tree.write_tree(frame, f"{tmp_dir}/out")
        assert tree(f"{tmp_dir}/out") == {"kept.html": b"kept"} and os.listdir(f"{tmp_dir}/out") == ["kept.html"]
    html_tree.write_tree(rows.where("id < 7"), f"{tmp_dir}/out", mode="append")
    assert sorted(tree(f"{tmp_dir}/out")) == ["kept.html", *(f"p/{i}.html" for i in range(7))]


def test_file_paths_of_urls(spark):
    urls = ["file://%2Ftmp%2Fa/x/b c.html", "https://a.org", "https://a.org/", "https://a.org/b/", "https://a.org/b", "https://a.org/b.htm", "https://a.org/../b//c", "https://a.org/b?x=1", "https://a.org/b?x=2"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(html_tree.file_path(F.col("u"))).collect()]
    assert got[:7] == ["x/b c.html", "a.org/index.html", "a.org/index.html", "a.org/b/index.html", "a.org/b.html", "a.org/b.htm", "a.org/_/b/c.html"]
    assert got[7] != got[8] and all(g.startswith("a.org/b-") and g.endswith(".html") for g in got[7:])
    for g in got:
        assert html_tree.checked_path(g) == g
