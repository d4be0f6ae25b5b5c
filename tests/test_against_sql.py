"""Registered queries against their SQL on small tables of odd rows."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare
from docweir.catalog.inputs import TABLES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def check(spark, tmp_path, names, **tables):
    """Compares queries on the smallest tables, of which some are replaced by ``(rows, schema)``."""
    folder = tmp_path / "tables"
    folder.mkdir()
    for name in TABLES:
        if name in tables:
            rows, schema = tables[name]
            spark.createDataFrame(rows, schema).toPandas().to_parquet(folder / f"{name}.parquet")
        else:
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    for name in names:
        line, good = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], str(folder))
        assert good, line


PAGES = "page_id bigint, url string, html string"


def test_roots_of_many_sitemaps_follow_their_addresses(spark, tmp_path):
    # index files 0, 2 and 11: as text, 11 comes before 2
    rows = [(i, f"https://a.example.org/en/{i}", "") for i in (0, 7, 5000, 5003, 27500, 27503)]
    check(spark, tmp_path, ["sitemap_expand", "sitemap_collect"], pages=(rows, PAGES))


def test_character_references_as_in_the_sql(spark, tmp_path):
    heads = ["A &amp; B", "a &quot;word&quot;", "cut &amp;&amp", "R&D &lt; &#x27;x&#x27; &nbsp;", "&amp;quot;"]
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p><b>{0} and &amp;lt; more</b></p></article></body></html>"
    rows = [(i, f"https://a.example.org/en/{i}", page.format(h)) for i, h in enumerate(heads)]
    check(spark, tmp_path, ["page_title", "page_markdown"], pages=(rows, PAGES))


def test_links_of_optional_sections_are_counted_in_one_pass(spark, tmp_path):
    texts = ["Other words\nA link here", "A link here\nEnd of it\nB more", "no link", "", "Over all\nC one\nIn between\nD two\nOut of\nTo three", "A x\nOld it\nB y\nA z"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    check(spark, tmp_path, ["llms_selected_links"], documents=(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    found = entry.queries()["llms_selected_links"](spark, str(tmp_path / "tables"))
    assert {r.file_id: (r.links, r.wanted) for r in found.collect()} == {0: (1, 0), 1: (2, 2), 4: (3, 1), 5: (3, 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
